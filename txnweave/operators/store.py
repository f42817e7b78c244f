"""Results kept between runs, by content.

A store is a folder: ``parts/<id>`` hold results, and ``versions/<number>`` name
the parts that a version consists of. A run looks its contents up in the newest
version, computes the rest, writes it as one more part and commits by creating the
next version file, which no other run can have created; a run that fails before
that leaves the newest version as it was. After ``MOST_PARTS`` parts the next
commit writes all of them as one.

Parts are hash-bucketed by the content key: they are declared as bucketed tables on
their folders, so the contents of a run are dealt once and meet every part
without moving it. Keys are SHA-256 digests of the trimmed, lower-cased text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import normalize

MOST_PARTS = 8


class ConcurrentCommit(RuntimeError):
    """Another run has committed the version that this one was about to."""


class ResultStore:
    """Results (content_key, fields) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, fields: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = StructType.fromDDL(f"content_key string, {fields}")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _newest(self) -> tuple[int, list[str]]:
        """(number of the newest version, its parts)."""
        folder = self._path("versions")
        fs = self._fs()
        numbers = [int(n) for x in (fs.listStatus(folder) if fs.exists(folder) else []) if (n := x.getPath().getName()).isdigit()]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.folder}/versions/{max(numbers):08d}").first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, number: int, parts: list[str]) -> None:
        """The version file appears whole or not at all: it is written beside its place and moved there, which fails if the place is taken."""
        fs = self._fs()
        fs.mkdirs(self._path("versions"))
        draft, place = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{number:08d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            raise ConcurrentCommit(f"version {number} exists")

    def _table(self, part: str) -> DataFrame:
        """The part as a bucketed table on its folder."""
        name = f"store_{part}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (content_key) SORTED BY (content_key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/parts/{part}'")
        return self.spark.table(name)

    def _write(self, results: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows = results.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        rows.repartition(self.buckets, "content_key").write.format("parquet").bucketBy(self.buckets, "content_key").sortBy("content_key").option("path", f"{self.folder}/parts/{part}").saveAsTable(f"store_{part}")
        return part

    def read(self) -> DataFrame:
        """All results of the newest version."""
        out = self.spark.createDataFrame([], self.schema)
        for part in self._newest()[1]:
            out = out.unionByName(self._table(part))
        return out

    def _looked_up(self, keyed: DataFrame, parts: list[str]) -> DataFrame:
        """keyed with __known: the stored fields, null for contents that are new."""
        out, fields = keyed.repartition(self.buckets, "content_key"), [f.name for f in self.schema if f.name != "content_key"]
        known = [F.lit(None).cast(StructType([f for f in self.schema if f.name != "content_key"]))]
        for i, part in enumerate(parts):
            stored = self._table(part).select("content_key", F.struct(*fields).alias(f"__known{i}"))
            out = out.join(stored, "content_key", "left")
            known.append(F.col(f"__known{i}"))
        return out.select(*keyed.columns, F.coalesce(*known).alias("__known"))

    def results(self, df: DataFrame, compute: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
        """(content_key, fields, reused) of the distinct contents of a table, after the new ones have been computed and committed.

        ``compute`` adds the fields to rows (content_key, text). It sees each new content once.
        """
        number, parts = self._newest()
        keyed = df.where(F.col(text_col).isNotNull()).select(normalize.content_key(F.col(text_col)).alias("content_key"), F.col(text_col).alias("text"))
        contents = keyed.groupBy("content_key").agg(F.min("text").alias("text"))
        new = self._looked_up(contents, parts).where("__known IS NULL").select("content_key", "text")
        part = self._write(compute(new))
        if len(parts) >= MOST_PARTS:
            old = [self._table(p) for p in parts]
            everything = self._table(part)
            for t in old:
                everything = everything.unionByName(t)
            merged = self._write(everything)
            self._commit(number + 1, [merged])
        else:
            merged = None
            self._commit(number + 1, [*parts, part])
        # What was new is what this run's part holds, whatever has been merged.
        known = self._looked_up(contents.select("content_key"), [merged] if merged else [*parts, part])
        mine = self._table(part).select("content_key", F.lit(True).alias("__new"))
        out = known.join(mine, "content_key", "left")
        return out.select("content_key", "__known.*", F.col("__new").isNull().alias("reused"))
