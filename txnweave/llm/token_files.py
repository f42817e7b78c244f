"""Token-id files in ORC: run-length encoded integers, row indexes, Bloom filters.

``write_token_files`` range-partitions the documents by id, encodes each text
(tokenizers library, no special tokens), appends the end id and writes ORC: the
ids are an integer column under ORC's run-length encoding, each stripe has row
indexes, and the document id has a Bloom filter. Readers split the files by
stripe; ``find_documents`` prunes files, stripes and row groups by the ids' statistics
and Bloom filters before it reads any token. ``read_tokens`` gives each document its
place in the whole sequence: counts are summed by file, the files' sums (one row a
file) give each file's start, and a running sum within the file gives the rest.

The texts are dealt by ranges of (id, digest of the text), so no single source
or repeated id is one task's work beyond its own rows. The number of files follows the
bytes and rows of the table, so that a file, its sum and its readers stay small at any size.
Ids may be of any type that ORC and Arrow hold and that has an order.

Texts with the string of an added token (the end-of-text mark) are split there as the
library splits them; all others take a vectorised split and a dictionary of pieces.

Defined cases: null and empty texts are the end id alone; repeated ids are in the
order of (id, digest of the text, text), and each keeps its row; null ids come first; an
empty table gives empty files and an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import documents, new_path, small_batches, string_parts
from .pretokens import Dictionary, encode_rows

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Text in one file, and its rows, on average; the least text for which a shuffle partition more gets a file.
FILE_BYTES, FILE_ROWS, SMALL_FILE_BYTES = 128 << 20, 1_000_000, 1 << 20


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the library's byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes) -> tuple[Tokenizer, tuple[bytes, ...], Dictionary]:
    """(the library's tokenizer, the strings that it takes out of texts before all else, a dictionary over its merges)."""
    whole = Tokenizer.from_str(raw.decode())
    added = tuple(t.content.encode() for t in whole.get_added_tokens_decoder().values())
    model, table = whole.model, _byte_characters()

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(x.decode("latin-1").translate(table))] for x in pieces]

    return whole, added, Dictionary(encode)


def library_ids(raw: bytes, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids before each row) as the library encodes the rows without adding special tokens.

    A row with the string of an added token goes to the library as a whole.
    """
    whole, added, words = _tokenizer(raw)
    for i, j, ids, ends in encode_rows(data, offsets, words):
        part = data[offsets[i] : offsets[j]].tobytes()
        if any(x in part for x in added):
            made = []
            for r in range(i, j):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                if any(x in text for x in added):
                    made.append(np.array(whole.encode(text.decode(), add_special_tokens=False).ids, np.int32))
                else:
                    made.append(ids[ends[r - i] : ends[r - i + 1]])
            ids, ends = np.concatenate(made), np.concatenate([[0], np.cumsum([*map(len, made)])])
        yield i, j, ids, ends


def _encode(vocabulary: Broadcast, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j, ids, ends in library_ids(vocabulary.value, data, offsets):
                ids = np.insert(ids, ends[1:], end_id).astype(np.int32)
                ends = (ends + np.arange(len(ends))).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    return run


def file_count(spark: SparkSession, docs: DataFrame) -> int:
    """Files of about FILE_BYTES of text and at most about FILE_ROWS rows; smaller ones while that gives each shuffle partition some."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size["bytes"] // SMALL_FILE_BYTES)
    return max(1, few, -(-size["bytes"] // FILE_BYTES), -(-size["rows"] // FILE_ROWS))


def write_token_files(spark: SparkSession, docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Write (doc_id, ids, file_no, row_no) as ORC, ids ascending from file to file and inside each."""
    small_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    dealt = given.repartitionByRange(file_count(spark, given), F.col("doc_id").asc_nulls_first(), digest).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), digest, "text")
    schema = T.StructType([T.StructField("doc_id", given.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    (
        dealt.mapInArrow(_encode(vocabulary, end_id), schema)
        .withColumn("file_no", F.spark_partition_id())
        .withColumn("row_no", F.monotonically_increasing_id())
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(out)
    )


def _files(spark: SparkSession, out: str) -> DataFrame:
    """The files with the id type that they were written with."""
    return spark.read.orc(out)


def find_documents(spark: SparkSession, out: str, ids: list) -> DataFrame:
    """(doc_id, ids) of some documents; statistics and Bloom filters prune what is read."""
    return _files(spark, out).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch(
            [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)],
            names=["doc_id", "n_tokens", "ids_crc32", "file_no", "row_no"],
        )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    small_batches(spark)
    rows = _files(spark, out).select("doc_id", "ids", "file_no", "row_no")
    fields = [rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "ids_crc32")], rows.schema["file_no"], rows.schema["row_no"]]
    rows = rows.mapInArrow(_checks, T.StructType(fields))
    path = new_path(spark, "token-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    # One row for each file.
    starts = files.select(F.col("file_no").alias("__file"), (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("__start"))
    within = F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("row_no")) - F.col("n_tokens")
    out_rows = rows.withColumn("__within", within).join(starts, F.col("file_no") == F.col("__file"))
    return out_rows.select("doc_id", (F.col("__start") + F.col("__within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    write_token_files(spark, documents(spark, sf_dir), out)
    return read_tokens(spark, out)
