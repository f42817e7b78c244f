"""Large JSON and CSV files read by many tasks each.

Spark cuts text files into splits, here at each ``}`` (JSON) or line end (CSV).
Where a split begins, a quote may be open and brackets may be nested, which only
the text before it tells. So a first pass sums each split up, for both cases of the
quote: whether it turns the quote state, by how much it changes the depth, and
which brackets it opened last at each depth. These sums, one row a split, are
folded file by file into the state in which each split begins. The second pass
reads each split from its state and gives whole records; a record that splits cut
is put together from its parts, at most two a split.

A CSV state is the quote alone. Nothing is inferred: a JSON record is a string that
the caller parses with a schema of its own, a CSV record an array of fields.

The states are joined to the splits by a broadcast up to ``STATES`` rows (a row a
split, so some terabytes of input); beyond it by a shuffled join, after which rows
are put back in their order. Rows of a file are read in order only within a
split, which is all that is used.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import written

#: Splits whose states are broadcast.
STATES = 50_000

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


# --- JSON ------------------------------------------------------------------------


class _Sums:
    """What a split does to quote and depth, if it begins inside a string (``quoted``) or not."""

    def __init__(self, quoted: bool):
        self.quoted, self.depth, self.opened = quoted, 0, {}

    def feed(self, text: str) -> None:
        at = 0
        if self.quoted:
            rest = _REST.match(text)
            if not rest:
                return
            at, self.quoted = rest.end(), False
        said = None
        for m in _TOKEN.finditer(text, at):
            c = text[m.start()]
            if c == '"':
                if m[1]:
                    said = m
                else:
                    self.quoted = True
            elif c in "{[":
                self.opened[self.depth] = [c, _key(text, said, m.start())]
                self.depth += 1
            else:
                self.depth -= 1


def _key(text: str, said: re.Match | None, at: int) -> str | None:
    """The key whose value begins here."""
    return text[said.start() + 1 : said.end() - 1] if said and text[said.end() : at].strip() == ":" else None


class _Records:
    """Elements of a top-level array or of a wrapping object's named array, and top-level objects (without such elements)."""

    def __init__(self, wrappers: tuple[str, ...], quoted: bool, depth: int, outer: str | None, inner: str | None, key: str | None):
        self.wrappers, self.quoted, self.depth = wrappers, quoted, depth
        self.outer, self.inner, self.key = outer, inner, key
        self.out: list[tuple] = []
        wrapped = outer == "{" and depth >= 2 and inner == "[" and key in wrappers
        inside = outer == "[" and depth >= 2 or wrapped and depth >= 3
        self.target = "item" if inside else "object" if outer == "{" and depth >= 1 else None
        self.parts: dict[str, list[str]] = {"item": [], "object": []}
        self.cut = {"item": inside, "object": outer == "{" and depth >= 1}
        self.wraps = wrapped

    def _give(self, kind: str, open_end: bool) -> None:
        wraps = kind == "object" and self.wraps
        key = self.key if kind == "item" and self.outer == "{" else None
        self.out.append((kind, key, "" if wraps else "".join(self.parts[kind]), self.cut[kind], open_end, wraps))
        self.parts[kind], self.cut[kind] = [], False

    def feed(self, text: str) -> None:
        at = mark = 0
        if self.quoted:
            rest = _REST.match(text)
            if not rest:
                if self.target:
                    self.parts[self.target].append(text)
                return
            at, self.quoted = rest.end(), False
        said = None
        for m in _TOKEN.finditer(text, at):
            p = m.start()
            c = text[p]
            if c == '"':
                if m[1]:
                    said = m
                else:
                    self.quoted = True
            elif c in "{[":
                if self.depth == 0:
                    self.outer, self.inner, self.key, self.wraps = c, None, None, False
                    if c == "{":
                        self.target, mark = "object", p
                elif self.depth == 1:
                    self.inner, self.key = c, _key(text, said, p)
                    if self.outer == "[":
                        self.target, mark = "item", p
                    elif c == "[" and self.key in self.wrappers:
                        self.wraps = True
                elif self.depth == 2 and self.target == "object" and self.inner == "[" and self.key in self.wrappers:
                    self.parts["object"].append(text[mark:p])
                    self.target, mark = "item", p
                self.depth += 1
            else:
                self.depth -= 1
                if self.target == "item" and self.depth == (1 if self.outer == "[" else 2):
                    self.parts["item"].append(text[mark : p + 1])
                    self._give("item", False)
                    self.target, mark = (None if self.outer == "[" else "object"), p + 1
                elif self.target == "object" and self.depth == 0:
                    self.parts["object"].append(text[mark : p + 1])
                    self._give("object", False)
                    self.target = None
        if self.target:
            self.parts[self.target].append(text[mark:])

    def end(self) -> None:
        if self.target == "item":
            self._give("item", True)
        if self.outer == "{" and self.depth >= 1:
            self._give("object", True)


# --- CSV -------------------------------------------------------------------------


class _Lines:
    """Records of lines whose quotes are closed."""

    def __init__(self, quoted: bool):
        self.quoted, self.cut, self.parts, self.out = quoted, quoted, [], []

    def feed(self, line: str) -> None:
        self.parts.append(line)
        if line.count('"') % 2:
            self.quoted = not self.quoted
        if not self.quoted:
            self._give(False)

    def _give(self, open_end: bool) -> None:
        self.out.append(("\n".join(self.parts), self.cut, open_end))
        self.parts, self.cut = [], False

    def end(self) -> None:
        if self.parts or self.cut:
            self._give(True)


csv.field_size_limit(1 << 62)


def fields_of(record: str) -> list[str]:
    try:
        return next(csv.reader(io.StringIO(record.rstrip("\r"), newline="")), [])
    except csv.Error:
        return []


# --- both ------------------------------------------------------------------------

_WHERE = "file string, block long"


def _pieces(spark: SparkSession, path: str, separator: str, suffix: str) -> DataFrame:
    """(file, block, piece): pieces of each split, in order within it."""
    raw = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def _split_sums(new: Callable[[], list], feed: Callable[[list, list[str]], None], row: Callable[[list], dict], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each split."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            for where, pieces in _runs(batch):
                if where != here:
                    if here is not None:
                        yield pa.RecordBatch.from_pylist([{"file": here[0], "block": here[1]} | row(state)], arrow)
                    here, state = where, new()
                feed(state, pieces)
        if here is not None:
            yield pa.RecordBatch.from_pylist([{"file": here[0], "block": here[1]} | row(state)], arrow)

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    files, blocks, pieces = (batch.column(i).to_pylist() for i in range(3))
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or blocks[i] != blocks[start] or files[i] != files[start]:
            yield (files[start], blocks[start]), pieces[start:i]
            start = i


def _folded(df: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """The rows of each file (a few for each split), in order, as others."""
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(fold(table.sort_by([(c, "ascending") for c in ("block", "no") if c in table.column_names]).to_pylist()), arrow)

    return df.groupBy("file").applyInArrow(run, schema)


def _with_states(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with the state of their split; in order within each split."""
    named = states.select(F.col("file").alias("__file"), F.col("block").alias("__block"), *[c for c in states.columns if c not in ("file", "block")])
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    few = states.limit(STATES + 1).count() <= STATES  # a row a split
    if few:
        return pieces.join(F.broadcast(named), same).drop("__file", "__block")
    numbered = pieces.withColumn("__no", F.monotonically_increasing_id())
    return numbered.join(named, same).repartition("file", "block").sortWithinPartitions("file", "block", "__no").drop("__file", "__block", "__no")


def _extracted(new: Callable[[dict], object], rows: Callable[[object], list[dict]], feed: Callable[[object, list[str]], None], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, numbers = None, None, itertools.count()

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": here[0], "block": here[1], "no": next(numbers)} | r for r in rows(state)], arrow)

        for batch in batches:
            names = batch.schema.names[3:]
            row = 0
            for where, pieces in _runs(batch):
                if where != here:
                    if here is not None:
                        state.end()
                        yield give()
                    here, state = where, new({n: batch.column(n)[row].as_py() for n in names})
                feed(state, pieces)
                row += len(pieces)
                if here is not None and state.out:
                    yield give()
        if here is not None:
            state.end()
            yield give()

    return run


def _drained(state: object) -> list:
    out, state.out = state.out, []
    return out


def json_items(spark: SparkSession, path: str, wrappers: tuple[str, ...], suffix: str = "") -> DataFrame:
    """(file, item): the elements of top-level lists, of the first wrapping list of an object, or else the top-level objects themselves, as JSON."""
    pieces = _pieces(spark, path, "}", suffix)
    sums_schema = StructType.fromDDL(f"{_WHERE}, sums array<struct<quoted boolean, depth long, opened array<struct<at long, bracket string, key string>>>>")

    def row(states: list[_Sums]) -> dict:
        return {"sums": [{"quoted": s.quoted, "depth": s.depth, "opened": [{"at": at, "bracket": b, "key": k} for at, (b, k) in s.opened.items()]} for s in states]}

    def feed_sums(states: list[_Sums], parts: list[str]) -> None:
        text = "".join([p + "}" for p in parts])
        for s in states:
            s.feed(text)

    sums = pieces.mapInArrow(_split_sums(lambda: [_Sums(False), _Sums(True)], feed_sums, row, sums_schema), sums_schema)

    def fold(rows: list[dict]) -> list[dict]:
        quoted, depth, outer, inner, key, out = False, 0, None, None, None, []
        for r in rows:
            out.append({"file": r["file"], "block": r["block"], "quoted": quoted, "depth": depth, "outer": outer, "inner": inner, "key": key})
            s = r["sums"][int(quoted)]
            opened = {x["at"] + depth: x for x in s["opened"]}
            if 0 in opened:
                outer = opened[0]["bracket"]
            if 1 in opened:
                inner, key = opened[1]["bracket"], opened[1]["key"]
            quoted, depth = s["quoted"], depth + s["depth"]
        return out

    states = written(_folded(sums, fold, StructType.fromDDL(f"{_WHERE}, quoted boolean, depth long, outer string, inner string, key string")), "json-states")
    found_schema = StructType.fromDDL(f"{_WHERE}, no long, kind string, key string, item string, cut_start boolean, cut_end boolean, wraps boolean")
    found = _with_states(pieces, states).mapInArrow(
        _extracted(
            lambda s: _Records(wrappers, s["quoted"], s["depth"], s["outer"], s["inner"], s["key"]),
            lambda state: [dict(zip(("kind", "key", "item", "cut_start", "cut_end", "wraps"), x, strict=True)) for x in _drained(state)],
            lambda state, parts: state.feed("".join([p + "}" for p in parts])),
            found_schema,
        ),
        found_schema,
    )
    found = written(found, "json-items")

    def stitch(rows: list[dict]) -> list[dict]:
        out, open_ = [], {}
        for r in rows:
            kind = r["kind"]
            if r["cut_start"] and kind in open_:
                open_[kind]["parts"].append(r["item"])
                open_[kind]["wraps"] |= r["wraps"]
            else:
                open_[kind] = {"parts": [r["item"]], "wraps": r["wraps"], "key": r["key"]}
            if not r["cut_end"]:
                x = open_.pop(kind)
                out.append({"file": r["file"], "kind": kind, "key": x["key"], "item": "".join(x["parts"]), "wraps": x["wraps"]})
        # What the file never closed is no JSON value.
        return out

    whole_schema = StructType.fromDDL("file string, kind string, key string, item string, wraps boolean")
    cut = _folded(found.where("cut_start OR cut_end"), stitch, whole_schema)
    items = found.where("NOT cut_start AND NOT cut_end").select("file", "kind", "key", "item", "wraps").unionByName(cut).where("NOT wraps")
    # An object with several wrapping lists counts for the first of them that holds anything.
    rank = F.array_position(F.array(*[F.lit(w) for w in wrappers]), F.col("key"))
    several = found.where("key IS NOT NULL").groupBy("file").agg(F.min(rank).alias("__first"), F.max(rank).alias("__last")).where("__first != __last").select(F.col("file").alias("__file"), "__first")
    if several.isEmpty():
        return items.select("file", "item")
    marked = items.join(several, F.col("file") == F.col("__file"), "left")
    return marked.where(F.col("__first").isNull() | F.col("key").isNull() | (rank == F.col("__first"))).select("file", "item")


def csv_records(spark: SparkSession, path: str, columns: dict[str, list[str]], suffix: str = "") -> DataFrame:
    """(file, columns) of the records of CSV files, whose quoted fields may hold line ends.

    A column is the first of its names that the file's header has, in any case; null where it has none. Records with
    more fields than the header are skipped; fields that a record lacks are null.
    """
    pieces = _pieces(spark, path, "\n", suffix)
    sums_schema = StructType.fromDDL(f"{_WHERE}, quotes long, header array<string>")

    class Sums:
        def __init__(self) -> None:
            self.quotes, self.lines = 0, _Lines(False)

    def feed_sums(state: Sums, parts: list[str]) -> None:
        for p in parts:
            state.quotes += p.count('"')
            if not state.lines.out:
                state.lines.feed(p)
                if state.lines.out and not state.lines.out[0][0].strip():
                    state.lines.out.clear()

    def row(state: Sums) -> dict:
        return {"quotes": state.quotes, "header": fields_of(state.lines.out[0][0].removeprefix("\ufeff")) if state.lines.out else None}

    sums = pieces.mapInArrow(_split_sums(Sums, feed_sums, row, sums_schema), sums_schema)

    def fold(rows: list[dict]) -> list[dict]:
        quoted, header, out = False, rows[0]["header"], []
        if header is None:
            if len(rows) > 1:
                raise ValueError(f"the header of {rows[0]['file']} is longer than a split")
            header = []
        names = [h.strip().lower() for h in header]
        picked = [next((names.index(a) for a in aliases if a in names), None) for aliases in columns.values()]
        for r in rows:
            out.append({"file": r["file"], "block": r["block"], "quoted": quoted, "width": len(header), "picked": picked})
            quoted ^= bool(r["quotes"] % 2)
        return out

    states = written(_folded(sums, fold, StructType.fromDDL(f"{_WHERE}, quoted boolean, width long, picked array<long>")), "csv-states")
    found_schema = StructType.fromDDL(f"{_WHERE}, no long, cut_start boolean, cut_end boolean, record string, width long, picked array<long>, fields array<string>")

    def chosen(record: str, width: int, picked: list[int | None]) -> list[str | None] | None:
        """The columns' values; nothing for a record that is too wide."""
        fields = fields_of(record)
        return [fields[i] if i is not None and i < len(fields) else None for i in picked] if len(fields) <= width else None

    def new(s: dict) -> _Lines:
        state = _Lines(s["quoted"])
        state.given = s
        return state

    def rows(state: _Lines) -> list[dict]:
        out = []
        for record, cut_start, cut_end in _drained(state):
            cut = cut_start or cut_end
            if not cut and not record.strip():
                continue
            if state.given["begins"]:  # the header
                state.given["begins"] = False
                continue
            fields = None if cut else chosen(record, state.given["width"], state.given["picked"])
            if cut or fields is not None:
                out.append({"cut_start": cut_start, "cut_end": cut_end, "record": record if cut else None, "width": state.given["width"] if cut else None, "picked": state.given["picked"] if cut else None, "fields": fields})
        return out

    def feed(state: _Lines, parts: list[str]) -> None:
        for p in parts:
            state.feed(p)

    begun = states.withColumn("begins", F.col("block") == 0)
    found = written(_with_states(pieces, begun).mapInArrow(_extracted(new, rows, feed, found_schema), found_schema), "csv-records")

    def stitch(rows: list[dict]) -> list[dict]:
        out, parts = [], []
        for i, r in enumerate(rows):
            parts = [*parts, r["record"]] if r["cut_start"] else [r["record"]]
            # A quote that is never closed: the rest of the file is one field, as it is for one task.
            if not r["cut_end"] or i + 1 == len(rows):
                fields = chosen("\n".join(parts), r["width"], r["picked"])
                out += [{"file": r["file"], "fields": fields}] if fields is not None else []
                parts = []
        return out

    cut = _folded(found.where("cut_start OR cut_end"), stitch, StructType.fromDDL("file string, fields array<string>"))
    records = found.where("NOT cut_start AND NOT cut_end").select("file", "fields").unionByName(cut)
    return records.select("file", *[F.col("fields")[i].alias(c) for i, c in enumerate(columns)])
