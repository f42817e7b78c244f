"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, the patterns are the windows of the
benchmark items. Windows of one length form a pattern group: the usual group has
``window`` words; items that are shorter form a group for each length. A group has

* a shift table over blocks of two words (one for windows of one word): how far
  the search may move when the block ends at the cursor. Unknown blocks skip
  window - 1 words, so most words are never looked at;
* buckets by the hash of the window's last block, consulted where the shift is 0;
* the windows themselves, word by word, for direct comparison.

The search runs many cursors at once, each over its own stretch of words, and
moves them all with one table lookup a step.

A benchmark of at most ``BROADCAST_BYTES`` is searched where the documents are read:
its tables are broadcast, words are compared by their numbers in its vocabulary, and nothing is
shuffled. A larger one keeps the search but not the tables: the shift tables have a fixed
size and are broadcast; the buckets are a table of windows that Spark partitions by their
text, and the places where the search stops join with it, which is the direct comparison.
Both ways compare whole words and leave out nothing.

Defined cases: null texts have no words; items without words are never found;
an item of fewer words than a window is one window; a null item id counts as
the id ''; items that share an id count once; an empty benchmark leaves every
document clean; repeated documents each get their own row; an empty table gives
an empty result; extra columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, WordTable, distinct_spans, documents, hashed_words, materialize, mix, row_steps, small_batches, span_hashes, string_parts, word_spans

WINDOW = 10
#: A benchmark of at most so many bytes is searched by tables that are broadcast (at most some 30 bytes for each of its bytes).
BROADCAST_BYTES = 4 << 20
#: Words that one cursor searches.
STRETCH = 512
_TABLE_BITS = 18
_PAIR = np.uint64(0x9FB21C651E98DF25)


def block_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of ``size`` words that ends at each position (the first is void for blocks of two)."""
    words = words.astype(np.uint64)
    if size == 1:
        return mix(words)
    out = np.zeros(len(words), np.uint64)
    out[1:] = mix(words[:-1] * _PAIR + words[1:])
    return out


def block_size(m: int) -> int:
    return min(2, m)


def slots(blocks: np.ndarray) -> np.ndarray:
    return (blocks >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def shift_table(words: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """How far the search may move when the block of a slot ends at the cursor."""
    size = block_size(m)
    blocks = slots(block_hashes(words, size))
    table = np.full(1 << _TABLE_BITS, m - size + 1, np.int32)
    for j in range(size - 1, m):
        np.minimum.at(table, blocks[starts + j], m - 1 - j)
    return table


def stops(shifts: np.ndarray, m: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Last words of possible windows in rows [lo, hi): where a search that moves by ``shifts`` stops."""
    keep = hi - lo >= m
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return np.zeros(0, np.int64)
    # Cursors: stretches of each row, by the position of the window's last word.
    parts = (hi - lo - m) // STRETCH + 1
    row = np.repeat(np.arange(len(lo)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = lo[row] + m - 1 + nth * STRETCH
    end = np.minimum(at + STRETCH, hi[row])
    found = [np.zeros(0, np.int64)]
    while len(at):
        move = shifts[at]
        found.append(at[move == 0])
        at = at + np.maximum(move, 1)
        live = at < end
        at, end = at[live], end[live]
    return np.concatenate(found)


def windows(at: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (first words, items) of the windows of items whose words lie between at[i] and at[i + 1]."""
    out = {}
    n = np.diff(at)
    for m in np.unique(np.minimum(n, window)):
        if m:
            item = np.flatnonzero(np.minimum(n, window) == m)
            many = n[item] - m + 1
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[int(m)] = (np.repeat(at[:-1][item], many) + nth, np.repeat(item, many))
    return out


class PatternGroup:
    """The windows of one length, as places in the benchmark's words."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int):
        self.m, self.size = m, block_size(m)
        self.table = shift_table(words, starts, m)
        suffix = block_hashes(words, self.size)[starts + m - 1]
        order = np.argsort(suffix, kind="stable")
        self.words, self.starts, self.items, self.suffix = words, starts[order], items[order], suffix[order]

    def search(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of each occurrence inside the rows [lo, hi) of words."""
        m = self.m
        blocks = block_hashes(words, self.size)
        ends = stops(self.table[slots(blocks)], m, lo, hi)
        first, last = np.searchsorted(self.suffix, blocks[ends], "left"), np.searchsorted(self.suffix, blocks[ends], "right")
        n = last - first
        pick = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(ends - m + 1, n)
        for j in range(m):
            same = words[at + j] == self.words[self.starts[pick] + j]
            at, pick = at[same], pick[same]
        return at, self.items[pick]


class Patterns:
    """All windows of a benchmark; its distinct words are numbered, and words are compared by number."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        data, offsets = string_parts(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets, NOT_ALNUM)
        _, first, words = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        self.vocabulary = WordTable([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        self.names = ids
        self.groups = [PatternGroup(words, p, items, m) for m, (p, items) in windows(at, window).items()]


def _lowered(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]


def _scan(shared: Broadcast, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            data, offsets = string_parts(batch.column(0))
            made = []
            for i, j in row_steps(offsets):
                words, at = hashed_words(*_lowered(data, offsets, i, j), NOT_ALNUM, patterns.vocabulary.find)
                edge = np.zeros(len(words) + 1, np.int32)
                names: list[set[str]] = [set() for _ in range(j - i)]
                for g in patterns.groups:
                    starts, items = g.search(words, at[:-1], at[1:])
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + g.m, -1)
                    # Empty rows before a word share its position: the last of them holds it.
                    rows = np.searchsorted(at, starts, "right") - 1
                    for r, x in np.unique(np.stack([rows, items]), axis=1).T.tolist():
                        names[r].add(patterns.names[x])
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                made += zip(np.diff(at).tolist(), np.diff(hit[at]).tolist(), map(sorted, names), strict=True)
            n, hits, found = zip(*made, strict=True) if made else ((), (), ())
            yield pa.record_batch(
                [*[batch.column(1 + c) for c in range(carry)], pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                names=[*[f"c{c}" for c in range(carry)], "n", "hits", "found"],
            )

    return run


# --- a benchmark of any size --------------------------------------------------


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, m: int) -> list[str]:
    """The windows' words, one blank between them."""
    s, e = starts.tolist(), ends.tolist()
    return [b" ".join([raw[s[q] : e[q]] for q in range(p, p + m)]).decode() for p in first.tolist()]


def _windows(window: int):
    """Rows (id, text) -> (m, key, item) of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j in row_steps(offsets):
                part, cut = _lowered(data, offsets, i, j)
                starts, ends, at = word_spans(part, cut, NOT_ALNUM)
                for m, (first, items) in windows(at, window).items():
                    keys = _joined(part.tobytes(), starts, ends, first, m)
                    yield pa.record_batch([pa.array(np.full(len(keys), m), pa.int32()), pa.array(keys), batch.column(0).take(pa.array(i + items))], names=["m", "key", "item"])

    return run


def _shifts(window: int):
    """Rows (id, text) -> (m, slot, shift): the entries of a task's own shift tables that let the search move less than most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j in row_steps(offsets):
                words, at = hashed_words(*_lowered(data, offsets, i, j), NOT_ALNUM)
                for m, (first, _) in windows(at, window).items():
                    new = shift_table(words, first, m)
                    tables[m] = np.minimum(tables.get(m, new), new)
        for m, table in tables.items():
            slot = np.flatnonzero(table < m - block_size(m) + 1)
            yield pa.record_batch([pa.array(np.full(len(slot), m), pa.int32()), pa.array(slot, pa.int32()), pa.array(table[slot], pa.int32())], names=["m", "slot", "shift"])

    return run


def _candidates(tables: Broadcast, carry: int):
    """Documents -> a row of each (its number, carried columns, n words) and rows (number, m, first word, key) of windows where the search stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = string_parts(batch.column(0))
            for i, j in row_steps(offsets):
                part, cut = _lowered(data, offsets, i, j)
                starts, ends, at = word_spans(part, cut, NOT_ALNUM)
                words = span_hashes(part, starts, ends)
                size, where, keys, of = [], [], [], []
                for m, table in tables.value.items():
                    first = stops(table[slots(block_hashes(words, block_size(m)))], m, at[:-1], at[1:]) - m + 1
                    of += (np.searchsorted(at, first, "right") - 1).tolist()
                    where += first.tolist()
                    size += [m] * len(first)
                    keys += _joined(part.tobytes(), starts, ends, first, m)
                n, more = j - i, len(of)
                rows = row + np.concatenate([np.arange(n), np.array(of, np.int64)])
                row += n
                nothing = [None] * n
                yield pa.record_batch(
                    [
                        pa.array(rows, pa.int64()),
                        *[pa.concat_arrays([batch.column(1 + c).slice(i, n), pa.nulls(more, batch.column(1 + c).type)]) for c in range(carry)],
                        pa.array([*np.diff(at).tolist(), *[None] * more], pa.int64()),
                        pa.array([*nothing, *size], pa.int32()),
                        pa.array([*nothing, *where], pa.int64()),
                        pa.array([*nothing, *keys], pa.string()),
                    ],
                    names=["row", *[f"c{c}" for c in range(carry)], "n", "m", "at", "key"],
                )

    return run


def _by_join(spark: SparkSession, given: DataFrame, items: DataFrame, fields: list[T.StructField], window: int) -> DataFrame:
    """The scan for a benchmark of any size: the shift tables, of a fixed size, are broadcast; the windows are a table, joined with the places where the search stops."""
    least = items.mapInArrow(_shifts(window), "m int, slot int, shift int").groupBy("m", "slot").agg(F.min("shift").alias("shift")).toArrow()
    # At most 2^18 entries for each of ``window`` lengths.
    m_of, slot, shift = (least.column(c).to_numpy() for c in range(3))
    tables = {}
    for m in np.unique(m_of).tolist():
        tables[m] = np.full(1 << _TABLE_BITS, m - block_size(m) + 1, np.int32)
        tables[m][slot[m_of == m]] = shift[m_of == m]
    extra = [T.StructField("n", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("key", T.StringType())]
    schema = T.StructType([T.StructField("row", T.LongType()), *fields, *extra])
    rows = materialize(spark, given.mapInArrow(_candidates(spark.sparkContext.broadcast(tables), len(fields)), schema), "windows")
    places = rows.where("m IS NOT NULL").select("row", "m", "at", "key")
    patterns = items.mapInArrow(_windows(window), "m int, key string, item string").distinct()
    # Distinct windows meet the patterns first, so that a passage of many documents is one row a task there.
    known = materialize(spark, places.select("m", "key").distinct().join(patterns, ["m", "key"]), "known-windows")
    found = places.join(known, ["m", "key"]).groupBy("row").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("found"))
    zero = F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("reach"))
    new = lambda a, s: F.greatest(s["end"] - F.greatest(s["at"], a["reach"]), F.lit(0).cast("long"))
    hits = F.aggregate(F.sort_array("spans"), zero, lambda a, s: F.struct((a["hits"] + new(a, s)).alias("hits"), F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["hits"])
    found = found.select("row", hits.alias("hits"), "found")
    out = rows.where("m IS NULL").join(found, "row", "left")
    return out.select(*[f.name for f in fields], "n", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The ``carry`` columns of each document with __n_words, __n_hit and __items (sorted ids)."""
    small_batches(spark)
    wanted = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.sum(F.octet_length("id")).alias("ids")).first()
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    given = docs.select(F.col(text_col), *[F.col(c) for c in carry]).toDF("text", *[f"c{i}" for i in range(len(carry))])
    if size["bytes"] + (size["ids"] or 0) <= BROADCAST_BYTES:
        held = wanted.where(F.octet_length("text") > 0).toArrow()
        patterns = spark.sparkContext.broadcast(Patterns(held.column(0).to_pylist(), held.column(1).to_pylist(), window))
        schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("found", T.ArrayType(T.StringType()))])
        out = given.mapInArrow(_scan(patterns, len(carry)), schema)
    else:
        out = _by_join(spark, given, wanted, fields, window)
    return out.toDF(*carry, "__n_words", "__n_hit", "__items")


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark window."""
    return contamination(spark, docs, items, docs.columns).where("__n_hit = 0").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(spark, documents(spark, sf_dir), items, ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = f"""
WITH abc AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents, abc
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark, abc
), pat AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS m, array_to_string(w[p:p + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT m FROM pat
), win AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m)
), occ AS (
  SELECT rid, item, p, m FROM win JOIN pat USING (m, g)
), hits AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM occ) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM occ GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)
"""
