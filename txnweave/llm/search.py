"""Ranked lexical search: best-first document intervals over range-maximum tables.

A document's score for a query is a sum of term impacts (the contract's integer
form of a length-normalised term weight). The documents are indexed once, by the
terms of the queries: (id, length, term numbers, counts) of every row, written to
the shared folder. Sums over the index give the number of documents, their length
and each term's document frequency.

The index is then searched in blocks of about ``BLOCK`` postings, documents of a
block in the order of their ids. Each posting list has a sparse table of the
places of its range maxima, so the largest impact of a term within any interval
of documents is two look-ups. The sum of these maxima over a query's terms bounds
every score in the interval. The search starts with the whole block and takes the
intervals with the highest bounds first: the document of the largest single
impact is scored exactly and splits its interval in two; intervals whose bound
cannot reach the k-th score found so far are dropped, and those of few documents
are scored as they are. The k-th score of a task's earlier blocks is where the
next block starts. A task gives at most k rows a query; a window keeps the k best.

Queries are searched in groups: equal texts are one query, and a group holds about
``GROUP_BYTES`` of texts, whose vocabulary and term lists are broadcast. A larger
set of queries is more groups, each over all documents, so nothing that is
broadcast or collected grows beyond that size (or one query's text).

Cost: a task's memory follows the block, not the posting lists: a term that every
document has is one list of each block. No row is shuffled but the k best of each
task.

Defined cases: a null or empty text has no terms and is never found; a query
without terms finds nothing; null document ids come after all others among equal
scores; rows with equal ids, or equal rows, are ranked each by itself; equal query
rows get equal results; empty tables give an empty result; columns other than
those named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, NOT_ALNUM, WordTable, documents, hashed_words, materialize, row_steps, string_parts, word_spans

K = 10
#: Postings of a block, and documents of an interval that is scored as it is.
BLOCK = 1 << 20
LEAF = 16
#: Intervals taken at once: few at first, so that the k-th score rises before many are opened.
FEW, MANY = 16, 1024
#: Bytes of query texts in one group.
GROUP_BYTES = 4_000_000


class Queries:
    """Term lists of a group of texts over one vocabulary."""

    def __init__(self, texts: list[str]):
        numbers: dict[bytes, int] = {}
        terms, times, cuts = [], [], [0]
        for text in texts:
            data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
            raw = data.tobytes()
            s, e, _ = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
            count = Counter(raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))
            terms += [numbers.setdefault(w, len(numbers)) for w in count]
            times += count.values()
            cuts.append(len(terms))
        self.words = WordTable([*numbers])
        self.terms, self.times, self.cuts = np.array(terms, np.int64), np.array(times, np.int64), cuts

    def __len__(self) -> int:
        return len(self.cuts) - 1


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary."""
    offsets = (cuts * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def _index(queries, arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = queries.value.words
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j in row_steps(offsets):
                rows = offsets[i : j + 1]
                found, at = hashed_words(LOWER[data[rows[0] : rows[-1]]], rows - rows[0], NOT_ALNUM, words.find)
                known = np.flatnonzero(found >= 0)
                row = np.searchsorted(at, known, "right") - 1
                pairs, times = np.unique(row * max(len(words), 1) + found[known], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(j - i + 1) * max(len(words), 1))
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), _binary(pairs % max(len(words), 1), cuts), _binary(times, cuts)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit numbers, row offsets) of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), (offsets - offsets[0]) // 4


def _frequencies(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of each term in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_numbers(batch.column(0))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "docs"])

    return run


def weight(n_docs: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs + 1)))


class Block:
    """Posting lists of some documents, with a sparse table of range maxima over each."""

    def __init__(self, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, all_terms: int):
        norm = 100 - 75 + (75 * lengths * n_docs) // all_terms
        impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * norm[doc]))
        order = np.argsort(term, kind="stable")
        self.n, self.doc, self.impact = len(lengths), doc[order].astype(np.int32), impact[order]
        self.key = term[order] * self.n + self.doc
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        longest = int(np.diff(self.starts).max(initial=1))
        self.log = np.frexp(np.arange(longest + 1, dtype=np.float64))[1].astype(np.int8) - 1
        levels = [np.arange(len(doc), dtype=np.int32)]
        for j in range(1, int(self.log[longest]) + 1):
            half, last = 1 << (j - 1), levels[-1]
            other = np.concatenate([last[half:], last[len(last) - half :]])[: len(last)]
            levels.append(np.where(self.impact[last] >= self.impact[other], last, other))
        self.table = np.stack(levels)

    def best(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the maxima of the posting ranges, the maxima; 0 for empty ranges)."""
        some = hi > lo
        a, size = np.where(some, lo, 0), np.where(some, hi - lo, 1)
        j = self.log[size].astype(np.int64)
        left, right = self.table[j, a], self.table[j, a + size - (1 << j)]
        x, y = self.impact[left], self.impact[right]
        return np.where(x >= y, left, right), np.where(some, np.maximum(x, y), 0)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The k best (score, document) of at least ``least``, highest first, equal ones by document."""
        here = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[here], times[here]
        if not len(terms):
            return []
        top: list[tuple[int, int]] = []  # (-score, document)
        base = terms * self.n
        many = max(MANY * 32 // len(terms), FEW)

        def hopeful(bound: np.ndarray, first: np.ndarray) -> np.ndarray:
            ok = bound >= max(least, 1)
            if len(top) == k:
                score, doc = -top[-1][0], top[-1][1]
                ok &= (bound > score) | ((bound == score) & (first < doc))
            return ok

        def keep(scores: np.ndarray, docs: np.ndarray) -> None:
            ok = hopeful(scores, docs)
            if ok.any():
                top.extend(zip((-scores[ok]).tolist(), docs[ok].tolist(), strict=True))
                top.sort()
                del top[k:]

        def opened(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
            """Intervals with their bounds and the documents that split them; small ones are scored."""
            place, most = self.best(lo, hi)
            most = most * times
            bound = most.sum(1)
            ok = hopeful(bound, first)
            leaf = ok & (last - first <= LEAF)
            if leaf.any():
                self._score(lo[leaf], hi[leaf], times, keep)
                ok = hopeful(bound, first) & ~leaf
            split = self.doc[place[np.arange(len(place)), most.argmax(1)]]
            return bound[ok], first[ok], last[ok], split[ok].astype(np.int64), lo[ok], hi[ok]

        pool = opened(np.array([0]), np.array([self.n]), self.starts[terms][None, :], self.starts[terms + 1][None, :])
        take = FEW
        while len(pool[0]):
            order = np.lexsort((pool[1], -pool[0]))
            chosen, rest = order[:take], order[take:]
            bound, first, last, split, lo, hi = (x[chosen] for x in pool)
            at = np.searchsorted(self.key, base[None, :] + split[:, None])
            there = (at < hi) & (at >= lo)
            there &= self.key[np.minimum(at, len(self.key) - 1)] == base[None, :] + split[:, None]
            scores = (np.where(there, self.impact[np.minimum(at, len(self.key) - 1)], 0) * times).sum(1)
            keep(scores, split)
            new = opened(np.concatenate([first, split + 1]), np.concatenate([split, last]), np.concatenate([lo, at + there]), np.concatenate([at, hi]))
            pool = tuple(np.concatenate([x[rest], y]) for x, y in zip(pool, new, strict=True))
            ok = hopeful(pool[0], pool[1])
            if not ok.all():
                pool = tuple(x[ok] for x in pool)
            take = min(take * 4, many)
        return [(-s, d) for s, d in top]

    def _score(self, lo: np.ndarray, hi: np.ndarray, times: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """All documents of some intervals, from their postings."""
        size = (hi - lo).ravel()
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(lo.ravel() - ends + size, size)
        docs, inverse = np.unique(self.doc[at], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, inverse, self.impact[at] * np.repeat(np.tile(times, len(lo)), size))
        keep(scores, docs.astype(np.int64))


def _search(queries, weights, n_docs: int, all_terms: int, k: int, arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = queries.value, weights.value
        best: dict[int, pa.Table] = {}
        least = [1] * len(q)

        def block(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column(0), null_placement="at_end"))
            term, cuts = _numbers(table.column(2))
            times, _ = _numbers(table.column(3))
            if not len(term):
                return
            one = Block(table.column(1).to_numpy(), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), term, times, w, n_docs, all_terms)
            for i in range(len(q)):
                some = slice(q.cuts[i], q.cuts[i + 1])
                found = one.search(q.terms[some], q.times[some], k, least[i])
                if found:
                    scores, docs = zip(*found, strict=True)
                    new = pa.table([pa.array([i] * len(found), pa.int32()), table.column(0).take(pa.array(docs)), pa.array(scores, pa.int64())], schema=arrow)
                    if i in best:
                        new = pa.concat_tables([best[i], new])
                        new = new.take(pc.sort_indices(new, [("score", "descending"), ("doc", "ascending")], null_placement="at_end")[:k])
                    best[i] = new
                    if new.num_rows == k:
                        least[i] = new.column(2)[k - 1].as_py()

        held, size = [], 0
        for batch in batches:
            sizes = np.diff(_numbers(batch.column(2))[1])
            start = 0
            for i, total in enumerate(np.cumsum(sizes).tolist()):
                if size + total >= BLOCK:
                    held.append(batch.slice(start, i + 1 - start))
                    block(held)
                    held, size, start = [], -total, i + 1
            held.append(batch.slice(start))
            size += int(sizes.sum())
        if held:
            block(held)
        for table in best.values():
            yield from table.to_batches()

    return run


def _best(df: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(spark: SparkSession, docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(text, doc, score, rank) of the texts' k best documents. docs: (doc, text)."""
    q = Queries(texts)
    shared = spark.sparkContext.broadcast(q)
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType())])
    index = materialize(spark, docs.mapInArrow(_index(shared, to_arrow_schema(schema)), schema), "search-index")
    size = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    counts = index.select("terms").mapInArrow(_frequencies(len(q.words)), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()  # at most the group's vocabulary
    weights = np.zeros(len(q.words), np.int64)
    weights[counts.column(0).to_numpy()] = [weight(size["docs"], n) for n in counts.column(1).to_pylist()]
    out = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    found = index.mapInArrow(_search(shared, spark.sparkContext.broadcast(weights), size["docs"], max(size["terms"] or 0, 1), k, to_arrow_schema(out)), out)
    named = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    return _best(found, "q", k).join(named, "q").select("text", "doc", "score", "rank")


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank, document id, score): each query's k best documents with a score above 0."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    asked = queries.select(F.col(query_id).alias("__q"), F.col(query_text).alias("text"))
    distinct = materialize(spark, asked.where("text IS NOT NULL").select("text").distinct(), "search-queries")
    held = distinct.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    groups = held // GROUP_BYTES + 1
    out = None
    for i in range(groups):
        mine = distinct.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == i) if groups > 1 else distinct
        texts = mine.toArrow().column(0).to_pylist()  # about GROUP_BYTES
        if texts:
            part = _group(spark, given, texts, k)
            part = materialize(spark, part, "search-found") if groups > 1 else part
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("text", T.StringType()), T.StructField("doc", given.schema["doc"].dataType), T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    return asked.join(out, "text").select(F.col("__q").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = f"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents, abc),
b AS (SELECT row_number() OVER () AS qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark, abc),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
tf AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM b) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
i AS (SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms))) AS impact FROM tf JOIN df USING (t), s),
r AS (SELECT qid, item_id, rid, doc_id, sum(impact)::BIGINT AS score FROM b JOIN i USING (t) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {K}
"""
