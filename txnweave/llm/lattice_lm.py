"""Language-model scores by the likelihood of the subword lattice.

The vocabulary is an existing one (pieces of a sentencepiece file with
scores); bytes are a last resort. A word is the sum over all its segmentations, by a
forward recursion in log space over its bytes, and a stop; a text is the product of its
words and an end. So the score is the log of the marginal probability of the text, not
of its best segmentation.

A word of the training documents is one more edge of its own lattice, from its first byte to
its last. With M tokens, V distinct words and c times the word, that edge weighs (c - d) / M and
the way through the pieces d V / M (absolute discounting; d by the numbers of words
seen once and twice). So the distribution stays a proper one over all words there can be.

Learning: words of the training documents are counted. The file's scores (ranks) give the first
weights of the pieces; an expectation step over the lattices of all distinct words, each
once, gives expected counts of pieces, and these the weights: what the pieces must
explain is new words, so a word counts as often as it is new. Steps go on until one
gains less than ``LEAST_GAIN`` of the log likelihood of a word. The base score
(add-one word unigrams) uses the same counts.

How it runs: the word table is a table in the shared folder and stays distributed.
The ``HEAD`` most frequent words (a fixed number, found by a histogram of counts)
with counts and scores are broadcast, and looked up by hash and then byte by byte; each task sums up what it finds there for
its documents and writes the other words as (row, word, times, log likelihood) rows, which join
with the word table. Nothing that grows with the corpus goes through the driver.

Defined cases: null and empty texts are the end alone; a null id counts as the
text '' when documents are divided; repeated rows count as often as they occur; with
no training documents N is 0, V is 0, weights stay those of the file and pieces explain all words; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, WordTable, distinct_spans, documents, materialize, padded, row_steps, same_spans, small_batches, string_parts, word_spans

VOCABULARY = "piece_bpe_32k.model"
#: Words whose counts and scores are broadcast, and the longest of them in bytes.
HEAD, HEAD_BYTES = 1_000_000, 64
#: Expectation steps end with one that gains less than this share of the log likelihood of a word; a bound for their number.
LEAST_GAIN, MOST_ROUNDS = 0.005, 20
#: First probability of a word's stop.
FIRST_STOP = 0.25
#: Words longer than this many bytes take the recursion that goes word by word.
LONG = 192
_B = np.uint64(0x9E3779B97F4A7C15)
_LN10 = math.log(10)


def crc_bucket(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7))


# --- the vocabulary and the lattice -----------------------------------------


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading blank marks a word's start; the 256 bytes follow) and first log weights."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        # The scores of this file are negative ranks: weights fall off as one over the rank.
        pieces.setdefault(raw, -math.log(2.0 - model.get_score(i)))
    names = [*pieces]
    first = np.array([*pieces.values(), *[min(pieces.values()) - 5.0] * 256])
    return names, first - np.logaddexp.reduce(first)


class Lattice:
    """Piece lookup by hash, then byte by byte; log weights by piece. The last weight is the stop's."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces, self.weights = pieces, weights
        self.longest = max(map(len, pieces))
        self.by_name = {x: i for i, x in enumerate(pieces)}
        self.data = padded(np.frombuffer(b"".join(pieces), np.uint8))
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = np.array([self._hash(x) for x in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order
        self.bits = np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys * _B) >> self.bits] = True

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for b in x:
            h = (h * int(_B) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _find(self, h: np.ndarray, data: np.ndarray, end: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of ``step`` bytes each in padded data: (row of h, word, piece) where the bytes before ``end`` are a piece. h: hashes, a row for each length, longest first."""
        row, word = np.nonzero(self.maybe[(h * _B) >> self.bits])
        found = h[row, word]
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        piece = self.numbers[at]
        ok = np.flatnonzero((self.keys[at] == found) & (self.sizes[piece] == len(h) - row))
        row, word, piece = row[ok], word[ok], piece[ok]
        size = len(h) - row
        ok = same_spans(data, word * step + end - size, self.data, self.starts[piece], size)
        return row[ok], word[ok], piece[ok]

    def run(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word, expected counts of the pieces if counts are given)."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.weights))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > LONG:
                for i in at:
                    out[i] = self._one(b" " + words[i], None if counts is None else counts[i], expected)
                continue
            for part in np.array_split(at, max(1, len(at) * int(size) // 400_000)):
                if not len(part):
                    continue
                m = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), size)
                out[part] = self._many(m, None if counts is None else counts[part], expected)
        return out, expected

    def _many(self, m: np.ndarray, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        n, size = m.shape
        flat = padded(m.reshape(-1))
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _B + m[:, i] + np.uint64(1)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _B, np.uint64)]))
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        base = len(self.pieces)
        edges = []
        for i in range(1, size + 1):
            byte = base + m[:, i - 1].astype(np.int64)
            reach = min(i, self.longest)
            row, word, piece = self._find(prefix[i] - prefix[i - reach : i] * powers[reach:0:-1, None], flat, i, size)
            start = row + (i - reach)
            ways = np.full((reach + 1, n), -np.inf)
            ways[reach] = alpha[i - 1] + self.weights[byte]
            ways[row, word] = alpha[start, word] + self.weights[piece]
            top = ways.max(0)
            alpha[i] = top + np.log(np.exp(ways - top).sum(0))
            if counts is not None:
                edges += [(i, start, word, piece), (i, np.full(n, i - 1), np.arange(n), byte)]
        if counts is not None:
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0
            shares = []
            for i, start, word, piece in reversed(edges):  # no start of a word twice in one step
                through = beta[i, word] + self.weights[piece]
                beta[start, word] = np.logaddexp(beta[start, word], through)
                shares.append(np.exp(alpha[start, word] + through - alpha[size, word]) * counts[word])
            expected += np.bincount(np.concatenate([piece for *_, piece in reversed(edges)]), np.concatenate(shares), len(expected))
        return alpha[size]

    def _one(self, word: bytes, count: float | None, expected: np.ndarray) -> float:
        n, base, get, w = len(word), len(self.pieces), self.by_name.get, self.weights
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        into: list[list[tuple[int, int]]] = [[]]
        for i in range(1, n + 1):
            ways = [(i - 1, base + word[i - 1])]
            for k in range(1, min(i, self.longest) + 1):
                piece = get(word[i - k : i])
                if piece is not None:
                    ways.append((i - k, piece))
            into.append(ways)
            parts = [alpha[a] + w[p] for a, p in ways]
            top = max(parts)
            alpha[i] = top + math.log(sum(math.exp(x - top) for x in parts))
        if count is not None:
            beta = [-math.inf] * (n + 1)
            beta[n] = 0.0
            for i in range(n, 0, -1):
                for a, p in into[i]:
                    through = beta[i] + w[p]
                    high, low = max(beta[a], through), min(beta[a], through)
                    beta[a] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
                    expected[p] += count * math.exp(alpha[a] + through - alpha[n])
        return alpha[n]


@lru_cache(maxsize=2)
def _lattice(pieces: tuple[bytes, ...], weights: bytes) -> Lattice:
    return Lattice(list(pieces), np.frombuffer(weights))


def _local_lattice(model: Broadcast) -> Lattice:
    return _lattice(*model.value)


def share_model(spark: SparkSession, pieces: list[bytes], weights: np.ndarray) -> Broadcast:
    """Bounded by the vocabulary's size."""
    return spark.sparkContext.broadcast((tuple(pieces), weights.tobytes()))


# --- learning ---------------------------------------------------------------


def _unique_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words before each row, number of each token's word, start and end of each distinct word) of lower-cased rows."""
    s, e, at = word_spans(data, offsets, BLANKS)
    _, first, inverse = distinct_spans(data, s, e)
    return at, inverse, s[first], e[first]


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_parts(batch.column(0))
        for i, j in row_steps(offsets, 4 << 20):
            part = LOWER[data[offsets[i] : offsets[j]]]
            _, token, s, e = _unique_words(part, offsets[i : j + 1] - offsets[i])
            yield pa.record_batch([pa.array(_texts(part, s, e), pa.binary()), pa.array(np.bincount(token, minlength=len(s)), pa.int64())], names=["word", "c"])


def count_words(spark: SparkSession, training: DataFrame, text_col: str) -> DataFrame:
    """(word, c): the word table."""
    counted = training.select(text_col).mapInArrow(_count, "word binary, c long")
    return materialize(spark, counted.groupBy("word").agg(F.sum("c").alias("c")), "words")


def _expect(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _local_lattice(model)
        total, likely = np.zeros(len(lattice.weights)), 0.0
        for batch in batches:
            values, expected = lattice.run(batch.column(0).to_pylist(), np.ones(batch.num_rows))
            total += expected
            likely += values.sum()
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[used], likely), pa.float64())], names=["piece", "n"])

    return run


def learn_weights(spark: SparkSession, words: DataFrame, pieces: list[bytes], weights: np.ndarray, distinct: int, rounds: int | None = None) -> np.ndarray:
    """Log weights of pieces, bytes and the stop after expectation steps over all distinct words: ``rounds``, or as many as gain something."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    last = -math.inf
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        model = share_model(spark, pieces, weights)
        sums = words.select("word").mapInArrow(_expect(model), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        got, likely = np.zeros(len(pieces) + 256), 0.0
        for row in sums.collect():  # one row for each piece of the vocabulary at most
            if row["piece"] < 0:
                likely = row["n"] / distinct + weights[-1]
            else:
                got[row["piece"]] = row["n"]
        smooth = np.append(got, distinct) + 0.01
        # Rounded, so that the order in which tasks are summed up seldom shows.
        weights = np.round(np.log(smooth) - math.log(smooth.sum()), 9)
        if rounds is None and likely - last < LEAST_GAIN * abs(likely):
            break
        last = likely
    small_batches(spark)
    return weights


@dataclass(frozen=True)
class Mixture:
    """How known words and pieces share a word's probability: (c - discount) / tokens and, for the way through the pieces, exp(``through``)."""

    discount: float
    tokens: int
    through: float

    @classmethod
    def of(cls, tokens: int, distinct: int, once: int, twice: int) -> Mixture:
        if not tokens:
            return cls(0.0, 1, 0.0)
        discount = (once + 0.5) / (once + 2 * twice + 1)
        return cls(discount, tokens, math.log(discount * distinct / tokens))

    def known(self, counts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Log probabilities of words by their counts and their log probabilities through the pieces."""
        return np.logaddexp(np.log((counts - self.discount) / self.tokens), self.through + pieces)

    def column(self, count: Column, pieces: Column) -> Column:
        """The same as an expression; a word without a count is a new one."""
        both = F.log((count - F.lit(self.discount)) / F.lit(float(self.tokens)) + F.exp(pieces + F.lit(self.through)))
        return F.when(count.isNull(), pieces + F.lit(self.through)).otherwise(both)


def _score_words(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _local_lattice(model)
        for batch in batches:
            likely = lattice.run(batch.column(0).to_pylist())[0] + lattice.weights[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(likely)], names=["word", "c", "likely"])

    return run


def head_words(spark: SparkSession, words: DataFrame, model: Broadcast, mixture: Mixture, limit: int) -> Broadcast:
    """(table, counts, log likelihoods) of the most frequent words, at most ``limit`` of at most HEAD_BYTES bytes each."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("c") * 4).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for x, n in sizes:  # some hundred levels at most
        total += n
        if total > limit:
            break
        least = x
    if least is None:
        return spark.sparkContext.broadcast((WordTable([]), np.zeros(0, np.int64), np.zeros(0)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    rows = short.where(level >= least).select("word", "c").mapInArrow(_score_words(model), "word binary, c long, likely double").toArrow()
    small_batches(spark)
    counts = rows.column("c").to_numpy()
    return spark.sparkContext.broadcast((WordTable(rows.column("word").to_pylist()), counts, mixture.known(counts, rows.column("likely").to_numpy())))


# --- scoring ----------------------------------------------------------------


def _score(model: Broadcast, head: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _local_lattice(model)
        table, counts, likely = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j in row_steps(offsets):
                part = LOWER[data[offsets[i] : offsets[j]]]
                at, token, s, e = _unique_words(part, offsets[i : j + 1] - offsets[i])
                n = j - i
                rows = np.arange(row, row + n)
                row += n
                place = table.find(part, s, e)
                known = place >= 0
                log_c = np.zeros(len(s))
                value = np.zeros(len(s))
                log_c[known] = np.log10(counts[place[known]] + 1.0)
                value[known] = likely[place[known]]
                rest = np.flatnonzero(~known)
                others = dict(zip(rest.tolist(), _texts(part, s[rest], e[rest]), strict=True))
                pieces = np.zeros(len(s))
                pieces[rest] = lattice.run([*others.values()])[0] + lattice.weights[-1]
                sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])  # noqa: E731, B023
                of = np.repeat(np.arange(n), np.diff(at))
                loose = ~known[token]
                _, first, times = np.unique(of[loose] * len(s) + token[loose], return_index=True, return_counts=True) if loose.any() else (None, np.zeros(0, int), np.zeros(0, int))
                whose, which = of[loose][first], token[loose][first]
                nothing = pa.nulls(len(whose), batch.column(0).type)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([rows, rows[whose]]), pa.int64()),
                        pa.concat_arrays([batch.column(0).slice(i, n), nothing]),
                        pa.array([*np.diff(at).tolist(), *[None] * len(whose)], pa.int64()),
                        pa.array(np.concatenate([sums(known[token].astype(float)), np.zeros(len(whose))]).astype(np.int64)),
                        pa.array(np.concatenate([sums(log_c[token]), np.zeros(len(whose))])),
                        pa.array(np.concatenate([sums(value[token]), pieces[which]])),
                        pa.array([*[None] * n, *[others[x] for x in which.tolist()]], pa.binary()),
                        pa.array([*[0] * n, *times.tolist()], pa.int64()),
                    ],
                    names=["row", "doc_id", "n", "known", "log_c", "likely", "word", "times"],
                )

    return run


def score_documents(spark: SparkSession, docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, head: int = HEAD, em_rounds: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs."""
    small_batches(spark)
    pieces, first = read_pieces(path or public_tokenizers.path(VOCABULARY))
    learnt = docs.where(training)
    words = count_words(spark, learnt, text_col)
    n_ends = learnt.count()
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n_all, n_distinct = size["n"] + n_ends, size["v"] + (n_ends > 0)
    mixture = Mixture.of(size["n"], size["v"], size["once"], size["twice"])
    end = math.log((n_ends + 1) / (n_all + 2))
    weights = np.append(first + math.log(1 - FIRST_STOP), math.log(FIRST_STOP))
    if size["v"]:
        weights = learn_weights(spark, words, pieces, weights, size["v"], em_rounds)
    model = share_model(spark, pieces, weights)
    top = head_words(spark, words, model, mixture, head)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n long, known long, log_c double, likely double, word binary, times long"
    sums = materialize(spark, given.mapInArrow(_score(model, top), schema), "lm-sums")
    # Words outside the broadcast table, joined with the whole table; those that are not there are new.
    loose = sums.where("word IS NOT NULL").select("row", "word", "times", F.col("likely").alias("pieces")).join(words.select("word", "c"), "word", "left")
    rest = loose.groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0))).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * mixture.column(F.col("c"), F.col("pieces"))).alias("more_likely"),
    )
    out = sums.where("word IS NULL").drop("word", "times").join(rest, "row", "left")
    unit = math.log10(n_all + n_distinct + 1) if n_all else 0.0
    return out.select(
        "doc_id",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.coalesce("more", F.lit(0.0)) + F.lit(math.log10(n_ends + 1)) - (F.col("n") + 1) * F.lit(unit)).alias("base_score"),
        ((F.col("likely") + F.coalesce("more_likely", F.lit(0.0)) + F.col("n") * F.lit(math.log1p(-math.exp(end))) + F.lit(end)) / _LN10).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id") == 2
    out = score_documents(spark, documents(spark, sf_dir).select("doc_id", "text"), ~held)
    return out.withColumn("held_out", held)
