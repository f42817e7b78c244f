"""MinHash near-dedup: one-permutation hashing, optimal densification, banded
buckets, star-shaped candidate edges, exact confirmation on full sets.

* A document's set is its distinct word shingles (``shingle`` words, 64-bit hashes).
* One pass over the set fills ``BINS`` bins: the hash's high bits choose the bin,
  the least hash in it is the bin's value. An empty bin copies the filled bin
  that a fixed random sequence of the bin's own reaches first.
* ``BANDS`` bands of ``ROWS`` bins hash to buckets. Equal sets collapse to one
  class first, so exact copies cost one member.
* A bucket gives a star, every member linked with one centre: n - 1 edges,
  never n * n. The centre is the member whose buckets are largest, in a cloud of
  near copies the one closest to most. An edge counts only if the full sets have the asked similarity.
* Rounds: first each class confirms its most frequent centre, then all centres
  that would join different components. A link may remain whose ends both
  failed against their centre. So buckets whose members still lie in
  several components get further stars (the next centre in order), and those of at most
  ``SMALL`` members all their open pairs (fewer than ``SMALL`` a member), until a
  round confirms nothing. Every round is linear in the members.
* What is still open in larger buckets is settled by a prefix filter: shingles in one
  order for all, those of one component alone first, then rare ones. The first common
  shingle of two similar sets stands so early in both that enough is left behind it. All
  pairs of different components with such a shingle are compared, so no link is left out.
* Components come from least-label propagation with pointer jumping over the
  confirmed edges, each step a join and a partial aggregation, cut by a written table;
  later rounds only join components.

A pair at similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^8)^64,
more than 0.99999, and more above it.

Texts are never gathered by group: confirmation deals (centre, block of
members) to tasks, and a task holds one centre's set at a time.

Defined cases: null and empty texts have an empty set (n_shingles 0) and are
linked with nothing; a text with fewer words than a shingle is one shingle;
repeated rows are exact copies and share a component; kept is true for every
row that has the least id, so repeated rows of it stay together; rows with a null id take
part, and a component of null ids alone has the null id; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, documents, hashed_words, materialize, mix, row_steps, small_batches, string_parts

BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
#: Attempts of the random sequence before the next filled bin in circular order is taken.
ATTEMPTS = 256
#: Buckets of so many members have all their open pairs compared.
SMALL = 48
#: Shingles of a table that is broadcast (16 bytes each).
TABLE = 1_000_000
#: Members that are compared with one copy of their centre.
BLOCK = 64

_rng = np.random.default_rng(20240229)
_DONORS = _rng.integers(0, BINS, (ATTEMPTS, BINS))
_BAND_MULTIPLIERS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_SHINGLE_MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, at = hashed_words(LOWER[data], offsets, BLANKS)
    n = len(words)
    rolled = np.zeros(0, np.uint64)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : n - k + 1 + j] * _SHINGLE_MULTIPLIERS[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * _SHINGLE_MULTIPLIERS[32 : 32 + b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.full(1, b - a, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set; sets must not be empty."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for i, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)
        first = np.ones(len(s), bool)
        first[1:] = bins[1:] != bins[:-1]
        sig[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    rows, cols = np.nonzero(~filled)
    for t in range(ATTEMPTS):
        if not len(rows):
            break
        donors = _DONORS[t, cols]
        ok = filled[rows, donors]
        sig[rows[ok], cols[ok]] = sig[rows[ok], donors[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for i, c in zip(rows, cols, strict=True):
        have = np.flatnonzero(filled[i])
        sig[i, c] = sig[i, have[np.searchsorted(have, _DONORS[0, c]) % len(have)]]
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        h += mix(parts[:, :, j]) * _BAND_MULTIPLIERS[:, j]
    return mix(h + _BAND_SALT).view(np.int64)


def set_class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for i, j in row_steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                full = [x for x in sets if len(x)]
                bands = band_hashes(signatures(full)) if full else np.zeros((0, BANDS), np.int64)
                has = np.array([len(x) > 0 for x in sets], bool)
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_class(x) if len(x) else None for x in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1))),
                    ],
                    names=["doc_id", "digest", "n", "cid", "bands"],
                )

    return run


def _confirm(k: int, percent: int):
    """Rows (centre, block, kind, other, text), centres (kind 0) first in each block -> confirmed and failed edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            data, offsets = string_parts(batch.column(4))
            names = [batch.column(c).to_pylist() for c in range(4)]
            edges = []
            for i, j in row_steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                for r, s in zip(range(i, j), sets, strict=True):
                    c, block, kind, other = (x[r] for x in names)
                    if kind == 0:
                        key, centre = (c, block), s
                    elif key == (c, block):
                        both = len(centre) + len(s)
                        at = np.searchsorted(centre, s)
                        at[at == len(centre)] = 0
                        common = int(np.count_nonzero(centre[at] == s)) if len(centre) else 0
                        edges.append((other, c, 100 * common >= percent * (both - common)))
            if edges:
                a, b, ok = zip(*edges, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def confirm_edges(spark: SparkSession, texts: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, ok) for each edge (a, b). texts: (cid, text), one row for each class."""
    sizes = edges.groupBy("b").agg(F.count("*").alias("m"))
    members = edges.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / BLOCK)).alias("block"))
    members = members.join(texts, F.col("a") == F.col("cid")).select(F.col("b").alias("c"), "block", F.lit(1).alias("kind"), F.col("a").alias("other"), "text")
    blocks = sizes.join(texts, F.col("b") == F.col("cid")).select(
        F.col("b").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / BLOCK) - 1)).alias("block"), F.lit(0).alias("kind"), F.col("b").alias("other"), "text"
    )
    rows = members.unionByName(blocks).repartition("c", "block").sortWithinPartitions("c", "block", "kind")
    return materialize(spark, rows.mapInArrow(_confirm(k, percent), "a long, b long, ok boolean"), "edges")


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that edges (a, b) reach. Every node of an edge must be in nodes."""
    both = materialize(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = materialize(spark, nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", "least").alias("next"))
        hooked = materialize(spark, hooked, "labels")
        jump = hooked.select(F.col("node").alias("up"), F.col("next").alias("root"))
        labels = materialize(spark, hooked.join(jump, F.col("next") == F.col("up")).select("node", "comp", F.least("next", "root").alias("next")), "labels")
        changed = labels.where(F.col("next") != F.col("comp")).limit(1).count()
        labels = labels.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    return _groups(spark, docs, id_col, text_col, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """As near_duplicates; adds digest, which tells rows of one id apart, and first: the row (or its repeats) with the group's least id and digest."""
    small_batches(spark)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    kind = given.schema["doc_id"].dataType.simpleString()
    feats = given.mapInArrow(_features(shingle), f"doc_id {kind}, digest long, n long, cid long, bands array<long>")
    feats = materialize(spark, feats, "minhash")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = feats.where("n > 0").groupBy("cid").agg(F.min(row).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # One member for each class; what is needed of the texts comes by the class's least row.
    classes = materialize(spark, classes, "classes")
    slots = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    slots = materialize(spark, slots.join(shared, "bucket").select("bucket", "cid", "n", "m"), "buckets")
    weights = slots.groupBy("cid").agg(F.sum("m").alias("weight"))
    slots = materialize(spark, slots.join(weights, "cid").select("bucket", "cid", "n", "m", F.struct("weight", "cid").alias("place")), "slots")
    nodes = slots.groupBy(F.col("cid").alias("node")).agg(F.first("cid").alias("comp"))
    labels = materialize(spark, nodes, "labels")
    wanted = classes.join(labels, F.col("cid") == F.col("node"), "left_semi").select("cid", F.col("rep.doc_id").alias("__rep"), F.col("rep.digest").alias("__digest"))
    texts = _own_text(spark, given.join(wanted, F.col("doc_id").eqNullSafe(F.col("__rep")) & (F.col("digest") == F.col("__digest"))), shingle)

    centres = materialize(spark, slots.groupBy("bucket").agg(F.max("place").alias("centre")), "centres")
    stars = slots.join(centres, "bucket").where("place < centre").groupBy(F.col("cid").alias("a"), F.col("centre.cid").alias("b")).agg(F.count("*").alias("votes"))
    stars = materialize(spark, stars, "stars")
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    tried = confirm_edges(spark, texts, best, shingle, percent)
    labels, _ = _merge(spark, labels, tried)
    edges, turn = stars.select("a", "b"), 0
    while True:
        mixed = _mixed(spark, slots, labels)
        prior = mixed.join(centres, "bucket").where("place < centre")
        centres = materialize(spark, prior.groupBy("bucket").agg(F.max("place").alias("centre")), "centres")
        again = mixed.join(centres, "bucket").where("place < centre").select(F.col("cid").alias("a"), F.col("centre.cid").alias("b"))
        edges = again if edges is None else edges.union(again)
        if turn == 1:
            edges = edges.union(_small_pairs(mixed, percent))
        apart = _apart(edges.distinct(), labels).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        apart = materialize(spark, apart, "open")
        found = False
        if apart.limit(1).count():
            checked = confirm_edges(spark, texts, apart, shingle, percent)
            labels, found = _merge(spark, labels, checked)
            tried = tried.unionByName(checked)
        edges, turn = None, turn + 1
        if not found and turn >= 2:
            break
    pairs = _prefix_pairs(spark, texts, _mixed(spark, slots, labels), shingle, percent)
    known = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    apart = materialize(spark, pairs.join(known, ["a", "b"], "left_anti"), "open")
    if apart.limit(1).count():
        labels, _ = _merge(spark, labels, confirm_edges(spark, texts, apart, shingle, percent))

    reach = classes.select("cid", "rep").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("comp", "cid").alias("comp"))
    least = reach.groupBy("comp").agg(F.min("rep").alias("least"))
    ids = reach.join(least, "comp").select("cid", F.col("least.doc_id").alias("component_id"), F.col("least.digest").alias("least_digest"))
    out = feats.select("doc_id", "digest", "n", "cid").join(ids, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    first = kept & ((F.col("n") == 0) | (F.col("digest") == F.col("least_digest")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "digest", first.alias("first"))


def _own_text(spark: SparkSession, texts: DataFrame, k: int) -> DataFrame:
    """(cid, text), once for each class: rows that share id and digest with the class's own text by chance are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            mine, keep = batch.column(0).to_pylist(), []
            for i, j in row_steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                keep += [len(s) > 0 and set_class(s) == c for s, c in zip(sets, mine[i:j], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    own = texts.select("cid", "text").mapInArrow(run, "cid long, text string")
    return materialize(spark, own.dropDuplicates(["cid"]), "class-texts")


def _apart(edges: DataFrame, labels: DataFrame) -> DataFrame:
    la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return edges.join(la, "a").join(lb, "b").where("ca != cb").select("a", "b")


def _merge(spark: SparkSession, labels: DataFrame, checked: DataFrame) -> tuple[DataFrame, bool]:
    """Labels with the components that confirmed edges join, and whether there were any."""
    la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joins = checked.where("ok").join(la, "a").join(lb, "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joins = materialize(spark, joins, "joins")
    if not joins.limit(1).count():
        return labels, False
    nodes = joins.select(F.col("a").alias("node")).union(joins.select("b")).distinct()
    merged = components(spark, nodes, joins).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    out = labels.join(merged, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return materialize(spark, out, "labels"), True


def _mixed(spark: SparkSession, slots: DataFrame, labels: DataFrame) -> DataFrame:
    """The slots, with components, of buckets whose members lie in several components."""
    held = slots.join(labels, F.col("cid") == F.col("node")).select("bucket", "cid", "n", "m", "place", "comp")
    open_ = held.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    return materialize(spark, held.join(open_, "bucket"), "mixed")


def _small_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """The open pairs of buckets of at most SMALL members, sizes within the similarity's ratio."""
    small = mixed.where(F.col("m") <= SMALL)
    x = small.select("bucket", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = small.select("bucket", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    near = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return x.join(y, "bucket").where(near).select("a", "b")


def _shingles(k: int):
    """Rows (cid, n, comp, text) -> (cid, n, comp, token), one for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(3))
            for i, j in row_steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                row = pa.array(np.repeat(np.arange(i, j), [len(s) for s in sets]))
                yield pa.record_batch([*[batch.column(c).take(row) for c in range(3)], pa.array(np.concatenate(sets).view(np.int64))], names=["cid", "n", "comp", "token"])

    return run


def _ranked(table: Broadcast, k: int, percent: int):
    """Rows (cid, n, comp, text) -> (token, cid, n, comp, rest): the prefix of each set, by a table of shared shingles and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        for batch in batches:
            data, offsets = string_parts(batch.column(3))
            for i, j in row_steps(offsets):
                tokens, rests, rows = [], [], []
                for r, s in zip(range(i, j), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k), strict=True):
                    own = s.view(np.int64)
                    at = np.searchsorted(keys, own)
                    at[at == len(keys)] = 0
                    hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                    own, f = own[hit], counts[at[hit]]
                    own = own[np.lexsort((own, f))]
                    rest = len(own) - np.arange(len(own))
                    own, rest = own[100 * rest >= percent * len(s)], rest[100 * rest >= percent * len(s)]
                    tokens.append(own)
                    rests.append(rest)
                    rows.append(np.full(len(own), r))
                row = pa.array(np.concatenate(rows))
                yield pa.record_batch([pa.array(np.concatenate(tokens)), *[batch.column(c).take(row) for c in range(3)], pa.array(np.concatenate(rests))], names=["token", "cid", "n", "comp", "rest"])

    return run


def _prefixes(spark: SparkSession, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, cid, n, comp, rest): the shingles of each set behind which enough are left for the similarity, and how many.

    Shingles of one component alone come first (they are in no open pair), then the others, rare ones before
    frequent ones. At most TABLE shared shingles are a table that is broadcast; more are joined.
    """
    tokens = texts.mapInArrow(_shingles(k), "cid long, n long, comp long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token", "f")
    shared = materialize(spark, shared, "shared-shingles")
    if shared.count() <= TABLE:
        held = shared.toArrow()
        keys = held.column(0).to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], held.column(1).to_numpy()[order]))
        ranked = texts.mapInArrow(_ranked(table, k, percent), "token long, cid long, n long, comp long, rest long")
        return materialize(spark, ranked, "prefixes")
    tokens = materialize(spark, tokens, "shingles")
    own = Window.partitionBy("cid")
    before = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "token")) - 1
    rest = tokens.join(shared, "token").select("token", "cid", "n", "comp", (F.col("n") - before).alias("rest"))
    return materialize(spark, rest.where(100 * F.col("rest") >= percent * F.col("n")), "prefixes")


def _prefix_pairs(spark: SparkSession, texts: DataFrame, mixed: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b), a > b: pairs of different components in buckets of more than SMALL members, with each that has the similarity."""
    members = mixed.where(F.col("m") > SMALL).groupBy("cid").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    texts = materialize(spark, texts.join(members, "cid").select("cid", "n", "comp", "text"), "open-texts")
    rest = _prefixes(spark, texts, k, percent)
    parts = rest.groupBy("token", "comp").agg(F.count("*").alias("c"))
    most = parts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("token", "most")
    held = materialize(spark, rest.join(most, "token"), "prefixes")
    # Of an open pair one at least is outside the largest component.
    x = held.where("comp != most").select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("rest").alias("ra"))
    y = held.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("rest").alias("rb"), "most")
    once = (F.col("cb") == F.col("most")) | (F.col("a") > F.col("b"))
    enough = (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    pairs = x.join(y, "token").where((F.col("ca") != F.col("cb")) & once & enough)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that with the least id (then digest of the text; null ids last); of repeated rows of it, one."""
    found = _groups(spark, docs, id_col, text_col, 5, 80)
    gone = materialize(spark, found.where(~F.col("first")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "near-gone")
    repeated = found.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("m")).where("m > 1").select("__id", "__digest")
    repeated = materialize(spark, repeated, "near-repeated")
    row = lambda keys: docs[id_col].eqNullSafe(keys["__id"]) & (_digest(text_col) == keys["__digest"])
    left = docs.join(gone, row(gone), "left_anti")
    once = left.join(repeated, row(repeated), "left_anti")
    # Only rows that come again are compared by their whole texts.
    again = left.join(repeated, row(repeated), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), shingle=4)
