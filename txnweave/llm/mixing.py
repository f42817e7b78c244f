"""Mixing sources to target weights by capped water-filling.

Each source has a weight and holds so many words; the mix takes ``total`` words.
A source's target is its weight's share, but at most ``epochs`` times its words;
what stands above is shared again by weight among the others until none is above.
That fixed point is target = min(cap, level x weight), with one level for all
sources, found by an order of the sources by cap / weight and running sums.

A target of e times a source's words takes each document floor(e) times whole,
and once more the documents that come first in a seeded order, until the words
that are left are taken: the one document at that edge is taken in part. Each
source's words equal its target, rounded to a whole word, and a document is
taken at most ceil(e) times. The order is a digest of seed, document id and size,
so reruns agree whatever the partitions are.

Sizes are counted in one pass over the texts; all else moves (id, source, size).
A source that holds a third of all documents is summed in ranges of that order
(``operators.ranges``), not in one task. Sources are a table of their own, joined
back by name (each has one row); weights may be given as a table, or be dealt to
the sources in the order of their names.

Defined cases: a null or empty text has size 0 and is taken 0 times in words; a
null source is a source of its own, last in the order; a null document id is an
id like others; equal rows are interchangeable; sources of weight 0 get nothing;
if all caps together are below the total, every source is taken at its cap; an
empty table gives an empty result. Other columns are dropped, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranges
from .common import documents, materialize

#: Weights that the sources get in turn, in the order of their names.
WEIGHTS = (3, 1, 2)
#: The mix as a share of all words, and the most that a source may be repeated.
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def dealt_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): the weights in turn by code points of the names, null last."""
    ranked = ranges.global_rank(sources.select("*", F.col("source").isNull().alias("__last")), [F.col("__last"), F.col("source")], "__place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select("source", "source_size", F.element_at(turn, (F.col("__place") - 1).cast("int") % len(weights) + 1).alias("weight"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight): min(epochs x size, level x weight) words.

    In the order of size / weight the sources up to some place are at their caps; the
    level is what they leave, over the weights of the rest. Weights to six decimals.
    """
    micro = F.round(F.col("weight") * 1000000).cast("decimal(20,0)")
    x = sources.select("source", "source_size", F.greatest(micro, F.lit(0).cast("decimal(20,0)")).alias("w"))
    live = x.where("w > 0 AND source_size > 0")
    upto = ranges.prefix_sums(live, [], [F.col("source_size").cast("double") / F.col("w").cast("double"), F.col("source").isNull(), F.col("source")], {"words": F.col("source_size").cast("decimal(20,0)"), "ws": F.col("w")})
    # All words count to the total, those of sources without weight too.
    whole = x.agg(F.sum(F.col("source_size").cast("decimal(20,0)")).cast("double").alias("words"), F.sum(F.when(F.col("source_size") > 0, F.col("w"))).alias("w")).first()
    before, rest = (F.col("words") - F.col("source_size")).cast("double"), (F.lit(whole["w"] or 0).cast("decimal(30,0)") - F.col("ws") + F.col("w")).cast("double")
    level = (F.lit((whole["words"] or 0.0) * share) - before * epochs) / rest  # if all before this source are at their caps and none from it on
    cap, w = F.col("source_size") * F.lit(float(epochs)), F.col("w").cast("double")
    # The first place whose source stays under its cap sets the level for it and all after it; without one, all are at their caps.
    first = upto.select(level.alias("level"), "ws", (level * w <= cap).alias("fits")).where("fits").agg(F.min_by("level", "ws").alias("level")).first()["level"]
    target = cap if first is None else F.least(cap, F.lit(first) * w)
    return x.select("source", "source_size", F.when((F.col("w") > 0) & (F.col("source_size") > 0), target).otherwise(0.0).alias("target"))


def repetitions(sized: DataFrame, targets: DataFrame, epochs: float, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) from (doc_id, source, size) and (source, source_size, target)."""
    named = targets.select(F.col("source").alias("__of"), "source_size", "target")
    # Null-safe on a table of one row a source; adaptive execution splits a source that holds much.
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    summed = ranges.prefix_sums(joined, ["source"], [place, F.col("doc_id")], {"upto": F.col("size")})
    whole = F.floor(F.col("target") / F.col("source_size"))
    left = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.least(F.col("size"), left - (F.col("upto") - F.col("size"))), F.lit(0).cast("long"))
    taken = F.when(F.col("source_size") > 0, F.col("size") * whole + part).otherwise(0)
    return summed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row.

    ``weights``: (source, weight), one row a source; sources that are not in it weigh 0. Without it the weights 3, 1, 2 are dealt in turn.
    """
    spark = docs.sparkSession
    sized = materialize(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sources = materialize(spark, sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    if weights is None:
        weighed = dealt_weights(sources)
    else:
        w = weights.select(F.col("source").alias("__of"), "weight")
        weighed = sources.join(w, F.col("source").eqNullSafe(F.col("__of")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    targets = materialize(spark, water_fill(weighed, share, epochs), "mix-targets")
    return repetitions(sized, targets, epochs, seed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_S = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_S}'))::BIGINT AS size FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] * 1000000 AS w FROM q),
u AS (SELECT *, sum(w) OVER o AS ws, sum(source_size) OVER o AS words FROM r WHERE source_size > 0 WINDOW o AS (ORDER BY source_size::DOUBLE / w::DOUBLE, source IS NULL, source)),
a AS (SELECT sum(source_size) AS all_words, sum(w) FILTER (source_size > 0) AS all_w FROM r),
v AS (SELECT w, source_size, ws, (all_words::DOUBLE * {SHARE} - (words - source_size)::DOUBLE * {EPOCHS}) / (all_w - ws + w)::DOUBLE AS level FROM u, a),
l AS (SELECT arg_min(level, ws) AS level FROM v WHERE level * w <= source_size * {EPOCHS}.0),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(source_size * {EPOCHS}.0::DOUBLE, coalesce(level * w, source_size * {EPOCHS}.0::DOUBLE)) ELSE 0 END AS target FROM r, l),
p AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(target / source_size)::BIGINT AS whole FROM p)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN size * whole + greatest(least(size, round(target - whole * source_size)::BIGINT - (upto - size)), 0) ELSE 0 END::BIGINT AS taken FROM f
"""
