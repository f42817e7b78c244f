"""Ranks and running sums over whole tables and hot groups.

Rows are cut into ranges of their order and written with their places, once.
Whoever needs sizes, ranks or sums then reads the same places, so that no two
plans can cut the ranges differently. A group that fills many ranges is summed
in each of them; what the earlier ranges hold is carried in from a table with at
most two rows a range.

Rows that the order doesn't tell apart stand by a hash of all their columns;
rows equal in every column are interchangeable. Nulls come first. Names that
begin with ``__r_`` are used inside.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Places inside a range take the low bits of the written number.
PLACE_BITS = 33


def _tie(df: DataFrame) -> list[Column]:
    plain = [f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in plain])] if plain else []


def place(df: DataFrame, order: list[Column], tag: str = "ranges") -> DataFrame:
    """The rows, written in ranges of the order, with __r_part (their range) and __r_at (their place in it, from 0)."""
    keys = [*order, *_tie(df)]
    # The number is taken after the sort of a range, in the task that writes it: range and place need no other shuffle.
    numbered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__r_id", F.monotonically_increasing_id())
    kept = written(numbered, tag)
    return kept.select(*df.columns, F.shiftright("__r_id", PLACE_BITS).alias("__r_part"), F.col("__r_id").bitwiseAND((1 << PLACE_BITS) - 1).alias("__r_at"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n in an order, without one task for all rows: the place in its range plus the sizes of earlier ranges (one row a range)."""
    return _ranked(place(df, order, "rank"), df.columns, name)


def _ranked(placed: DataFrame, columns: list[str], name: str) -> DataFrame:
    sizes = placed.groupBy("__r_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__r_part").alias("__r_p"), (F.sum("n").over(Window.orderBy("__r_part")) - F.col("n")).alias("__r_before"))
    joined = placed.join(F.broadcast(before), F.col("__r_part") == F.col("__r_p"))
    return joined.select(*[c for c in columns if c != name], (F.col("__r_at") + F.col("__r_before") + 1).cast("long").alias(name))


def exact_split(df: DataFrame, order: list[Column], ratio: float) -> DataFrame:
    """Adds split: the first floor(n x ratio) rows of the order are train, the others valid."""
    placed = place(df, order, "split")
    ranked = _ranked(placed, df.columns, "__r_rank")
    side = F.when(F.col("__r_rank") <= int(placed.count() * ratio), "train").otherwise("valid")
    return ranked.select(*[c for c in df.columns if c != "split"], side.alias("split"))


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its value over the group's rows up to this one (nulls count nothing).

    Exact for long and decimal values; doubles are added in another order than one task would.
    """
    values = {f"__r_v{i}": c for i, c in enumerate(sums.values())}
    placed = place(df.select("*", *[c.alias(v) for v, c in values.items()]), [*[F.col(g) for g in group], *order], "sums")
    w = Window.partitionBy("__r_part", *group).orderBy("__r_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.select(*df.columns, "__r_part", *[F.sum(v).over(w).alias(v) for v in values])
    totals = placed.groupBy("__r_part", *group).agg(*[F.sum(v).alias(v) for v in values], F.min("__r_at").alias("__r_lo"))
    # Only the first and the last group of a range can stand in other ranges too.
    whole = F.struct(*group, *values, "__r_lo")
    edges = totals.groupBy("__r_part").agg(F.array_distinct(F.array(F.min_by(whole, "__r_lo"), F.max_by(whole, "__r_lo"))).alias("e"))
    edges = edges.select("__r_part", F.explode("e").alias("e")).select("__r_part", "e.*")
    earlier = Window.partitionBy(*group).orderBy("__r_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(F.col("__r_part").alias("__r_p"), "__r_lo", *[F.col(g).alias(f"__r_g{i}") for i, g in enumerate(group)], *[F.sum(v).over(earlier if group else Window.orderBy("__r_part").rowsBetween(Window.unboundedPreceding, -1)).alias(f"{v}c") for v in values])
    carried = carried.where("__r_lo = 0").drop("__r_lo")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__r_g{i}")) for i, g in enumerate(group)], F.col("__r_part") == F.col("__r_p"))
    joined = within.join(F.broadcast(carried), same, "left")
    out = [(F.coalesce(v, F.lit(0)) + F.coalesce(f"{v}c", F.lit(0))).alias(name) for v, name in zip(values, sums, strict=True)]
    return joined.select(*[c for c in df.columns if c not in sums], *out)


def systematic_sample(df: DataFrame, key: str, weight: Column, size: int | None = None, start: float = 0.5) -> DataFrame:
    """Exactly ``size`` rows (as many as there are, if not given) with replacement, in proportion to a weight.

    Rows stand in the order of their key; the sum of weights is cut into ``size``
    equal steps and each step takes the row that it falls on, so a row comes
    floor or ceil of its expected count. Adds copies and copy_no (from 1).
    Weights count to six decimals; null and negative ones are 0. If all are 0, no row comes.
    """
    if not 0 <= start < 1:
        raise ValueError("start must lie in [0, 1)")
    micro = F.greatest(F.coalesce(F.round(weight * 1000000).cast("long"), F.lit(0)), F.lit(0))
    summed = prefix_sums(df.withColumn("__s_w", micro), [], [F.col(key)], {"__s_upto": F.col("__s_w").cast("decimal(20,0)")})
    totals = summed.agg(F.coalesce(F.max("__s_upto"), F.lit(0)).cast("decimal(20,0)").alias("all"), F.count("*").alias("n")).first()
    if not totals["all"]:
        return df.select(*[c for c in df.columns if c not in ("copies", "copy_no")]).limit(0).select("*", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("copy_no"))
    n, whole = totals["n"] if size is None else int(size), totals["all"]
    shift = int(whole * Decimal(str(start)))
    step = lambda c: F.expr(f"(CAST({c} AS DECIMAL(20,0)) * CAST({n} AS DECIMAL(16,0)) + CAST('{shift}' AS DECIMAL(37,0))) div CAST('{whole}' AS DECIMAL(20,0))")
    taken = summed.withColumn("copies", (step("__s_upto") - step("__s_upto - __s_w")).cast("long")).where("copies > 0")
    return taken.select(*[c for c in df.columns if c not in ("copies", "copy_no")], "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
