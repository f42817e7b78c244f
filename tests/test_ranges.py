"""Ranks, splits, running sums and systematic samples over wide tables, hot groups, ties and nulls."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from txnweave.operators import datasets as D
from txnweave.operators import ranges


def test_ranks_of_a_wide_table(spark):
    """A million rows with columns outside the order: ranks are exactly 1..n, the split keeps every row."""
    n = 1_000_000
    wide = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 7).alias("extra"))
    ranked = D.global_rank(wide, [F.col("k"), F.col("id")], "r")
    assert ranked.columns == ["id", "k", "text", "extra", "r"]
    got = ranked.agg(F.count("*"), F.count_distinct("r"), F.min("r"), F.max("r"), F.count_distinct("text")).first()
    assert tuple(got) == (n, n, 1, n, n)
    steps = ranked.alias("a").join(ranked.alias("b"), F.expr("a.r + 1 = b.r")).agg(F.count("*"), F.count_if(F.expr("struct(a.k, a.id) < struct(b.k, b.id)"))).first()
    assert tuple(steps) == (n - 1, n - 1)
    assert {r["split"]: r["n"] for r in D.exact_split(wide, "id", 0.95).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("text")).collect()} == {"train": 950_000, "valid": 50_000}


def test_hot_account(spark):
    """Nine tenths of the rows on one account: the sums are those of one window, and no range has twice its share."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 500).cast("long").alias("account"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("day"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2001)) - 1000).cast("decimal(18,2)").alias("amount"))
    out = D.running_balance(rows, "account", ["day", "id"], F.col("amount"), F.lit(100).cast("decimal(18,2)")).collect()
    sums = defaultdict(lambda: 100)
    assert len(out) == 200_000
    for r in sorted(out, key=lambda r: (r.account, r.day, r.id)):
        sums[r.account] += r.amount
        assert r.balance == sums[r.account]
    sizes = [r["count"] for r in ranges.place(rows.repartition(8), [F.col("account"), F.col("day"), F.col("id")]).groupBy("__r_part").count().collect()]
    assert len(sizes) == 1 or max(sizes) < 2 * sum(sizes) / len(sizes)


def test_sums_of_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 1, 5), (None, None, 7), ("a", 2, None), ("a", 1, 3), ("b", 1, 4)], "g string, o int, v long")
    got = ranges.prefix_sums(rows, ["g"], [F.col("o")], {"s": F.col("v")}).collect()
    assert Counter((r.g, r.o, r.v, r.s) for r in got) == Counter([(None, None, 7, 7), (None, 1, 5, 12), (None, 1, 5, 17), ("a", 1, 3, 3), ("a", 2, None, 3), ("b", 1, 4, 4)])
    assert ranges.prefix_sums(rows.where("false"), ["g"], [F.col("o")], {"s": F.col("v")}).collect() == []
    assert ranges.global_rank(rows.where("false"), [F.col("o")], "r").collect() == []
    assert sorted(r.r for r in ranges.global_rank(rows, [F.col("o")], "r").collect()) == [1, 2, 3, 4, 5, 6]


def test_systematic_sample(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, 40.0).when(F.col("id") % 7 == 0, 0.0).when(F.col("id") == 11, None).otherwise(1.5).alias("w"), F.lit("x").alias("extra"))
    weights = {r.id: r.w or 0.0 for r in rows.collect()}
    for size in (None, 1, 777, 20_000):
        got = ranges.systematic_sample(rows, "id", F.col("w"), size).collect()
        n = 5000 if size is None else size
        assert len(got) == n
        times, total = Counter(r.id for r in got), sum(weights.values())
        for i, w in weights.items():
            assert abs(times[i] - w * n / total) < 1 + 1e-9
        assert {r.id for r in got if r.copy_no == 1} == set(times)
    assert ranges.systematic_sample(rows.withColumn("w", F.lit(0.0)), "id", F.col("w")).count() == 0
    assert ranges.systematic_sample(rows.where("false"), "id", F.col("w")).count() == 0
