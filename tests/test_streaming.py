"""Totals that live in the stream's checkpoint."""

from pyspark.sql import functions as F

from txnweave import streaming
from txnweave.operators import reports

SCHEMA = "ts timestamp, event_type string, value double"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, update=False):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    streaming.keep_totals(streaming.running_totals(stream), f"{folder}/out", f"{folder}/ck", update)
    return {r.event_type: (r.n, float(r.total) if r.total is not None else None) for r in streaming.latest_totals(spark, f"{folder}/out").collect()}


def test_totals_go_on_after_a_restart(spark, tmp_path):
    for update in (False, True):
        folder = f"{tmp_path}/{update}"
        arrive(spark, folder, [("2024-01-01 00:00:00", "a", 1.5), ("2024-01-01 00:00:01", "b", 2.0), ("2024-01-01 00:00:02", None, 4.0)])
        assert run(spark, folder, update) == {"a": (1, 1.5), "b": (1, 2.0), None: (1, 4.0)}
        arrive(spark, folder, [("2023-01-01 00:00:00", "a", 0.1), ("2024-01-02 00:00:00", "c", None)])  # late events count too
        assert run(spark, folder, update) == {"a": (2, 1.6), "b": (1, 2.0), "c": (1, None), None: (1, 4.0)}
        assert run(spark, folder, update) == {"a": (2, 1.6), "b": (1, 2.0), "c": (1, None), None: (1, 4.0)}  # nothing new


def test_transitions(spark):
    texts = spark.createDataFrame([("A b c d",), ("a B\tc x",), ("a",), ("",), (None,), ("a b",)], "t string")
    got = {(r.kind, r.w1, r.w2, r.w3): r.n for r in reports.transitions(texts, "t").collect()}
    assert got == {("start", "a", "b", None): 3, ("next", "a", "b", "c"): 2, ("next", "b", "c", "d"): 1, ("next", "b", "c", "x"): 1}
    shares = {(r.w1, r.w3): r.share for r in reports.next_word_shares(reports.transitions(texts, "t")).where("kind = 'next'").collect()}
    assert shares == {("a", "c"): 1.0, ("b", "d"): 0.5, ("b", "x"): 0.5}
