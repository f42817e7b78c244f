"""Every query with SQL against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from txnweave.plans.registry import ALL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_equals_sql(spark, duck, name):
    query, sql = ALL[name]
    got = query(spark, FOLDER)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want)


def test_json_output(spark):
    row = ALL["j11_output_json"][0](spark, FOLDER).where("msg_id = 7").first()
    assert '"beneficiary"' in row.ground_truth and "null" not in row.ground_truth


def test_events_keep_their_partitions(spark, monkeypatch, tmp_path):
    """No single task writes the events: their files are as many as the table's partitions, and the closing row's."""
    from txnweave.plans import io_queries

    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(io_queries, "new_folder", lambda spark, tag: f"{tmp_path}/{tag}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = io_queries.stream_counts(spark, str(tmp_path)).agg({"n": "sum"}).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert len(list((tmp_path / "counts" / "in").glob("part-*.parquet"))) > 2
