"""Exports that mix forms, and batches that run again."""

import json

from pyspark.sql import functions as F

from txnweave import sources, streaming


def test_json_files_each_their_own_way(spark, tmp_path):
    row = lambda i: {"date": "2024-01-01", "sender": "x", "message": f"text {i}"}
    forms = [[row(1), row(2)], {"messages": []}, {"messages": [row(3)]}, {"data": [row(4)]}, [{"amount": 5, "merchant": "m"}]]
    for i, form in enumerate(forms):
        (tmp_path / f"{i}.json").write_text(json.dumps(form))
    got = {r.body for r in sources.read_json(spark, str(tmp_path)).collect()}
    assert got == {"text 1", "text 2", "text 3", "text 4", "Transaction: Rs.5 to m"}


def test_xml_falls_back_by_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<smses><sms address="x" date="1700000000000" body="one"/><message address="x" date="1700000000000" body="no"/></smses>')
    (tmp_path / "b.xml").write_text('<all><message address="y" date="1700000000000" body="two"/></all>')
    assert {r.body for r in sources.read_sms_xml(spark, str(tmp_path)).collect()} == {"one", "two"}


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    batch = spark.range(10).select("id", F.when(F.col("id") < 4, "keep").otherwise("garbage").alias("classification"))
    for number in (0, 1, 1):
        streaming.write_batch(batch, number, str(tmp_path))
    back = spark.read.parquet(str(tmp_path))
    assert back.count() == 20 and back.where("classification = 'keep'").count() == 8


def test_labelled_rows_and_plain_corpus(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"raw_text": "a"}, {"bank": "SBI", "labeled": True}]}))
    assert sorted(map(tuple, sources.read_labeled_rows(spark, f"{tmp_path}/rows.json").select("bank", "raw_text", "labeled").collect())) == [("SBI", "", True), ("unknown", "a", False)]
    sources.write_corpus(spark.createDataFrame([("one", "s"), ("two", "s")], "text string, source string"), f"{tmp_path}/plain", plain=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/plain").collect()) == ["", "", "one", "two"]
