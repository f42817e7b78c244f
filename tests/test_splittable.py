"""Exports cut into many splits: records equal those of one parse of the whole file."""

import csv
import json
import random
from collections import Counter

import pytest

from txnweave import sources
from txnweave.sources import splittable


@pytest.fixture(params=["64m", "701"])
def cut(spark, request):
    for k, v in (("spark.sql.files.maxPartitionBytes", request.param), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield request.param
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def nasty(rng):
    return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", ":", "a", "é", "\n", " ", "messages", '": [{']) for _ in range(rng.randrange(30)))


def items(rng, n):
    return [{"id": i, "body": nasty(rng), "date": None, "more": [{"x": nasty(rng)}, [1, [2]], {}], "merchant": {"name": nasty(rng)}} for i in range(n)]


def expected(value, wrappers):
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    held = next((value[w] for w in wrappers if value.get(w)), None)
    return [value] if held is None else [x for x in held if isinstance(x, dict)]


def test_json_shapes(spark, cut, tmp_path):
    rng = random.Random(5)
    values = [
        items(rng, 40), {"messages": items(rng, 20)}, {"note": [{"a": [1]}], "items": items(rng, 12), "data": items(rng, 5), "end": {"z": "}"}},
        {"body": "alone", "list": [1, {"y": nasty(rng)}]}, [], {}, {"messages": [], "data": items(rng, 7)},
    ]
    for i, v in enumerate(values):
        (tmp_path / f"{i}.json").write_text(json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=False) + rng.choice(["", "\n"]))
    wrappers = ("messages", "transactions", "items", "data")
    got = splittable.json_items(spark, str(tmp_path), wrappers).collect()
    for i, v in enumerate(values):
        mine = Counter(json.dumps(json.loads(r.item), sort_keys=True) for r in got if r.file.endswith(f"/{i}.json"))
        assert mine == Counter(json.dumps(x, sort_keys=True) for x in expected(v, wrappers)), i


def test_json_lines_and_broken_files(spark, cut, tmp_path):
    rng = random.Random(6)
    rows = items(rng, 30)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in rows))
    (tmp_path / "open.json").write_text(json.dumps(items(rng, 3))[:-40])
    got = [json.loads(r.item) for r in splittable.json_items(spark, str(tmp_path), ("messages",)).collect() if r.file.endswith("lines.json")]
    assert sorted(got, key=lambda x: x["id"]) == rows


def test_one_array_in_many_tasks(spark, tmp_path):
    """One bare array without a line end is read by as many tasks as it has splits."""
    (tmp_path / "a.json").write_text("[" + ",".join(json.dumps({"sender": f"s{i}", "body": f'said "{i}" }} {{', "date": "2024-01-02"}) for i in range(40_000)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = sources.read_json(spark, str(tmp_path))
        assert found.count() == 40_000 and found.select("body").distinct().count() == 40_000
        assert splittable._pieces(spark, str(tmp_path), "}", "").rdd.getNumPartitions() > 8
        blocks = splittable._pieces(spark, str(tmp_path), "}", "").select("block").distinct().count()
        assert blocks > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_states_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    v = items(rng, 12)
    (tmp_path / "a.json").write_text(json.dumps(v))
    monkeypatch.setattr(splittable, "STATES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    try:
        got = splittable.json_items(spark, str(tmp_path), ("rows",)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((json.loads(r.item) for r in got), key=lambda x: x["id"]) == v


def test_csv(spark, cut, tmp_path):
    rng = random.Random(8)
    field = lambda: "".join(rng.choice(['"', ",", "\n", "a", "é", " ", "\r\n", "x"]) for _ in range(rng.randrange(12)))
    want = Counter()
    for i, header in enumerate((["Date", "From", "SMS"], ["n", "BODY", "Sender", "date"], ["Text"])):
        with open(tmp_path / f"{i}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]))
            w.writerow(header)
            for _ in range(50):
                row = ["k" + field() for _ in header]
                w.writerow(row)
                named = {h.lower(): x for h, x in zip(header, row)}
                want[(f"{i}.csv", named.get("date"), named.get("from") or named.get("sender"), named.get("sms") or named.get("body") or named.get("text"))] += 1
            w.writerow(["too", "many"] + ["x"] * len(header))
    got = splittable.csv_records(spark, str(tmp_path), sources.CSV_ALIASES)
    assert Counter((r.file.rpartition("/")[2], r.timestamp, r.sender, r.body) for r in got.collect()) == want


def test_csv_short_rows_and_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,from,text\n1\n\n2,b,"c\nd"\n3,x,"never closed\nmore')
    (tmp_path / "empty.csv").write_text("")
    got = splittable.csv_records(spark, str(tmp_path), sources.CSV_ALIASES)
    assert {(r.timestamp, r.body) for r in got.collect()} == {("1", None), ("2", "c\nd"), ("3", "never closed\nmore")}


def test_labelled_rows_of_both_shapes(spark, tmp_path):
    row = {"raw_text": "a } b", "date": "1", "debit": "5", "entities": {"amount": "5"}, "labeled": True, "bank": "X", "page": 2, "row_index": 3}
    (tmp_path / "list.json").write_text(json.dumps([row, {"raw_text": "bare"}]))
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [row, {}]}))
    got = sources.read_labeled_rows(spark, str(tmp_path)).collect()
    assert len(got) == 4
    full = [r for r in got if r.labeled]
    assert len(full) == 2 and all((r.date, r.debit, r.credit, r.page, r.row_index, r.entities) == ("1", "5", None, 2, 3, {"amount": "5"}) for r in full)
    assert sorted((r.raw_text, r.bank, r.page, r.entities) for r in got if not r.labeled)[0] == ("", "unknown", 0, {})


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "a.CSV").write_text("Date,From,SMS\n2024-01-01,me,hello\n2024-01-02,me,twice\n")
    (tmp_path / "x" / "b.json").write_text(json.dumps([{"body": "json one", "from": "j"}, {"body": "twice"}]))
    (tmp_path / "x" / "y" / "c.xml").write_text('<smses><sms address="z" date="1700000000000" body="from xml"/></smses>')
    (tmp_path / "x" / "d.mbox").write_text("From x\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nFrom: q@r\nSubject: s\n\nmail text\n")
    (tmp_path / "x" / "notes.txt").write_text("no export")
    got = {r.body: r.source for r in sources.unify(spark, str(tmp_path)).collect()}
    assert got == {"hello": "csv", "twice": "csv", "json one": "json", "from xml": "xml", "mail text": "mbox"}
    (tmp_path / "none").mkdir()
    assert sources.unify(spark, str(tmp_path / "none")).collect() == []
