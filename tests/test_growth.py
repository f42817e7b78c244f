"""Queries over larger tables: texts are searched once, by what they hold, in tasks of bounded size."""

import re

import pytest
from pyspark.sql import functions as F

from txnweave import rules, sources
from txnweave.functions import patterns as P
from txnweave.operators import routing, scorer
from txnweave.plans import messages as M

FOLDER = "/root/testdata/sf0.001"
RULES = [p for ps in rules.FIELD_PATTERNS.values() for p, _ in ps]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folded_letters(spark):
    """No other letter than the listed ones matches a-z without regard to case."""
    every = spark.range(128, 0x10000).where("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = {r.c for r in every.where(F.col("c").rlike("(?iU)^[a-z]$")).collect()}
    assert found == set(P.FOLDED)


@pytest.mark.parametrize("ignore_case", [True, False])
def test_guards_change_nothing(spark, ignore_case):
    said = ["", "Rs.5 on 1-2-2024", "on 1/2/24", "ſent", "pAıd", "DEBİTED", "Kotak", "kotak", "vpa x@ybl", "a@sbi", "₹ 5", "5 Lakh", "ending 1234", "A/c 12345", "UPI  Ref: 123456789012", None, "refund", "1 Jan 2024", "debited 5", "Txn ID ABCDEFGHIJ12", "Amt: 7"]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "id int, text string")
    t = F.col("text")
    plain = [F.nullif(F.regexp_extract(t, P.java(p, ignore_case), 1), F.lit("")) for p in RULES]
    low = P.folded(t)
    guarded = [P.first_match(t, p, 1, ignore_case, low) for p in RULES]
    hits = [t.rlike(P.java(p, ignore_case)) for p in RULES]
    same = [a.eqNullSafe(b) for a, b in zip(plain + hits, guarded + [P.matches(t, p, ignore_case, low) for p in RULES], strict=True)]
    assert all(all(r) for r in texts.select(*same).collect())


def test_every_rule_asks_for_what_it_needs():
    """Of the patterns of the classes all are spared texts without their words."""
    for p in [*rules.GARBAGE_PATTERNS, *rules.KEEP_PATTERNS]:
        assert P.required(p), p
    for p in RULES:
        for words in P.required(p):
            assert all(re.search(re.escape(w[:1]), p) for w in words)


def test_classes_are_found_once(spark):
    """neither a filter on the class nor both of its columns search a text again."""
    found = routing.with_class(M.messages(spark, FOLDER)).where("classification = 'keep' AND filter_reason != 'x'")
    assert plan(found).count(r"one.time.password") == 1


def test_labels_are_found_once(spark):
    """The filter on verified labels doesn't extract again."""
    from txnweave.plans.set_queries import review_queues

    assert plan(review_queues(spark, FOLDER)).count("transferred out") == 1


def test_answers_need_no_join(spark):
    """what a model answers stays in its row."""
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "b", "m", None), (3, None, None, None)], "id int, text string, merchant string, amount double")
    df = df.select("*", *[F.lit("x" if c == "type" else None).cast("string").alias(c) for c in ("type", "date", "account", "reference", "category", "vpa")])
    model = lambda: lambda texts: ['{"merchant": "' + t + '!"}' for t in texts]
    out = scorer.enrich(df, "id", "text", model, ["merchant"])
    assert "Join" not in plan(out)
    assert {r.id: r.merchant for r in out.collect()} == {1: "a!", 2: "m", 3: None}
    by_field = scorer.enrich_by_field(df, "id", "text", lambda: lambda texts: ["y"] * len(texts))
    assert "Join" not in plan(by_field)
    assert {r.id: r.merchant for r in by_field.collect()} == {1: "y", 2: "m", 3: None}


def test_tasks_are_of_bounded_size(spark, monkeypatch):
    """one row group of orders is dealt over as many tasks as its bytes ask for."""
    monkeypatch.setattr(M, "TASK_BYTES", 1000)
    assert M.messages(spark, FOLDER).rdd.getNumPartitions() > 8


def test_rows_without_a_fact_have_no_text(spark):
    row = spark.read.parquet(f"{FOLDER}/orders.parquet").limit(64)
    nulled = [row.withColumn(c, F.lit(None).cast(t)) for c, t in (("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_custkey", "long"))]
    for x in nulled:
        assert M.render(M.facts(x)).where("text IS NOT NULL").count() == 0
    assert M.render(M.facts(row)).where("text IS NULL").count() == 0


def test_texts_share_files(spark, tmp_path):
    """texts come back whole, with line ends, separators and escapes in them, and need no file each."""
    said = ["", "a\nb\r\n", "\x01", "x\x02a\x01b\x02", "\x02b\x01\x01", " last\n\n"] * 20
    sources.write_text_packs(spark.createDataFrame([(x,) for x in said], "text string").repartition(3), "text", str(tmp_path / "packs"))
    assert sorted(r.text for r in sources.read_text_packs(spark, str(tmp_path / "packs")).collect()) == sorted(said)
    assert len(list((tmp_path / "packs").glob("part-*"))) <= 3


def test_documents_share_files(spark, tmp_path, monkeypatch):
    from txnweave.plans import more_queries

    monkeypatch.setattr(more_queries, "new_folder", lambda spark, tag: f"{tmp_path}/{tag}")
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert more_queries.text_folder(spark, FOLDER).count() == n > len(list((tmp_path / "texts").glob("part-*")))


def test_dates_in_all_formats(spark):
    """a format is tried only where its separator stands, and all are still read."""
    from txnweave.functions import normalize

    said = {"1-2-2024": "01-02-2024", "1/2/24": "01-02-2024", "1 Feb 2024": "01-02-2024", "1 February 24": "01-02-2024", "2024-2-1": "01-02-2024", "1.2.24": "01-02-2024", " 1  Feb 24 ": "01-02-2024", "1-2/24": None, "": None}
    got = spark.createDataFrame(list(said.items()), "text string, want string").select("want", normalize.date(F.col("text")).alias("day"))
    assert all(r.want == r.day for r in got.collect())
    shown = plan(spark.createDataFrame([("1-2-2024",)], "text string").repartition(2).select(normalize.date(F.col("text"))))
    assert shown.lower().count("contains(") >= 11


def test_all_matches_with_and_without_folded_text(spark):
    """the search for needed words leaves no match out."""
    from txnweave.functions import extract as X

    texts = M.messages(spark, FOLDER).select("text", P.folded(F.col("text")).alias("low"))
    same = [X.all_matches(F.col("text"), f).eqNullSafe(X.all_matches(F.col("text"), f, F.col("low"))) for f in rules.FIELD_PATTERNS]
    assert texts.where(~F.forall(F.array(*same), lambda x: x)).count() == 0


def test_one_search_for_many_words(spark):
    """a search for all words at once finds what one search for each finds."""
    said = ["", None, "show", "sho", "a shopping cart", "50% off", "don't miss", "x.y", "xzy", "bu", "abus", "[a]", "pay", "pa y", "Pay", "ashow\nbus"]
    texts = spark.createDataFrame([(x,) for x in said], "text string")
    for words in (["show", "shop", "bus", "buy", "pay", "payment"], ["% off", "don't", "x.y", "[a]", "^", "a-b", "\\"], ["sho", "show"], ["pay", ""], [w for ws in rules.CATEGORY_WORDS.values() for w in ws], [k for k, _, _ in rules.MERCHANTS]):
        assert texts.where(~P.holds_any(F.col("text"), words).eqNullSafe(P.has_any(F.col("text"), words))).count() == 0, words


def test_patterns_by_their_first_letters(spark):
    """patterns are tried where their first letter stands, and find the same; no text is searched word by word before."""
    said = ["otp", "xotp", "logged in", "login alert", "loggedin", "e-statement", "12345 will expire", "123 expire", "50% off", "buy now", "buynow", "pay before", "new login", "abc", "ab+", "aab", "b", "a", "", None, "é otp", "unsubscribe", "sub scribe"]
    texts = spark.createDataFrame([(x,) for x in said], "text string")
    for patterns in (routing.garbage_patterns(), [r"\bab?c", r"\ba+b", r"\ba", r"\b\d+%", r"\ba{2}b"], [r"\bab\+", r"\babc\b"], [r"\ba|b", r"\bc"], ["ab", "b"]):
        plain = F.col("text").rlike(P.java("|".join(f"(?:{p})" for p in patterns), False))
        assert texts.where(~P.matches_any(F.col("text"), patterns).eqNullSafe(plain)).count() == 0, patterns
    assert "exists(" not in plan(routing.with_class(texts)).lower()


def test_merchants_by_exact_key_first(spark):
    """an address's user part that is a key has that key's name, another the first key's that it holds."""
    from txnweave.functions import lookup

    said = {"swiggy@ybl": "Swiggy", "paytmmoney@x": "Paytm Money", "myswiggyzomato": "Swiggy", "coin@a": "Zerodha Coin", "bitcoins@a": "Zerodha Coin", "x@y": None, "": None, None: None}
    got = spark.createDataFrame(list(said.items()), "vpa string, want string")
    assert got.where(~lookup.merchant_from_vpa(F.col("vpa")).eqNullSafe(F.col("want"))).count() == 0


def test_streams_are_dealt(spark, tmp_path, monkeypatch):
    """few files of messages are classified in as many tasks as their bytes ask for."""
    from txnweave.plans import io_queries

    monkeypatch.setattr(io_queries, "new_folder", lambda spark, tag: f"{tmp_path}/{tag}")
    monkeypatch.setattr(io_queries, "STREAM_TASK_BYTES", 5000)
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert io_queries.stream_extract(spark, FOLDER).agg({"n": "sum"}).first()[0] == n
    assert len(list((tmp_path / "stream" / "out").glob("part-*"))) > 8


def test_json_documents_share_files_and_are_parsed_once(spark, tmp_path, monkeypatch):
    """Files are no more than tasks, however many documents there are; what they hold comes back whole, each item parsed once."""
    from txnweave.plans import io_queries

    monkeypatch.setattr(io_queries, "new_folder", lambda spark, tag: f"{tmp_path}/{tag}")
    m = io_queries._text(spark, FOLDER).withColumn("msg_id", F.col("msg_id") * 100)
    io_queries._write_exports(m, F.struct(F.col("sender").alias("address"), F.col("text").alias("message")), f"{tmp_path}/many")
    assert len(list((tmp_path / "many").glob("part-*"))) <= 4
    back = sources.read_json(spark, f"{tmp_path}/many")
    assert back.exceptAll(m.selectExpr("CAST(NULL AS string) AS timestamp", "sender", "text AS body", "'json' AS source")).count() == 0
    assert back.count() == m.count()
    assert plan(back).count("from_json(") == 1


def test_table_function_searches_what_may_match(spark):
    """the SQL function finds what the patterns find, and asks for their words first."""
    from txnweave.functions import extract as X
    from txnweave.functions import sql

    sql.register(spark)
    said = ["", None, "Rs.5 on 1-2-2024", "ſent", "pAıd", "DEBİTED 7", "vpa x@ybl", "₹ 5", "5 Lakh", "ending 1234", "UPI  Ref: 123456789012", "debited 5", "Txn ID ABCDEFGHIJ12", "Kotak bank"]
    spark.createDataFrame([(x,) for x in said], "text string").unionByName(M.messages(spark, FOLDER).select("text")).createOrReplaceTempView("growth_texts")
    got = spark.sql("SELECT text, field, value, priority FROM growth_texts, LATERAL txn_matches(text)")
    each = [spark.table("growth_texts").select("text", F.lit(f).alias("field"), F.explode(X.all_matches(F.col("text"), f)).alias("m")).select("text", "field", "m.*") for f in rules.FIELD_PATTERNS]
    want = each[0]
    for e in each[1:]:
        want = want.unionByName(e)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert "contains(" in plan(got).lower()


def test_noise_has_fixed_patterns(spark):
    """no pattern depends on the row, so none is compiled a row; a zero character is left as it is."""
    from txnweave.operators import datasets as D

    texts = spark.range(200).select("id", F.lit("debited account \x00 balance available").alias("text"))
    out = texts.select(D.add_noise(F.col("text"), F.col("id").cast("string")).alias("t"))
    assert out.where(F.contains("t", F.lit("\x00"))).count() == 200
    assert "\\x00" not in plan(out)


def test_corpus_texts_are_cleaned_once(spark):
    """the filter on the number of words doesn't clean the texts again."""
    from txnweave.functions.normalize import CORPUS_SIGNS

    df = spark.createDataFrame([("a  b c d e f g h i j k\t",), ("a b",), (None,)], "text string").select("text", F.lit("x").alias("source")).repartition(2)
    out = sources.corpus([df])
    assert plan(out).count(CORPUS_SIGNS) == 1
    assert [(r.text, r.source, r.word_count) for r in out.collect()] == [("a b c d e f g h i j k", "x", 11)]


def test_clean_set_labels_once(spark):
    """rows with and without a reference, and the sample's ranks, read labels that were found once."""
    from txnweave.operators import reports

    seen = []
    given = reports.written
    reports.written = lambda df, tag: seen.append(tag) or given(df, tag)
    try:
        out = reports.clean_set(M.messages(spark, FOLDER), "msg_id", "text", "sender")
    finally:
        reports.written = given
    assert seen == ["clean-set"] and "regexp_extract" not in plan(out) and out.count() > 0
