"""Table-driven cases as DataFrame rows."""

import pytest
from pyspark.sql import functions as F

from txnweave.functions import extract as X
from txnweave.functions import jsonx, lookup, normalize, score
from txnweave.operators import datasets as D
from txnweave.operators import routing


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


AMOUNTS = [
    ("Rs.500.00 debited", 500.0), ("INR 2500 debited", 2500.0), ("Rs 1,234.50 spent", 1234.5), ("Amt: 50.00", 50.0), ("debited 200.00 from", 200.0),
    ("INR 1.5 Lakh credited to your A/c 9876 on 15-01-25", 150000.0), ("nothing", None), ("₹75 received", 75.0), ("Rs.५०० debited", 500.0), ("", None), (None, None),
]


@pytest.mark.parametrize(("text", "want"), AMOUNTS)
def test_amount(spark, text, want):
    assert one(spark, X.amount(F.col("t")), t=F.lit(text).cast("string")) == want


def test_broken_lakh(spark):
    df = spark.createDataFrame([("1.2.3 lakh and Rs.50 debited",)], "text string")
    assert X.extract(df).first()["amount"] == 50.0
    row = X.extract(df, compat=True).first()
    assert row["amount"] is None and row["type"] is None


FIELDS = [
    ("date", "paid on 01/01/25", "01/01/25"), ("date", "on 28 Dec 2025", "28 Dec 2025"), ("account", "Account XXXXX1234", "1234"), ("account", "ending with 5678", "5678"),
    ("account", "A/c no. 4321", "4321"), ("vpa", "VPA: x VPA merchant@okaxis", "merchant@okaxis"), ("reference", "Ref: 123456789012", "123456789012"), ("type", "debited then credited", "debit"),
    ("bank", "from hdfc bank", "hdfc"), ("payment_method", "by NEFT", "NEFT"), ("type", "", None),
]


@pytest.mark.parametrize(("field", "text", "want"), FIELDS)
def test_fields(spark, field, text, want):
    assert one(spark, X.fields(F.col("t"))[field], t=text) == want


def test_priorities(spark):
    got = one(spark, X.all_matches(F.col("t"), "date"), t="5-1-25 and on 6-1-25")
    assert [(r["value"], r["priority"]) for r in got] == [("6-1-25", 12), ("5-1-25", 10), ("6-1-25", 10)]


NORMAL = [
    (normalize.amount, "Rs. 1,234.50", 1234.5), (normalize.amount, "invalid", None), (normalize.date, "28/12/25", "28-12-2025"), (normalize.date, "28 Dec 2025", "28-12-2025"),
    (normalize.date, "2025-12-28", "28-12-2025"), (normalize.date, "invalid_date", None), (normalize.date, "1-2-75", "01-02-1975"), (normalize.date, "31-02-2025", None),
    (lambda c: normalize.account(c, True), "XXXX12345678", "****5678"), (normalize.clean_mail, "Hello    World\n\nTest", "Hello World Test"), (normalize.vpa, " A@YBL ", "a@ybl"), (normalize.vpa, "none", None),
    (normalize.merchant, "Paid to UPI-Shop", "Shop"), (normalize.category, "Dining", "food"), (normalize.category, "zzz", "other"), (normalize.reference, "--", None),
    (normalize.comparable, " 2,500.00 ", "2500.00"), (lambda c: normalize.comparable(c, True), "2500", "25"), (normalize.clean_corpus, "a [b] ~ c", "a [b]  c"),
]


@pytest.mark.parametrize(("function", "text", "want"), NORMAL)
def test_normalize(spark, function, text, want):
    assert one(spark, function(F.col("t")), t=text) == want


def test_content_key(spark):
    key = normalize.content_key(F.col("t"))
    assert one(spark, key, t="Rs.500 spent") == one(spark, key, t="  rs.500 SPENT ")


LOOKUPS = [
    (lookup.merchant_from_vpa, "AMAZONPAY@ICICI", "Amazon"), (lookup.merchant_from_vpa, "unknown@ybl", None), (lookup.category_from_text, "Taxi ride to airport", "transport"),
    (lookup.category_from_text, "Unknown transaction", None), (lookup.app_from_vpa, "x@YBL", "PhonePe"), (lookup.category_from_merchant, "Swiggy", "food"), (lookup.category_from_merchant, "", None),
]


@pytest.mark.parametrize(("function", "text", "want"), LOOKUPS)
def test_lookup(spark, function, text, want):
    assert one(spark, function(F.col("t")), t=text) == want


@pytest.mark.parametrize("text", ['{amount: 500, type: "debit"}', "{'amount': '500', 'type': 'debit'}", '{"amount": 500, "type": "debit",}', 'Here: {"amount": 500, "type": "DEBITED"} ok'])
def test_json(spark, text):
    got = jsonx.validated(jsonx.parse(F.col("t")))
    assert one(spark, got["amount"], t=text) == 500.0
    assert one(spark, got["type"], t=text) == "debit"


def test_json_decimal_point(spark):
    text = '{"amount": "Rs. 12.50"}'
    assert one(spark, jsonx.validated(jsonx.parse(F.col("t")))["amount"], t=text) == 12.5
    assert one(spark, jsonx.validated(jsonx.parse(F.col("t")), True)["amount"], t=text) == 1250.0


def test_otp_rule(spark):
    text = "Dear user, OTP 1234 for your login to the portal"
    assert one(spark, routing.classify(F.col("t"))[0], t=text) == "garbage"
    assert one(spark, routing.classify(F.col("t"), True)[0], t=text) == "uncertain"


def test_confidence(spark):
    cols = {f: F.lit("x") for f in score.WEIGHTS}
    assert one(spark, score.level(score.combined(cols)), t="") == "high"
    none = {f: F.lit(None).cast("string") for f in score.WEIGHTS}
    assert one(spark, score.level(score.combined(none)), t="") == "failed"
    assert one(spark, score.missing_fields(none), t="") == ["amount", "type", "merchant", "category", "date", "reference"]


def test_keep_first_and_samples(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert {(r.k, r.v) for r in D.keep_first(df, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 3)}
    many = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    assert D.sample_per_group(many, "g", "id", 7).groupBy("g").count().select("count").distinct().collect()[0][0] == 7
    assert D.exact_split(many, "id", 0.9).where("split = 'train'").count() == 900
    ranked = D.global_rank(many, [F.col("id").desc()], "r").orderBy("r").select("id", "r").collect()
    assert [r.id for r in ranked] == list(range(999, -1, -1)) and [r.r for r in ranked] == list(range(1, 1001))
