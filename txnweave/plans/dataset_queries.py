"""Dataset, statement, JSON, aggregation, join and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import jsonx, lookup, normalize, score
from ..functions.patterns import has_any as has_stem
from ..functions.patterns import once
from ..operators import datasets as D
from ..operators import extraction, routing, scorer
from ..operators import statements as S
from .extraction_queries import CLASSED, FOUND, RAW, SCORED, _string_fields
from .messages import messages
from .oracle_base import MSG, array, has_any, lit, norm_date


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def found(spark: SparkSession, d: str) -> DataFrame:
    """The extracted messages with their facts."""
    return extraction.extract_messages(messages(spark, d))


# --- joins --------------------------------------------------------------------


def semi_join(spark: SparkSession, d: str) -> DataFrame:
    kept = routing.with_class(messages(spark, d)).where("classification = 'keep'").select("msg_id")
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.join(kept, o.o_orderkey == kept.msg_id, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def holdout(spark: SparkSession, d: str) -> DataFrame:
    """Documents that do not begin like a document of another source does (first 100 characters)."""
    x = docs(spark, d).select("doc_id", "source", F.substring("text", 1, 100).alias("head"))
    training = x.where("source IN ('src0', 'src1', 'src2')").select("head").distinct()
    return x.where("source NOT IN ('src0', 'src1', 'src2')").join(training, "head", "left_anti").select("doc_id", "source")


def merge_results(spark: SparkSession, d: str) -> DataFrame:
    m = X.extract(messages(spark, d).select("msg_id", "text")).select("msg_id", "date", "account", "reference")
    other = messages(spark, d).select("msg_id", F.lit("fact").alias("date"), F.col("true_account").alias("account"), F.when(F.col("msg_id") % 2 == 0, F.col("true_reference")).alias("reference"))
    fields = ["date", "account", "reference"]
    a, b = extraction.merge(m, other, "msg_id", fields), extraction.merge(m, other, "msg_id", fields, True)
    return a.join(b.select("msg_id", *[F.col(f).alias(f"{f}_over") for f in fields]), "msg_id")


def result_reuse(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    known = X.extract(m.where("msg_id % 4 = 0").select(normalize.content_key(F.col("text")).alias("content_key"), "text").groupBy("content_key").agg(F.min("text").alias("text")))
    known = known.select("content_key", "amount", "type")
    return extraction.extract_with_reuse(m, known).groupBy("reused").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"))


def label_join(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    predicted = docs(spark, d).select("doc_id", "lang", (F.size(F.split("text", " ")) >= 100).cast("int").alias("predicted"))
    return predicted.join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("correct"))


# --- aggregations ---------------------------------------------------------------


def coverage(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d)
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 4)
    have = lambda n: share(F.col(n).isNotNull()).alias(f"pct_{n}")
    return f.agg(F.count("*").alias("total"), share(F.col("amount").isNotNull() & F.col("type").isNotNull()).alias("pct_success"), *[have(n) for n in ("amount", "type", "merchant", "category")])


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d).select("confidence", "type", "category", "payment_method")
    out = f.groupingSets([[F.col(c)] for c in f.columns], *f.columns).agg(F.grouping_id().cast("int").alias("g"), F.count("*").alias("n"))
    return out.where(F.coalesce(*f.columns).isNotNull())


def row_quality(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d)
    return f.select("msg_id", *[c.alias(k) for k, c in extraction.row_quality({k: F.col(k) for k in score.WEIGHTS}).items()])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Expected and predicted fields of all messages; one that is no transaction is expected to have neither amount nor type nor account."""
    f = X.extract(messages(spark, d))
    merchant, category = lookup.merchant_and_category(F.col("vpa"), F.col("text"))
    f = f.select("*", merchant.alias("merchant"), category.alias("category"))
    txn = F.col("true_type") != ""
    return f.select(
        "msg_id", "true_bank", F.when(txn, F.col("true_amount").cast("decimal(18,2)").cast("string")).alias("e_amount"), F.when(txn, F.col("true_type")).alias("e_type"), F.when(txn, F.col("true_account")).alias("e_account"),
        F.when(F.col("variant") < 5, F.col("true_reference")).alias("e_reference"), F.when(F.col("variant") < 4, F.date_format("ts", "dd-MM-yyyy")).alias("e_date"),
        F.when(F.col("variant") < 4, F.initcap("shop")).alias("e_merchant"), F.when(F.col("shop").isin("swiggy", "zomato"), "food").alias("e_category"),
        F.col("amount").cast("decimal(18,2)").cast("string").alias("p_amount"), F.col("type").alias("p_type"), F.col("account").alias("p_account"), F.col("reference").alias("p_reference"),
        normalize.date(F.col("date")).alias("p_date"), F.col("merchant").alias("p_merchant"), F.col("category").alias("p_category"),
    )


EVALUATED = ("amount", "type", "date", "reference", "merchant", "category", "account")


def evaluate_banks(spark: SparkSession, d: str) -> DataFrame:
    """Any-sample rule: missing equals missing; overall is amount and type. Per bank and, rolled up, overall."""
    p = _pairs(spark, d)
    same = {f: F.lower(f"e_{f}").eqNullSafe(F.lower(f"p_{f}")) for f in EVALUATED}
    return p.rollup("true_bank").agg(F.count("*").alias("total"), F.count_if(same["amount"] & same["type"]).alias("correct"), *[F.count_if(c).alias(f"ok_{f}") for f, c in same.items()])


def evaluate_rows(spark: SparkSession, d: str) -> DataFrame:
    """The flags of each row."""
    p = _pairs(spark, d)
    same = {f: F.lower(f"e_{f}").eqNullSafe(F.lower(f"p_{f}")) for f in EVALUATED}
    return p.select("msg_id", *[c.alias(f"ok_{f}") for f, c in same.items()], (same["amount"] & same["type"]).alias("correct"))


def evaluate_fields(spark: SparkSession, d: str) -> DataFrame:
    long = D.evaluate(_pairs(spark, d), ["amount", "type", "account", "reference"], "e_", "p_")
    return long.groupBy("true_bank", "field").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def evaluate_samples(spark: SparkSession, d: str) -> DataFrame:
    """A sample is right if all its expected fields are."""
    long = D.evaluate(_pairs(spark, d), ["amount", "type", "account", "reference"], "e_", "p_")
    whole = long.groupBy("msg_id", "true_bank").agg(F.bool_and("correct").alias("full"))
    return whole.groupBy("true_bank").agg(F.count("*").alias("n"), F.count_if("full").alias("full_matches"), F.round(F.avg(F.col("full").cast("double")), 6).alias("accuracy"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    x = docs(spark, d).select("source", words.alias("words"), F.length("text").alias("chars"))
    return x.rollup("source").agg(
        F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.floor(F.sum("words") * 1.3).cast("long").alias("tokens"), F.floor(F.sum("chars") / 4).cast("long").alias("tokens_by_chars")
    )


#: Stems of finance terms.
STEMS = [
    "upi", "neft", "rtgs", "imps", "bank", "account", "transaction", "payment", "credit", "debit", "balance", "transfer", "amount",
    "rupees", "rs", "inr", "loan", "emi", "interest", "deposit", "withdrawal", "statement", "passbook", "cheque", "card",
]


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent finance terms of documents and messages."""
    texts = docs(spark, d).select("text").union(messages(spark, d).select("text"))
    words = texts.select(F.explode(F.split(F.lower("text"), r"(?U)[^\p{L}\p{N}_]+")).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$"))
    # Counted first: each distinct word is compared with the stems once.
    return words.groupBy("word").agg(F.count("*").alias("n")).where(has_stem(F.col("word"), STEMS)).orderBy(F.desc("n"), "word").limit(100)


def labeling_stats(spark: SparkSession, d: str) -> DataFrame:
    x = auto_labels(spark, d)
    return x.groupBy("source").agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("pending"), F.count_if(F.col("confidence") < 0.5).alias("urgent"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    x = training_examples(spark, d)
    has = lambda w: F.contains("completion", F.lit(f'"type":"{w}"'))
    return x.agg(F.count("*").alias("n"), F.count_if(has("debit")).alias("debit"), F.count_if(has("credit")).alias("credit"), F.count_if(~has("debit") & ~has("credit")).alias("other"))


def validate_dataset(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d)
    shares = f.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("amount").isNull()).alias("no_amount"), F.count_if(F.col("type").isNull()).alias("no_type"), F.count_distinct("text").alias("distinct_texts"))
    return shares.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Log-normal fits of amounts by category with at least ten values; overall in the null row."""
    f = found(spark, d).where("amount IS NOT NULL").select(F.coalesce("category", F.lit("none")).alias("category"), F.log(F.greatest(F.lit(1.0), F.col("amount"))).alias("x"))
    return f.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mu"), F.round(F.greatest(F.lit(0.1), F.stddev_pop("x")), 6).alias("sigma")).where("n >= 10")


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return D.bigrams(messages(spark, d), "text")


def service_counters(spark: SparkSession, d: str) -> DataFrame:
    f = routing.with_class(found(spark, d))
    return f.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"), F.count_if(F.col("amount").isNotNull()).alias("extracted"), F.count_if(F.col("classification") == "keep").alias("kept"), F.count_if(F.col("confidence") == "failed").alias("failed")
    )


# --- windows, order, sets -------------------------------------------------------


def row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the final order, beside all columns of the rows."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return D.global_rank(o, [F.col("o_orderdate"), F.col("o_orderkey")], "row_id").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "row_id")


def running_balance(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), F.col("cust_id") == F.col("c_custkey"))
    amount = F.col("true_amount").cast("decimal(18,2)")
    signed = F.when(F.col("true_type") == "credit", amount).when(F.col("true_type") == "debit", -amount).otherwise(0)
    out = D.running_balance(m, "cust_id", ["ts", "msg_id"], signed, F.col("c_acctbal").cast("decimal(18,2)"))
    return out.select("msg_id", "cust_id", F.col("balance").cast("double").alias("balance"))


def dedup_body(spark: SparkSession, d: str) -> DataFrame:
    return D.keep_first(docs(spark, d).select("doc_id", "text", "source"), ["text"], [F.col("source"), F.col("doc_id")]).select("doc_id", "source")


def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag")
    return D.keep_first(li, ["l_suppkey", "day", "l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "day", "l_returnflag", "l_orderkey", "l_linenumber")


def dedup_reference(spark: SparkSession, d: str) -> DataFrame:
    """One row for each bank and whole reference; rows without a reference all stay. A message comes once for each line of its order."""
    m = X.extract(messages(spark, d).select("msg_id", "text", "true_bank")).select("msg_id", "true_bank", "reference")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("msg_id"), F.col("l_linenumber").alias("line_no"))
    m = m.join(li, "msg_id")
    some = D.keep_first(m.where("reference IS NOT NULL"), ["true_bank", "reference"], [F.col("msg_id"), F.col("line_no")])
    columns = ["msg_id", "line_no", "true_bank", "reference"]
    return some.select(*columns).union(m.where("reference IS NULL").select(*columns))


def sample_banks(spark: SparkSession, d: str) -> DataFrame:
    return D.sample_per_group(messages(spark, d).select("msg_id", "true_bank"), "true_bank", "msg_id", 20)


def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", D.unit_hash(F.col("msg_id"), "42").alias("h")).orderBy("h", "msg_id").limit(50).select("msg_id")


def top_senders(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).groupBy("sender", "shop").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender", "shop").limit(20)


def combine_sets(spark: SparkSession, d: str) -> DataFrame:
    """The union of two sets with different columns, split anew."""
    m = messages(spark, d)
    old = m.where("msg_id % 2 = 0").select("msg_id", F.col("text").alias("prompt"))
    new = m.where("msg_id % 2 = 1").select("msg_id", F.col("text").alias("prompt"), F.lit("v7").alias("origin"))
    return D.split(new.unionByName(old, allowMissingColumns=True), "msg_id", 0.9).select("msg_id", "origin", "split")


def bank_presence(spark: SparkSession, d: str) -> DataFrame:
    up = F.upper("text")
    return messages(spark, d).agg(*[F.count_if(F.contains(up, F.lit(b))).alias(b.lower()) for b in ("HDFC", "ICICI", "SBI", "AXIS", "KOTAK", "PHONEPE", "GPAY", "PAYTM")])


# --- JSON -----------------------------------------------------------------------


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the ways models give them, rendered from orders."""
    amount, kind = F.format_string("%.2f", F.col("true_amount")), F.when(F.col("msg_id") % 2 == 0, "Debit").otherwise("credited")
    forms = [
        F.concat(F.lit('{"amount": '), amount, F.lit(', "type": "'), kind, F.lit('", "category": "Dining"}')),
        F.concat(F.lit("Sure! {'amount': '"), amount, F.lit("', 'type': '"), kind, F.lit("', 'merchant': 'Swiggy',} Done.")),
        F.concat(F.lit("{amount: "), amount, F.lit(', type: "'), kind, F.lit('", bank: None}')),
        F.concat(F.lit('```json\n{"amount": "Rs. '), amount, F.lit('", "type": "'), kind, F.lit('", "category": "gadgets"}\n```')),
        F.lit("unknown"),
    ]
    text = F.element_at(F.array(*forms), (F.col("msg_id") % len(forms) + 1).cast("int"))
    return messages(spark, d).select("msg_id", text.alias("response"))


def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    v = _responses(spark, d).select("msg_id", "response", jsonx.parse(F.col("response")).alias("v"))
    got = jsonx.validated(F.col("v"))
    return v.select("msg_id", got["amount"].alias("amount"), got["type"].alias("type"), got["merchant"].alias("merchant"), got["bank"].alias("bank"), got["category"].alias("category"), jsonx.single_field(F.col("response")).isNull().alias("says_nothing"))


def json_pieces(spark: SparkSession, d: str) -> DataFrame:
    r, t = _responses(spark, d), F.col("response")
    return r.select("msg_id", jsonx.outer_slice(t).alias("outer_piece"), jsonx.flat_object(t).alias("flat_piece"), jsonx.get(jsonx.parse_with_fallbacks(t), "type").alias("strict_type"))


def output_json(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth as JSON without nulls, and the entity map of each row."""
    x = messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.label_fields(F.col("text")).items()])
    truth = F.to_json(F.struct("type", "account", "date", "reference", "beneficiary", F.col("is_merchant").alias("is_p2m")))
    ents = S.entities({k: F.col(k) for k in ("account", "date", "reference")})
    return x.select("msg_id", truth.alias("ground_truth"), F.size(ents).alias("n_entities"), F.element_at(ents, "account").alias("account"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.try_parse_json("props")).alias("n_parsed"))


# --- dataset construction ---------------------------------------------------------


def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """Filter, extract, at least two entities, prompt and completion, split."""
    m = messages(spark, d).where(routing.training_filter(F.col("subject"), F.col("text")))
    fields = X.string_fields(F.col("text"))
    x = m.select("msg_id", "text", *[c.alias(k) for k, c in fields.items()])
    n = sum((F.col(k).isNotNull().cast("int") for k in fields), F.lit(0))
    done = x.where(n >= 2).select("msg_id", D.prompt(F.col("text")).alias("prompt"), F.to_json(F.struct("amount", "type", "account", "date", "reference", "merchant")).alias("completion"))
    return D.split(done, "msg_id", 0.9)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    x = training_examples(spark, d)
    turns = x.select("msg_id", "split", F.explode(D.chat(F.col("prompt"), F.col("completion"))).alias("t"))
    return turns.groupBy("split", F.col("t.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("t.content")).alias("chars"))


def exact_split(spark: SparkSession, d: str) -> DataFrame:
    x = D.exact_split(messages(spark, d).select("msg_id", "text", "true_bank"), "msg_id", 0.95)
    return x.groupBy("split", "true_bank").agg(F.count("*").alias("n"), F.sum("msg_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


def auto_labels(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    fields = X.string_fields(F.col("text"))
    x = m.select("msg_id", F.col("true_bank").alias("source"), "subject", *[c.alias(k) for k, c in fields.items()])
    cols = {k: F.col(k) for k in fields}
    title = F.concat(F.initcap(F.coalesce("type", F.lit("transaction"))), F.lit(" Alert - Rs."), F.coalesce("amount", F.lit("0")))
    x = x.select("msg_id", "source", F.coalesce(F.nullif("subject", F.lit("")), title).alias("subject"), "amount", "type", score.string_score(cols).alias("confidence"))
    # Filters on what the labels are worth must not search the texts again.
    x = once(x, {"confidence": F.round("confidence", 6)})
    return x.withColumn("verified", F.col("confidence") >= 0.8)


def apply_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from a table: rejected rows go, corrected ones take the corrected values, confidence 1, time and notes."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "reject").when(F.col("o_orderpriority") == "2-HIGH", "verify")
    fixed = F.when(F.col("o_orderkey") % 3 == 0, "debit")
    decisions = o.select(F.col("o_orderkey").alias("msg_id"), action.alias("action"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderpriority").alias("notes"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), fixed.alias("type"))
    out = D.apply_reviews(auto_labels(spark, d), decisions.where("action IS NOT NULL"), "msg_id", ["amount", "type"])
    return out.select("msg_id", "amount", "type", "verified", "confidence", "verified_at", "notes")


def noise(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", D.add_noise(F.col("text"), F.col("msg_id")).alias("noisy"))


def augmented(spark: SparkSession, d: str) -> DataFrame:
    return D.variants(messages(spark, d), "text", "msg_id")


def edge_oversample(spark: SparkSession, d: str) -> DataFrame:
    m = X.extract(messages(spark, d).select("msg_id", "text"))
    tags = score.edge_tags(F.col("text"), F.col("amount"), F.col("type"))
    w = m.select("msg_id", D.edge_weight(tags).alias("weight"))
    return D.oversample(w, "msg_id", "weight").groupBy("msg_id").agg(F.count("*").alias("copies"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    values = {"amount": F.lit("Rs.<AMOUNT>"), "account": F.lit("<ACCOUNT>"), "date": F.lit("<DATE>"), "reference": F.lit("<REF>"), "vpa": F.lit("<VPA>")}
    return messages(spark, d).select("msg_id", D.mask_entities(F.col("text"), values).alias("masked"))


WEIGHTS = {"plain": 0.6, "short": 0.3, "long": 0.1}


def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    """One of three kinds by cumulative weights."""
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", D.weighted_choice(F.col("o_orderkey"), WEIGHTS, "choice").alias("kind"))


LANGUAGES = {"en": "Rs.{a} {t}", "hi": "रु.{a} {t}", "ta": "ரூ.{a} {t}"}


def multilingual(spark: SparkSession, d: str) -> DataFrame:
    """Templates by language with English where there is none; native digits where the language has them."""
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("en", "hi", "ta", "xx")]), (F.col("msg_id") % 4 + 1).cast("int"))
    table = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    m = messages(spark, d).select("msg_id", "true_type", F.format_string("%.2f", "true_amount").alias("a"), wanted.alias("lang"))
    text = F.replace(F.replace(F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(LANGUAGES["en"])), F.lit("{a}"), F.col("a")), F.lit("{t}"), F.col("true_type"))
    native = F.when(F.col("lang") == "hi", normalize.native_digits(text, "hi")).when(F.col("lang") == "ta", normalize.native_digits(text, "ta")).otherwise(text)
    return m.select("msg_id", "lang", native.alias("text"), (normalize.ascii_digits(native) == text).alias("round_trip"))


# --- statements -------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Statement tables made from order lines: one table for each order, a header row and a row for each line."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    key = [F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table_id")]
    head = F.when(F.col("l_orderkey") % 2 == 0, F.array(*[F.lit(x) for x in ("Txn Date", "Narration", "Withdrawal Amt", "Deposit Amt", "Closing Balance")])).otherwise(F.array(*[F.lit(x) for x in ("Date", "Details", "DR", "CR", "Balance")]))
    price = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    debit, credit = F.when(F.col("l_returnflag") == "R", price).otherwise(""), F.when(F.col("l_returnflag") == "A", price).otherwise("")
    row = F.array(F.date_format("l_shipdate", "dd/MM/yyyy"), F.concat(F.lit("PART "), "l_partkey"), debit, credit, F.concat(F.lit("Rs "), F.format_number(F.round(F.col("l_quantity") * 100, 2).cast("decimal(18,2)"), 2)))
    rows = li.select(*key, F.col("l_linenumber").cast("int").alias("row_idx"), row.alias("cells"))
    heads = li.select(*key, F.lit(0).alias("row_idx"), head.alias("cells")).distinct()
    return rows.union(heads)


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.table_transactions(_cells(spark, d)).select("doc", "row_idx", "date", "description", "amount", "type", "balance", "raw_text")


def column_map(spark: SparkSession, d: str) -> DataFrame:
    return S.column_map(_cells(spark, d)).groupBy(*[F.col(f"at_{c}") for c in S.ALIASES]).agg(F.count("*").alias("n"))


def _statement_lines(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    line = F.concat_ws(" ", F.date_format("l_shipdate", "dd/MM/yyyy"), F.when(F.col("l_returnflag") == "R", "UPI DEBIT").when(F.col("l_returnflag") == "A", "DEPOSIT").otherwise("FEE"), F.format_string("%.2f", "l_extendedprice"), F.format_string("%.2f", F.round(F.col("l_quantity") * 100, 2)))
    return li.select("l_orderkey", "l_linenumber", line.alias("line"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.line_transactions(_statement_lines(spark, d))


def text_lines_compat(spark: SparkSession, d: str) -> DataFrame:
    out = S.line_transactions(_statement_lines(spark, d), True)
    return out.groupBy("type", F.col("amount").cast("int").alias("day")).agg(F.count("*").alias("n"))


# --- scorer -----------------------------------------------------------------------


def rule_model():
    """A stand-in for a model: answers from the text itself."""
    return lambda texts: ['{"merchant": "M%d", "category": "dining"}' % (len(t) % 7) for t in texts]


def enriched(spark: SparkSession, d: str) -> DataFrame:
    out = scorer.enrich(found(spark, d).drop("variant"), "msg_id", "text", rule_model, ["merchant", "category"])
    return out.select("msg_id", "merchant", "category")


_H = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::UBIGINT / 4294967296.0)"


def _hash(key: str, seed: str) -> str:
    return _H.format(seed=seed, key=key)


_STR = f"str AS (SELECT * FROM (SELECT msg_id, text, subject, true_bank, {_string_fields()} FROM msg))"
_STR_SCORE = "round(0.6::DOUBLE * ((amount IS NOT NULL)::INT + (type IS NOT NULL)::INT) / 2 + 0.4::DOUBLE * ((account IS NOT NULL)::INT + (date IS NOT NULL)::INT + (reference IS NOT NULL)::INT + (merchant IS NOT NULL)::INT + (category IS NOT NULL)::INT) / 5, 6)"
_AUTO = f"""{_STR}, auto AS (SELECT *, confidence >= 0.8 AS verified FROM (SELECT msg_id, true_bank AS source,
coalesce(nullif(subject, ''), upper(coalesce(type, 'transaction')[1]) || coalesce(type, 'transaction')[2:] || ' Alert - Rs.' || coalesce(amount, '0')) AS subject, amount, type, {_STR_SCORE} AS confidence FROM str))"""
_PAIRS = f"""{FOUND}, pairs AS (SELECT msg_id, true_bank, CASE WHEN true_type <> '' THEN true_amount::DECIMAL(18,2)::VARCHAR END AS e_amount, nullif(true_type, '') AS e_type, CASE WHEN true_type <> '' THEN true_account END AS e_account, CASE WHEN variant < 5 THEN true_reference END AS e_reference,
CASE WHEN variant < 4 THEN strftime(ts, '%d-%m-%Y') END AS e_date, CASE WHEN variant < 4 THEN shop END AS e_merchant, CASE WHEN shop IN ('swiggy', 'zomato') THEN 'food' END AS e_category,
amount::DECIMAL(18,2)::VARCHAR AS p_amount, type AS p_type, account AS p_account, reference AS p_reference, {norm_date('date')} AS p_date, merchant AS p_merchant, category AS p_category FROM cat)"""
_SAME = {f: f"lower(e_{f}) IS NOT DISTINCT FROM lower(p_{f})" for f in EVALUATED}
_LONG = _PAIRS + ", longer AS (" + " UNION ALL ".join(f"SELECT msg_id, true_bank, '{f}' AS field, lower(e_{f}) IS NOT DISTINCT FROM lower(p_{f}) AS correct FROM pairs WHERE e_{f} IS NOT NULL AND e_{f} <> ''" for f in ("amount", "type", "account", "reference")) + ")"
_ROWCOUNT = " + ".join(f"({f} IS NOT NULL)::INT" for f in ("amount", "type", "account", "date", "reference", "merchant", "category"))
_TRAIN = f"""{_STR}, train AS (SELECT msg_id, text, amount, type, account, date, reference, merchant FROM str WHERE {has_any("lower(concat_ws(' ', subject, text))", ['debited', 'credited', 'payment of', 'transferred'])} AND {has_any("lower(concat_ws(' ', subject, text))", ['rs', '₹'])}
AND {' + '.join(f'({f} IS NOT NULL)::INT' for f in ('amount', 'type', 'account', 'date', 'reference', 'merchant', 'payment_method', 'category', 'bank', 'balance'))} >= 2)"""
_PROMPT = "'Extract financial entities from this message.' || chr(10) || chr(10) || 'Message: ' || substr(text, 1, 1500) || chr(10) || chr(10) || 'Output JSON:' || chr(10)"
_COMPLETION = "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{f}\":\"' || {f} || '\"'" for f in ("amount", "type", "account", "date", "reference", "merchant")) + "], lambda x: x IS NOT NULL), ',') || '}'"
_RESP_AMT, _RESP_KIND = "printf('%.2f', true_amount)", "CASE WHEN msg_id % 2 = 0 THEN 'Debit' ELSE 'credited' END"
_CELLS = """cells AS (SELECT l_orderkey::VARCHAR AS doc, l_linenumber::INTEGER AS row_idx, strftime(l_shipdate, '%d/%m/%Y') AS date, 'PART ' || l_partkey AS description,
CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS debit, CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS credit, round(l_quantity * 100, 2) AS balance FROM lineitem)"""


def _one_of(values: list[str], key: str, seed: str) -> str:
    return f"({array(values)})[floor({_hash(key, seed)} * {len(values)})::INTEGER + 1]"


def _noise(text: str = "text", key: str = "msg_id") -> str:
    def coin(*chances: tuple[str, float]) -> str:
        return " AND ".join(f"{_hash(key, step)} < {chance}" for step, chance in chances)

    out = text
    for word, short in D.ABBREVIATIONS.items():
        out = f"regexp_replace({out}, CASE WHEN {coin(('abbr', 0.5), (f'abbr {word}', 0.5))} THEN '{word}' ELSE '\\x00' END, {_one_of(short, key, f'abbr which {word}')})"
    for old, new in D.SPACINGS:
        out = f"replace({out}, CASE WHEN {coin(('space', 0.3), (f'space {old}', 0.3))} THEN '{old}' ELSE chr(1) END, '{new}')"
    out = f"list_transform([{out}], lambda x: CASE WHEN {coin(('case', 0.2), ('upper', 0.3))} THEN upper(x) WHEN {coin(('case', 0.2), ('lower', 0.1))} THEN lower(x) ELSE x END)[1]"
    out = f"list_transform([{out}], lambda x: CASE WHEN {coin(('cut', 0.1))} AND length(x) > 160 THEN substr(x, 1, 157) || '...' ELSE x END)[1]"
    for word, wrong in D.TYPOS.items():
        out = f"regexp_replace({out}, CASE WHEN {coin(('typo', 0.05), (f'typo {word}', 0.2))} THEN '(?i){word}' ELSE '\\x00' END, {_one_of(wrong, key, f'typo which {word}')})"
    for mark, chance in ((".", 0.3), (",", 0.2)):
        out = f"replace({out}, CASE WHEN {coin(('stop', 0.2), (mark, chance))} THEN '{mark}' ELSE chr(1) END, '')"
    return out


def _synonyms(key: str) -> str:
    bare = "trim(lower(w), '.,;:')"
    choices = "CASE " + " ".join(f"WHEN {bare} = '{w}' THEN {array(s)}" for w, s in D.SYNONYMS.items()) + " END"
    place = f"({key} || '-' || (i - 1))"
    new = f"({choices})[floor({_hash(place, 'synonym which')} * len({choices}))::INTEGER + 1]"
    new = f"CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN upper(({new})[1]) || substr({new}, 2) ELSE {new} END"
    return f"array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN ({choices}) IS NOT NULL AND {_hash(place, 'synonym')} < 0.3 THEN {new} ELSE w END), ' ')"


def _masked() -> str:
    out = "text"
    for pattern, value in ((r"(?:Rs\.?|INR|₹)\s*[\d,]+(?:\.\d+)?", "Rs.<AMOUNT>"), (r"(?:XX|\*\*)\d{4}", "<ACCOUNT>"), (r"\d{2}[-/]\d{2}[-/]\d{2,4}", "<DATE>"), (r"\d{12}", "<REF>"), (r"[a-zA-Z0-9._-]+@[a-zA-Z]+", "<VPA>")):
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(value)})"
    return out


def _variants() -> str:
    made = {
        "synonym": _synonyms,
        "noise": lambda k: _noise("text", k),
        "case": lambda k: f"CASE WHEN {_hash(k, 'copy case')} < 0.5 THEN upper(text) ELSE lower(text) END",
        "cut": lambda k: "CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END",
        "reorder": lambda k: "array_to_string(list_reverse(string_split(text, '. ')), '. ')",
    }
    rows = ["SELECT msg_id, 0 AS copy_no, 'original' AS variant_kind, false AS is_augmented, text AS variant_text FROM msg"]
    return " UNION ALL ".join(rows + [f"SELECT msg_id, {i}, '{kind}', true, {made[kind](f"(msg_id || '/{i}')")} FROM msg" for i, kind in enumerate(D.TECHNIQUES, 1)])


_TAGW = " * ".join(
    f"(CASE WHEN {c} THEN {w} ELSE 1 END)"
    for c, w in (("contains(lower(text), 'failed')", 5.0), ("contains(lower(text), 'pending')", 3.0), ("coalesce(amount > 100000, false)", 2.0), ("coalesce(amount < 10, false)", 2.0), ("strlen(text) > length(text)", 4.0), ("coalesce(type = 'credit', false)", 1.5))
)
_NATIVE = {k: normalize.NATIVE_DIGITS[k] for k in ("hi", "ta")}

QUERIES = {
    "e10_semi_join": (semi_join, f"WITH {MSG}, {CLASSED} SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT msg_id FROM classed WHERE classification = 'keep') GROUP BY ALL"),
    "e11_holdout": (holdout, "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') AND substr(text, 1, 100) NOT IN (SELECT substr(text, 1, 100) FROM documents WHERE source IN ('src0', 'src1', 'src2'))"),
    "e12_merge_results": (merge_results, f"""WITH {MSG}, {RAW} SELECT msg_id, coalesce(date, 'fact') AS date, coalesce(account, true_account) AS account, coalesce(reference, CASE WHEN msg_id % 2 = 0 THEN true_reference END) AS reference,
'fact' AS date_over, true_account AS account_over, coalesce(CASE WHEN msg_id % 2 = 0 THEN true_reference END, reference) AS reference_over FROM merch"""),
    "e13_result_reuse": (result_reuse, f"""WITH {MSG}, {RAW}, k AS (SELECT lower(text) AS key, bool_or(msg_id % 4 = 0) AS reused, max(amount) AS amount FROM merch GROUP BY 1) SELECT reused, count(*) AS n, count(amount) AS n_amount FROM k GROUP BY ALL"""),
    "e14_label_join": (label_join, "SELECT lang, count(*) AS n, count_if((len(string_split(text, ' ')) >= 100)::INT = quality)::BIGINT AS correct FROM documents JOIN labels USING (doc_id) GROUP BY ALL"),
    "f1_coverage": (coverage, f"WITH {MSG}, {SCORED} SELECT count(*) AS total, round(avg((amount IS NOT NULL AND type IS NOT NULL)::INT) * 100, 4) AS pct_success, {', '.join(f'round(avg(({f} IS NOT NULL)::INT) * 100, 4) AS pct_{f}' for f in ('amount', 'type', 'merchant', 'category'))} FROM done"),
    "f2_value_counts": (value_counts, f"WITH {MSG}, {SCORED} SELECT * FROM (SELECT confidence, type, category, payment_method, grouping(confidence, type, category, payment_method)::INTEGER AS g, count(*) AS n FROM done GROUP BY GROUPING SETS ((confidence), (type), (category), (payment_method))) WHERE coalesce(confidence, type, category, payment_method) IS NOT NULL"),
    "f3_row_quality": (row_quality, f"WITH {MSG}, {SCORED} SELECT msg_id, {_ROWCOUNT} AS fields_extracted, amount IS NOT NULL AND type IS NOT NULL AS success FROM done"),
    "f5_evaluate_banks": (evaluate_banks, f"""WITH {MSG}, {_PAIRS} SELECT true_bank, count(*) AS total, count_if({_SAME['amount']} AND {_SAME['type']})::BIGINT AS correct,
{', '.join(f'count_if({c})::BIGINT AS ok_{f}' for f, c in _SAME.items())} FROM pairs GROUP BY ROLLUP (true_bank)"""),
    "f4_evaluate_rows": (evaluate_rows, f"WITH {MSG}, {_PAIRS} SELECT msg_id, {', '.join(f'{c} AS ok_{f}' for f, c in _SAME.items())}, {_SAME['amount']} AND {_SAME['type']} AS correct FROM pairs"),
    "f6_evaluate_fields": (evaluate_fields, f"WITH {MSG}, {_LONG} SELECT true_bank, field, count(*) AS n, count_if(correct)::BIGINT AS correct FROM longer GROUP BY ALL"),
    "f8_evaluate_samples": (evaluate_samples, f"WITH {MSG}, {_LONG}, w AS (SELECT msg_id, true_bank, bool_and(correct) AS f FROM longer GROUP BY ALL) SELECT true_bank, count(*) AS n, count_if(f)::BIGINT AS full_matches, round(avg(f::INT), 6) AS accuracy FROM w GROUP BY ALL"),
    "f9_corpus_stats": (corpus_stats, r"""WITH x AS (SELECT source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, length(text) AS c FROM documents)
SELECT source, count(*) AS docs, sum(w)::BIGINT AS words, sum(c)::BIGINT AS chars, floor(sum(w) * 1.3)::BIGINT AS tokens, floor(sum(c) / 4)::BIGINT AS tokens_by_chars FROM x GROUP BY ROLLUP (source)"""),
    "f10_vocabulary": (vocabulary, rf"""WITH {MSG}, t AS (SELECT text FROM documents UNION ALL SELECT text FROM msg), w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS word FROM t)
SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '^[a-z]{{2,}}$') AND {has_any('word', STEMS)} GROUP BY word ORDER BY n DESC, word LIMIT 100"""),
    "f11_labeling_stats": (labeling_stats, f"WITH {MSG}, {_AUTO} SELECT source, count(*) AS total, count_if(verified)::BIGINT AS verified, count_if(NOT verified)::BIGINT AS pending, count_if(confidence < 0.5)::BIGINT AS urgent, round(avg(confidence), 6) AS avg_confidence FROM auto GROUP BY ALL"),
    "f13_class_balance": (class_balance, f"WITH {MSG}, {_TRAIN} SELECT count(*) AS n, count_if(type = 'debit')::BIGINT AS debit, count_if(type = 'credit')::BIGINT AS credit, count_if(type IS NULL)::BIGINT AS other FROM train"),
    "f14_validate_dataset": (validate_dataset, f"""WITH {MSG}, {SCORED}, g AS (SELECT coalesce(category, 'none') AS category, count(*) AS n, count_if(amount IS NULL)::BIGINT AS no_amount, count_if(type IS NULL)::BIGINT AS no_type, count(DISTINCT text) AS distinct_texts FROM done GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (), 6) AS share FROM g"""),
    "f15_calibration": (calibration, f"WITH {MSG}, {FOUND}, x AS (SELECT coalesce(category, 'none') AS category, ln(greatest(1.0, amount)) AS x FROM cat WHERE amount IS NOT NULL) SELECT category, count(*) AS n, round(avg(x), 6) AS mu, round(greatest(0.1, stddev_pop(x)), 6) AS sigma FROM x GROUP BY ROLLUP (category) HAVING count(*) >= 10"),
    "f16_bigrams": (bigrams, rf"""WITH {MSG}, w AS (SELECT regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM msg), t AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS n FROM t GROUP BY ALL"""),
    "f17_service_counters": (service_counters, f"""WITH {MSG}, {SCORED}, {CLASSED} SELECT strftime(done.ts, '%Y-%m') AS month, count(*) AS total, count(amount) AS extracted, count_if(classification = 'keep')::BIGINT AS kept, count_if(confidence = 'failed')::BIGINT AS failed
FROM done JOIN classed USING (msg_id) GROUP BY ALL"""),
    "g1_row_ids": (row_ids, "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders"),
    "g2_running_balance": (running_balance, f"""WITH {MSG} SELECT msg_id, cust_id, (c_acctbal::DECIMAL(18,2) + sum(CASE true_type WHEN 'credit' THEN true_amount::DECIMAL(18,2) WHEN 'debit' THEN -true_amount::DECIMAL(18,2) ELSE 0 END)
OVER (PARTITION BY cust_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS balance FROM msg JOIN customer ON cust_id = c_custkey"""),
    "g3_dedup_body": (dedup_body, "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1"),
    "g4_dedup_key": (dedup_key, "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate::DATE, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"),
    "g5_dedup_reference": (dedup_reference, f"""WITH {MSG}, {RAW}, x AS (SELECT msg_id, l_linenumber AS line_no, true_bank, reference FROM merch JOIN lineitem ON l_orderkey = msg_id)
SELECT msg_id, line_no, true_bank, reference FROM (SELECT *, row_number() OVER (PARTITION BY true_bank, reference ORDER BY msg_id, line_no) AS r FROM x) WHERE r = 1 OR reference IS NULL"""),
    "g6_sample_banks": (sample_banks, f"WITH {MSG} SELECT msg_id, true_bank FROM (SELECT *, row_number() OVER (PARTITION BY true_bank ORDER BY {_hash('msg_id', '42')}, msg_id) AS r FROM msg) WHERE r <= 20"),
    "g7_sample_n": (sample_n, f"WITH {MSG} SELECT msg_id FROM msg ORDER BY {_hash('msg_id', '42')}, msg_id LIMIT 50"),
    "g8_top_senders": (top_senders, f"WITH {MSG} SELECT sender, shop, count(*) AS n FROM msg GROUP BY ALL ORDER BY n DESC, sender, shop LIMIT 20"),
    "g10_combine_sets": (combine_sets, f"WITH {MSG} SELECT msg_id, CASE WHEN msg_id % 2 = 1 THEN 'v7' END AS origin, CASE WHEN {_hash('msg_id', '42')} < 0.9 THEN 'train' ELSE 'valid' END AS split FROM msg"),
    "g11_bank_presence": (bank_presence, f"WITH {MSG} SELECT {', '.join(f'''count_if(contains(upper(text), '{b}'))::BIGINT AS {b.lower()}''' for b in ('HDFC', 'ICICI', 'SBI', 'AXIS', 'KOTAK', 'PHONEPE', 'GPAY', 'PAYTM'))} FROM msg"),
    "j3_parse_responses": (parse_responses, f"""WITH {MSG} SELECT msg_id, CASE WHEN msg_id % 5 < 4 THEN {_RESP_AMT}::DOUBLE END AS amount, CASE WHEN msg_id % 5 < 4 THEN CASE WHEN msg_id % 2 = 0 THEN 'debit' ELSE 'credit' END END AS type,
CASE WHEN msg_id % 5 = 1 THEN 'Swiggy' END AS merchant, NULL::VARCHAR AS bank, CASE msg_id % 5 WHEN 0 THEN 'food' WHEN 3 THEN 'other' END AS category, msg_id % 5 = 4 AS says_nothing FROM msg"""),
    "j1_json_pieces": (json_pieces, f"""WITH {MSG}, r AS (SELECT msg_id, [
'{{"amount": ' || {_RESP_AMT} || ', "type": "' || {_RESP_KIND} || '", "category": "Dining"}}', 'Sure! {{''amount'': ''' || {_RESP_AMT} || ''', ''type'': ''' || {_RESP_KIND} || ''', ''merchant'': ''Swiggy'',}} Done.',
'{{amount: ' || {_RESP_AMT} || ', type: "' || {_RESP_KIND} || '", bank: None}}', '```json' || chr(10) || '{{"amount": "Rs. ' || {_RESP_AMT} || '", "type": "' || {_RESP_KIND} || '", "category": "gadgets"}}' || chr(10) || '```', 'unknown'][msg_id % 5 + 1] AS response FROM msg)
SELECT msg_id, nullif(regexp_extract(response, '(?s)\\{{.*\\}}', 0), '') AS outer_piece, nullif(regexp_extract(response, '\\{{[^{{}}]*\\}}', 0), '') AS flat_piece,
CASE WHEN msg_id % 5 IN (0, 3) THEN CASE WHEN msg_id % 2 = 0 THEN 'Debit' ELSE 'credited' END END AS strict_type FROM r"""),
    "j11_output_json": (output_json, None),
    "j_event_props": (event_props, "SELECT event_type, count(*) AS n, count_if(json_valid(props))::BIGINT AS n_parsed FROM events GROUP BY ALL"),
    "k6_training_examples": (training_examples, f"WITH {MSG}, {_TRAIN} SELECT msg_id, {_PROMPT} AS prompt, {_COMPLETION} AS completion, CASE WHEN {_hash('msg_id', '42')} < 0.9 THEN 'train' ELSE 'valid' END AS split FROM train"),
    "k4_prompts": (prompts, f"""WITH {MSG}, {_TRAIN}, p AS (SELECT CASE WHEN {_hash('msg_id', '42')} < 0.9 THEN 'train' ELSE 'valid' END AS split, length({_PROMPT}) AS a, length({_COMPLETION}) AS b FROM train)
SELECT split, 'system' AS role, count(*) AS n, (count(*) * length('You extract financial entities and answer in JSON.'))::BIGINT AS chars FROM p GROUP BY split
UNION ALL SELECT split, 'user', count(*), sum(a)::BIGINT FROM p GROUP BY split UNION ALL SELECT split, 'assistant', count(*), sum(b)::BIGINT FROM p GROUP BY split"""),
    "k5_exact_split": (exact_split, f"WITH {MSG}, r AS (SELECT msg_id, text, true_bank, row_number() OVER (ORDER BY {_hash('msg_id', '42')}, msg_id) AS r FROM msg) SELECT CASE WHEN r <= floor((SELECT count(*) FROM msg) * 0.95) THEN 'train' ELSE 'valid' END AS split, true_bank, count(*) AS n, sum(msg_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM r GROUP BY ALL"),
    "k7_auto_labels": (auto_labels, f"WITH {MSG}, {_AUTO} SELECT msg_id, source, subject, amount, type, confidence, verified FROM auto"),
    "k8_apply_reviews": (apply_reviews, f"""WITH {MSG}, {_AUTO}, r AS (SELECT *, o_orderpriority = '2-HIGH' AS done FROM auto JOIN orders ON msg_id = o_orderkey WHERE o_orderpriority <> '1-URGENT')
SELECT msg_id, CASE WHEN done THEN o_totalprice::DECIMAL(18,2)::VARCHAR ELSE amount END AS amount, CASE WHEN done AND msg_id % 3 = 0 THEN 'debit' ELSE type END AS type, verified OR done AS verified,
CASE WHEN done THEN 1.0 ELSE confidence END AS confidence, CASE WHEN done THEN strftime(o_orderdate, '%Y-%m-%d') END AS verified_at, CASE WHEN done THEN o_orderpriority END AS notes FROM r"""),
    "k10_noise": (noise, f"WITH {MSG} SELECT msg_id, {_noise()} AS noisy FROM msg"),
    "k11_augmented": (augmented, f"WITH {MSG} {_variants()}"),
    "k12_edge_oversample": (edge_oversample, f"""WITH {MSG}, {RAW}, w AS (SELECT msg_id, round({_TAGW} * 1000000)::HUGEINT AS w FROM merch), t AS (SELECT sum(w)::HUGEINT AS a, count(*)::HUGEINT AS n FROM w),
x AS (SELECT msg_id, w, sum(w) OVER (ORDER BY msg_id)::HUGEINT AS c FROM w) SELECT msg_id, copies FROM (SELECT msg_id, ((c * n + a // 2) // a - ((c - w) * n + a // 2) // a)::BIGINT AS copies FROM x, t) WHERE copies > 0"""),
    "k14_masked": (masked, f"WITH {MSG} SELECT msg_id, {_masked()} AS masked FROM msg"),
    "k2_weighted_choice": (weighted_choice, f"SELECT o_orderkey, CASE WHEN {_hash('o_orderkey', 'choice')} < 0.6 THEN 'plain' WHEN {_hash('o_orderkey', 'choice')} < 0.9 THEN 'short' ELSE 'long' END AS kind FROM orders"),
    "k17_multilingual": (multilingual, f"""WITH {MSG}, m AS (SELECT msg_id, ['en', 'hi', 'ta', 'xx'][msg_id % 4 + 1] AS lang, printf('%.2f', true_amount) || ' ' || true_type AS t FROM msg)
SELECT msg_id, lang, CASE lang WHEN 'hi' THEN 'रु.' || translate(t, '0123456789', '{_NATIVE["hi"]}') WHEN 'ta' THEN 'ரூ.' || translate(t, '0123456789', '{_NATIVE["ta"]}') ELSE 'Rs.' || t END AS text, true AS round_trip FROM m"""),
    "c22_table_rows": (table_rows, f"""WITH {_CELLS} SELECT doc, row_idx, date, description, coalesce(debit, credit) AS amount, CASE WHEN debit IS NOT NULL THEN 'debit' ELSE 'credit' END AS type, balance,
date || ' | ' || description || ' | ' || format('{{:,.2f}}', coalesce(debit, credit)) || ' | Rs ' || format('{{:,.2f}}', balance) AS raw_text FROM cells WHERE debit IS NOT NULL OR credit IS NOT NULL"""),
    "c21_column_map": (column_map, "SELECT 1::BIGINT AS at_date, 2::BIGINT AS at_description, 3::BIGINT AS at_debit, 4::BIGINT AS at_credit, 5::BIGINT AS at_balance, NULL::BIGINT AS at_reference, count(DISTINCT l_orderkey) AS n FROM lineitem"),
    "c24_text_lines": (text_lines, """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%d/%m/%Y') AS date, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount, round(l_quantity * 100, 2) AS balance,
CASE l_returnflag WHEN 'R' THEN 'debit' WHEN 'A' THEN 'credit' END AS type FROM lineitem"""),
    "c24_text_lines_compat": (text_lines_compat, "SELECT CASE l_returnflag WHEN 'R' THEN 'debit' WHEN 'A' THEN 'credit' END AS type, strftime(l_shipdate, '%d')::INTEGER AS day, count(*) AS n FROM lineitem GROUP BY ALL"),
    "m2_enriched": (enriched, f"""WITH {MSG}, {SCORED} SELECT msg_id, coalesce(merchant, CASE WHEN n THEN 'M' || length(text) % 7 END) AS merchant, coalesce(category, CASE WHEN n THEN 'food' END) AS category
FROM (SELECT *, amount IS NULL OR type IS NULL OR (merchant IS NULL)::INT + (category IS NULL)::INT + (date IS NULL)::INT + (reference IS NULL)::INT > 2 AS n FROM done)"""),
}
