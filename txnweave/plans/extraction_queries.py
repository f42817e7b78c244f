"""Extraction, normalisation, lookup and scoring queries over rendered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import extract as X
from ..functions import lookup, normalize, score
from ..operators import extraction, routing, rule_tables
from .messages import messages
from .oracle_base import MSG, by_priority, digits_only, first, first_label, has_any, in_order, lit, norm_date, rlike

# --- queries ------------------------------------------------------------------


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: render, extract, look up, score, aggregate."""
    out = extraction.extract_messages(messages(spark, d))
    return out.groupBy(F.coalesce("category", F.lit("none")).alias("category"), "confidence").agg(
        F.count("*").alias("n"), F.count("merchant").alias("n_merchant"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_amount")
    )


def render_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", "true_type", "true_account", "true_reference", "text", "sender", "subject")


def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(messages(spark, d).select("msg_id", "text")).drop("text")


def extract_compat(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(messages(spark, d).select("msg_id", "text"), compat=True).select("msg_id", "amount", "type")


def all_matches(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("msg_id", F.posexplode(X.all_matches(F.col("text"), "date")).alias("pos", "m"))
    return m.select("msg_id", "pos", F.col("m.value").alias("value"), F.col("m.priority").alias("priority"))


def string_extractor(spark: SparkSession, d: str) -> DataFrame:
    found = X.string_fields(F.col("text"))
    out = messages(spark, d).select("msg_id", *[c.alias(k) for k, c in found.items()])
    return out.select("*", F.round(score.string_score({k: F.col(k) for k in found}), 4).alias("score"))


def format_labels(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.label_fields(F.col("text")).items()])


def simple_labels(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.simple_label_fields(F.col("text")).items()])


def bank_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.patterns import first_label as label

    banked = messages(spark, d).select("msg_id", "text", label(F.lower("text"), X.CLEAN_BANKS).alias("bank"))
    return banked.select("msg_id", "bank", *[c.alias(k) for k, c in X.bank_label_fields(F.col("text"), F.col("bank")).items()])


def strict_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.patterns import first_label as label

    kept = messages(spark, d).where(routing.strict_filter(F.col("text")))
    bank = label(F.lower(F.concat_ws(" ", "text", "sender")), X.STRICT_BANKS)
    return kept.select("msg_id", bank.alias("bank"), *[c.alias(k) for k, c in X.strict_label_fields(F.col("text")).items()])


def discovery(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.discovery_fields(F.col("text")).items()])


def bank_detection(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.patterns import first_label as label

    low = F.lower("text")
    out = messages(spark, d).select(label(low, rules.KEYWORD_BANKS).alias("a"), label(low, X.CLEAN_BANKS).alias("b"), label(low, X.STRICT_BANKS).alias("c"))
    return out.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def classify(spark: SparkSession, d: str) -> DataFrame:
    return routing.with_class(messages(spark, d)).select("msg_id", "classification", "filter_reason")


def classify_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both readings of the one-time-password rule, every message."""
    compat, _ = routing.classify(F.col("text"), True)
    return routing.with_class(messages(spark, d)).select("classification", "filter_reason", compat.alias("compat")).groupBy("classification", "filter_reason", "compat").agg(F.count("*").alias("n"))


def mail_filters(spark: SparkSession, d: str) -> DataFrame:
    m, t = messages(spark, d), F.col("text")
    return m.select(
        "msg_id",
        routing.training_filter(F.col("subject"), t).alias("training"),
        routing.benchmark_filter(t).alias("benchmark"),
        routing.strict_filter(t).alias("strict"),
        routing.finance_filter(F.col("sender"), F.col("subject"), t).alias("finance"),
        routing.amount_and_verb(t).alias("amount_verb"),
        F.coalesce(routing.input_errors(F.col("subject"), t, F.col("sender")), F.lit("")).alias("input_error"),
    )


def length_bounds(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return routing.bounded(docs, "text").select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


def validity(spark: SparkSession, d: str) -> DataFrame:
    out = X.extract(messages(spark, d).select("msg_id", "text"))
    c = {k: F.col(k) for k in X.FIELDS}
    return out.select(
        "msg_id",
        score.valid_amount(c["amount"]).alias("amount_ok"),
        score.valid_date(c["date"]).alias("date_ok"),
        score.valid_reference(c["reference"]).alias("reference_ok"),
        score.valid_vpa(c["vpa"]).alias("vpa_ok"),
        (c["amount"].isNotNull() & c["type"].isNotNull()).alias("complete"),
        F.array_join(score.edge_tags(F.col("text"), c["amount"], c["type"]), ",").alias("edge_tags"),
    )


def completeness(spark: SparkSession, d: str) -> DataFrame:
    out = extraction.extract_messages(messages(spark, d).select("msg_id", "text"))
    c = {f: F.col(f) for f in score.WEIGHTS}
    n = sum((c[f].isNotNull().cast("int") for f in c), F.lit(0))
    return out.select(
        "msg_id",
        F.round(score.confidence_score(c), 6).alias("field_score"),
        F.round(score.completeness(c), 6).alias("completeness"),
        F.round("confidence_score", 6).alias("confidence_score"),
        "confidence",
        F.array_join(score.missing_fields(c), ",").alias("missing"),
        score.needs_enrichment(c).alias("needs_enrichment"),
        (n >= 2).alias("enough_entities"),
        F.element_at(score.source_summary(c), "merchant").alias("merchant_source"),
    )


def normalized(spark: SparkSession, d: str) -> DataFrame:
    out = X.extract(messages(spark, d).select("msg_id", "text"))
    return out.select(
        "msg_id",
        normalize.amount(F.concat(F.lit("Rs. "), F.format_number(F.col("amount").cast("decimal(18,2)"), 2))).alias("amount"),
        normalize.date(F.col("date")).alias("date"),
        normalize.account(F.concat(F.lit("XXXX-"), "account", F.lit("77")), True).alias("account"),
        normalize.reference(F.concat(F.lit("ref/ "), "reference")).alias("reference"),
        normalize.vpa(F.upper("vpa")).alias("vpa"),
        normalize.merchant(F.concat(F.lit(" Paid to UPI-"), "vpa")).alias("merchant"),
        normalize.txn_type(F.col("text")).alias("type"),
        normalize.category(F.when(F.col("msg_id") % 3 == 0, "Dining").when(F.col("msg_id") % 3 == 1, "salary").otherwise("zzz")).alias("category"),
        normalize.comparable(F.concat(F.lit(" "), F.col("amount").cast("decimal(18,2)").cast("string"), F.lit(" "))).alias("comparable"),
        normalize.comparable(F.col("amount").cast("decimal(18,2)").cast("string"), True).alias("comparable_compat"),
    )


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id",
        F.sha2(normalize.clean_mail(t), 256).alias("mail"),
        F.sha2(normalize.clean_mail_strict(t), 256).alias("strict"),
    )


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return m.select("msg_id", normalize.content_key(F.concat(F.lit(" \t"), F.upper("text"), F.lit("\n"))).alias("content_key"), F.substring(F.sha2("text", 256), 1, 16).alias("short_key"))


def money_formats(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", *[c.alias(k) for k, c in normalize.money(F.round(F.col("o_totalprice"), 2)).items()])


def date_formats(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    dates = normalize.written_dates(F.col("o_orderdate"), F.lit("1996-01-02"))
    accounts = normalize.account_styles(F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return o.select(
        "o_orderkey", *[c.alias(f"date_{k}") for k, c in dates.items()], *[c.alias(f"account_{k}") for k, c in accounts.items()],
        normalize.native_digits(F.col("o_orderkey").cast("string"), "hi").alias("hindi"),
        normalize.ascii_digits(normalize.native_digits(F.col("o_orderkey").cast("string"), "ta")).alias("back"),
        normalize.timestamp(F.concat(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("000"))).alias("from_millis"),
        normalize.timestamp(F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias("from_mail"),
        normalize.timestamp(F.lit("yesterday")).alias("unknown"),
    )


def merchant_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = messages(spark, d).select("msg_id", "text", by_vpa().alias("vpa"))
    merchant, category = lookup.merchant_and_category(F.col("vpa"), F.col("text"))
    return out.select("msg_id", "vpa", merchant.alias("merchant"), category.alias("category"), lookup.category_from_text(F.col("text")).alias("text_category"), lookup.app_from_vpa(F.col("vpa")).alias("app"))


def by_vpa():
    return X.fields(F.col("text"))["vpa"]


def merchant_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts against the merchant rules as a table: the first rule in order wins."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lower("p_name").alias("part_name"))
    rules = lookup.merchant_rules(spark).select("ord", F.col("key").alias("keyword"), F.col("category").alias("label"))
    return rule_tables.with_rules(parts, "part_name", rules).select("p_partkey", F.col("first_label").alias("category"), "n_rules")


def name_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" Pvt"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.upper("c_name"), F.lit(" CREDITED."))).otherwise(F.lit("Asha Rao"))
    named = c.select("c_custkey", name.alias("name"))
    return named.select("c_custkey", normalize.beneficiary(F.col("name")).alias("beneficiary"), lookup.is_merchant(F.col("name")).alias("is_merchant"))


def mail_classes(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    out = lookup.with_mail_class(m.select("msg_id", "subject", "sender", "text"), "subject", "sender", "text").drop("subject", "sender", "text")
    return out.select("*", ((F.col("category") == "finance") | F.col("is_transaction")).alias("is_financial")).drop("reason")


# --- oracle --------------------------------------------------------------------

_AMT = f"coalesce(try_cast({first('text', rules.AMOUNT_LAKH)} AS DOUBLE) * 100000, try_cast(replace({by_priority('text', rules.AMOUNT)}, ',', '') AS DOUBLE))"
_TYPE = f"CASE WHEN {rlike('text', rules.TYPE_DEBIT)} THEN 'debit' WHEN {rlike('text', rules.TYPE_CREDIT)} THEN 'credit' END"
FIELDS_SQL = f"""{_AMT} AS amount, {_TYPE} AS type, {by_priority('text', rules.DATE)} AS date, {by_priority('text', rules.REFERENCE)} AS reference,
{by_priority('text', rules.ACCOUNT)} AS account, {by_priority('text', rules.VPA)} AS vpa, {by_priority('text', rules.BANK)} AS bank, {by_priority('text', rules.PAYMENT_METHOD)} AS payment_method"""


def _merchant(vpa: str) -> str:
    user = f"split_part(lower(trim({vpa})), '@', 1)"
    exact = " ".join(f"WHEN {user} = {lit(k)} THEN {lit(n)}" for k, n, _ in rules.MERCHANTS)
    part = " ".join(f"WHEN contains({user}, {lit(k)}) THEN {lit(n)}" for k, n, _ in rules.MERCHANTS)
    return f"CASE {exact} {part} END"


def _merchant_category(m: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({m}), {lit(k)}) OR contains({lit(n.lower())}, lower({m})) THEN {lit(c)}" for k, n, c in rules.MERCHANTS) + " END"


def _text_category(t: str) -> str:
    """The label with most words; the first on ties."""
    sums = [f"({' + '.join(f'contains(lower({t}), {lit(w)})::INT' for w in ws)})" for ws in rules.CATEGORY_WORDS.values()]
    names = "[" + ", ".join(map(lit, rules.CATEGORY_WORDS)) + "]"
    return f"(SELECT CASE WHEN list_max(s) > 0 THEN {names}[list_position(s, list_max(s))] END FROM (SELECT [{', '.join(sums)}] AS s))"


RAW = f"raw AS (SELECT *, {FIELDS_SQL} FROM msg), merch AS (SELECT *, {_merchant('vpa')} AS merchant FROM raw)"
FOUND = f"{RAW}, cat AS (SELECT *, coalesce({_merchant_category('merchant')}, {_text_category('text')}) AS category FROM merch)"
from ..functions.score import TIERS, WEIGHTS, field_scores  # noqa: E402

_FS = field_scores(TIERS)
_TOP = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w * _FS[f]!r}::DOUBLE ELSE 0 END" for f, w in WEIGHTS.items())
_BOTTOM = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END" for f, w in WEIGHTS.items())
_COMPLETE = "0.7 * ((amount IS NOT NULL)::INT + (type IS NOT NULL)::INT) / 2.0 + 0.3 * ((merchant IS NOT NULL)::INT + (category IS NOT NULL)::INT + (date IS NOT NULL)::INT + (reference IS NOT NULL)::INT) / 4.0"
SCORED = f"""{FOUND}, part AS (
  SELECT *, CASE WHEN ({_BOTTOM}) > 0 THEN ({_TOP}) / ({_BOTTOM}) ELSE 0 END AS field_score, ({_COMPLETE})::DOUBLE AS completeness FROM cat
), scored AS (
  SELECT *, 0.7::DOUBLE * field_score + 0.3::DOUBLE * completeness AS confidence_score FROM part
), done AS (
  SELECT *, CASE WHEN confidence_score >= 0.9 THEN 'high' WHEN confidence_score >= 0.7 THEN 'medium' WHEN confidence_score > 0 THEN 'low' ELSE 'failed' END AS confidence FROM scored
)"""
_GARBAGE = " OR ".join(rlike("lower(text)", p, False) for p in routing.garbage_patterns())
_GARBAGE_COMPAT = " OR ".join(rlike("lower(text)", p, False) for p in rules.GARBAGE_PATTERNS)
_KEEP = " + ".join(f"{rlike('lower(text)', p, False)}::INT" for p in rules.KEEP_PATTERNS)


def _class(garbage: str) -> str:
    return f"CASE WHEN length(trim(text)) < 20 OR {garbage} THEN 'garbage' WHEN {_KEEP} >= 2 THEN 'keep' ELSE 'uncertain' END"


_REASON = f"""CASE WHEN length(trim(text)) < 20 THEN 'too_short' WHEN {_GARBAGE} THEN 'matched_garbage_pattern' WHEN {_KEEP} >= 2 THEN 'matched_transaction_pattern'
WHEN {rlike('lower(text)', routing.AMOUNT_SIGN, False)} THEN 'has_amount_no_transaction_type' ELSE 'no_strong_signals' END"""
CLASSED = f"classed AS (SELECT *, {_class(_GARBAGE)} AS classification, {_REASON} AS filter_reason, {_class(_GARBAGE_COMPAT)} AS compat FROM msg)"
_STRICT = f"(({' OR '.join(rlike('text', p) for p in routing.STRICT_KEEP)}) AND NOT ({' OR '.join(rlike('lower(text)', p, False) for p in routing.STRICT_DROP)}))"
_VERBS = has_any("lower(text)", ["debited", "credited", "sent", "received", "paid"])


def _string_fields() -> str:
    low = "lower(text)"
    return f"""replace({in_order('text', X.STRING_AMOUNT)}, ',', '') AS amount,
CASE WHEN {has_any(low, X.STRING_DEBIT)} THEN 'debit' WHEN {has_any(low, X.STRING_CREDIT)} THEN 'credit' END AS type,
right({in_order('text', X.STRING_ACCOUNT)}, 4) AS account, {in_order('text', X.STRING_DATE)} AS date, {in_order('text', X.STRING_REFERENCE)} AS reference,
{first_label(low, rules.KEYWORD_MERCHANTS)} AS merchant, {first_label(low, rules.KEYWORD_METHODS)} AS payment_method,
{first_label(low, rules.KEYWORD_CATEGORIES)} AS category, {first_label(low, rules.KEYWORD_BANKS)} AS bank, replace({first('text', X.BALANCE)}, ',', '') AS balance"""


def _initcap(c: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _beneficiary(c: str) -> str:
    cut = f"regexp_replace(regexp_replace(trim({c}), '(?i)\\s+credited\\.?$', ''), '(?i)\\s+debited\\.?$', '')"
    return f"trim(CASE WHEN upper({cut}) = {cut} AND regexp_matches({cut}, '[A-Z]') THEN {_initcap(cut)} ELSE {cut} END)"


def _is_merchant(c: str) -> str:
    return f"({has_any(f'lower(trim({c}))', lookup.MERCHANT_WORDS + lookup.COMPANY_FORMS)} OR (upper({c}) = {c} AND regexp_matches({c}, '[A-Z]') AND regexp_matches({c}, '[0-9]')))"


def _labels() -> str:
    d, c = rlike("text", X.LABEL_DEBIT), rlike("text", X.LABEL_CREDIT)
    part = lambda g: f"CASE WHEN {d} THEN {first('text', X.LABEL_DEBIT, g)} WHEN {c} THEN {first('text', X.LABEL_CREDIT, g)} END"
    either = lambda g, other: f"CASE WHEN {d} OR {c} THEN {part(g)} ELSE {other} END"
    name = _beneficiary(part(4))
    return f"""try_cast(replace({either(2, first('text', X.LABEL_AMOUNT))}, ',', '') AS DOUBLE) AS amount,
CASE WHEN {d} THEN 'debit' WHEN {c} THEN 'credit' WHEN {rlike('text', chr(92) + 'bdebit')} THEN 'debit' WHEN {rlike('text', chr(92) + 'bcredit')} THEN 'credit' END AS type,
{either(1, first('text', X.LABEL_ACCOUNT))} AS account, {either(3, first('text', X.LABEL_DATE, 1, False))} AS date, {either(5, first('text', X.LABEL_REFERENCE))} AS reference,
{name} AS beneficiary, coalesce({_is_merchant(name)}, false) AS is_merchant,
CASE WHEN {d} THEN 'icici_debit_pattern' WHEN {c} THEN 'icici_credit_pattern' ELSE 'generic_fallback' END AS extraction_method"""


def _bank_part(i: int) -> str:
    apps = ", ".join(map(lit, X.APPS))
    whens = f"WHEN bank IN ({apps}) THEN {first('text', X.APP_FORMAT[i][0], 1, X.APP_FORMAT[i][1])} "
    return "CASE " + whens + " ".join(f"WHEN bank = {lit(b)} THEN {first('text', f[i][0], 1, f[i][1])}" for b, f in X.BANK_FORMATS.items()) + " END"


def _money() -> str:
    v = "round(o_totalprice, 2)::DECIMAL(18,2)"
    whole = f"floor({v})::BIGINT"
    cents = f"lpad((({v} * 100)::BIGINT - {whole} * 100)::VARCHAR, 2, '0')"
    indian = f"(CASE WHEN length({whole}::VARCHAR) <= 3 THEN {whole}::VARCHAR ELSE regexp_replace(reverse(regexp_replace(reverse({whole}::VARCHAR)[4:], '(\\d\\d)', '\\1,', 'g')), '^,', '') || ',' || right({whole}::VARCHAR, 3) END)"
    scaled = lambda by, u: f"(round({v}::DECIMAL(30,10) / {by}, 1)::DECIMAL(18,1))::VARCHAR || '{u}'"
    return f"""{whole}::VARCHAR AS integer, {whole}::VARCHAR || '.' || {cents} AS two_places, (round({v}, 1)::DECIMAL(18,1))::VARCHAR AS one_place,
format('{{:,}}', {whole}) || '.' || {cents} AS commas, {indian} || '.' || {cents} AS indian, {indian} AS indian_whole,
CASE WHEN {v} >= 10000000 THEN {scaled(10000000, 'Cr')} WHEN {v} >= 100000 THEN {scaled(100000, 'L')} WHEN {v} >= 1000 THEN {scaled(1000, 'K')} ELSE {whole}::VARCHAR END AS compact,
lpad({whole}::VARCHAR, 8, '0') || '.' || {cents} AS padded"""


def _mail_classes() -> str:
    everything, who = "lower(concat_ws(' ', subject, sender, text))", "lower(sender)"
    sums = []
    for senders, words in rules.MAIL_CATEGORIES.values():
        n = " + ".join([*[f"3 * contains({who}, {lit(w)})::INT" for w in senders], *[f"contains({everything}, {lit(w)})::INT" for w in words]])
        sums.append(f"({n})")
    names = "[" + ", ".join(map(lit, rules.MAIL_CATEGORIES)) + "]"
    return f"""s AS (SELECT msg_id, [{', '.join(sums)}] AS s, {has_any(everything, rules.TRANSACTION_WORDS)} AS is_transaction FROM msg),
b AS (SELECT msg_id, is_transaction, list_max(s) AS score, CASE WHEN list_max(s) > 0 THEN {names}[list_position(s, list_max(s))] ELSE 'other' END AS category FROM s)
SELECT msg_id, category, score::INTEGER AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, is_transaction,
category = 'finance' OR is_transaction AS is_financial FROM b"""


_DATE_SQL = {"dmy": "%d-%m-%y", "dmy_long": "%d-%m-%Y", "slashes": "%d/%m/%y", "slashes_long": "%d/%m/%Y", "month": "%d %b %y", "month_long": "%d %b %Y", "dashed_month": "%d-%b-%y", "iso": "%Y-%m-%d", "compact": "%d%m%Y", "us": "%b %d, %Y"}
_ALL_DATES = " UNION ALL ".join(
    f"SELECT msg_id, {n} AS priority, {i} AS k, unnest(range(len(v))) AS j, unnest(v) AS value FROM (SELECT msg_id, regexp_extract_all(text, {lit('(?i)' + p)}, 1) AS v FROM msg)"
    for i, (p, n) in enumerate(sorted(rules.FIELD_PATTERNS["date"], key=lambda x: -x[1]))
)

QUERIES = {
    "category_summary": (category_summary, f"WITH {MSG}, {SCORED} SELECT coalesce(category, 'none') AS category, confidence, count(*) AS n, count(merchant) AS n_merchant, sum(amount::DECIMAL(18,2))::DOUBLE AS total_amount FROM done GROUP BY ALL"),
    "k1_render_messages": (render_messages, f"WITH {MSG} SELECT msg_id, true_type, true_account, true_reference, text, sender, subject FROM msg"),
    "c10_extract_fields": (extract_fields, f"WITH {MSG} SELECT msg_id, {FIELDS_SQL} FROM msg"),
    "c10_extract_compat": (extract_compat, f"WITH {MSG} SELECT msg_id, {_AMT} AS amount, {_TYPE} AS type FROM msg"),
    "c11_all_matches": (all_matches, f"WITH {MSG}, m AS ({_ALL_DATES}) SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY k, j) - 1)::INTEGER AS pos, value, priority FROM m"),
    "c12_string_extractor": (string_extractor, f"WITH {MSG}, f AS (SELECT msg_id, {_string_fields()} FROM msg) SELECT *, round(0.6::DOUBLE * ((amount IS NOT NULL)::INT + (type IS NOT NULL)::INT) / 2 + 0.4::DOUBLE * ((account IS NOT NULL)::INT + (date IS NOT NULL)::INT + (reference IS NOT NULL)::INT + (merchant IS NOT NULL)::INT + (category IS NOT NULL)::INT) / 5, 4) AS score FROM f"),
    "c15_format_labels": (format_labels, f"WITH {MSG} SELECT msg_id, {_labels()} FROM msg"),
    "c16_simple_labels": (simple_labels, f"""WITH {MSG} SELECT msg_id, {first_label('lower(text)', X.SIMPLE_BANKS)} AS bank,
CASE WHEN {has_any('lower(text)', ['debited', 'sent', 'paid'])} THEN 'debit' WHEN {has_any('lower(text)', ['credited', 'received'])} THEN 'credit' END AS type,
replace({in_order('text', X.SIMPLE_AMOUNT)}, ',', '') AS amount, {in_order('text', X.SIMPLE_ACCOUNT)} AS account, {in_order('text', X.SIMPLE_DATE)} AS date, {in_order('text', X.SIMPLE_REFERENCE)} AS reference,
coalesce(lower(trim({first('text', X.SIMPLE_MERCHANT, 2, False)})), {first_label('lower(text)', {m: [m] for m in X.SIMPLE_MERCHANTS})}) AS merchant FROM msg"""),
    "c17_bank_labels": (bank_labels, f"""WITH {MSG}, b AS (SELECT *, {first_label('lower(text)', X.CLEAN_BANKS)} AS bank FROM msg)
SELECT msg_id, bank, replace({in_order('text', X.SIMPLE_AMOUNT[:3])}, ',', '') AS amount,
CASE WHEN {has_any('lower(text)', X.CLEAN_DEBIT)} THEN 'debit' WHEN {has_any('lower(text)', X.CLEAN_CREDIT)} THEN 'credit' END AS type,
{_bank_part(0)} AS account, {_bank_part(1)} AS date, {_bank_part(2)} AS reference FROM b"""),
    "c18_strict_labels": (strict_labels, f"""WITH {MSG} SELECT msg_id, {first_label("lower(text || ' ' || sender)", X.STRICT_BANKS)} AS bank, replace({in_order('text', X.STRICT_AMOUNT)}, ',', '') AS amount,
CASE WHEN contains(lower(text), 'debited') THEN 'debit' WHEN contains(lower(text), 'credited') THEN 'credit' END AS type, {first('text', X.STRICT_ACCOUNT)} AS account,
{first('text', X.STRICT_DATE, 1, False)} AS date, {in_order('text', X.STRICT_REFERENCE)} AS reference FROM msg WHERE {_STRICT}"""),
    "c19_discovery": (discovery, f"""WITH {MSG} SELECT msg_id, replace({first('text', '(?:Rs' + chr(92) + '.?|₹)' + chr(92) + 's*([' + chr(92) + 'd,]+(?:' + chr(92) + '.' + chr(92) + 'd{2})?)', 1, False)}, ',', '') AS amount,
nullif(regexp_extract(text, '(?i)(?:A/c|account)\\s*(?:no\\.?)?\\s*[:\\s]*(\\w+)', 1), '') AS account, nullif(regexp_extract(text, '(\\d{{2}}[-/]\\d{{2}}[-/]\\d{{2,4}})', 1), '') AS date,
nullif(regexp_extract(text, '(?i)(?:ref|reference)\\s*(?:no\\.?)?[:\\s]*(\\d+)', 1), '') AS reference,
CASE WHEN contains(lower(text), 'debit') THEN 'debit' WHEN contains(lower(text), 'credit') THEN 'credit' END AS type FROM msg"""),
    "c20_bank_detection": (bank_detection, f"WITH {MSG} SELECT {first_label('lower(text)', rules.KEYWORD_BANKS)} AS a, {first_label('lower(text)', X.CLEAN_BANKS)} AS b, {first_label('lower(text)', X.STRICT_BANKS)} AS c, count(*) AS n FROM msg GROUP BY ALL"),
    "b3_classify": (classify, f"WITH {MSG}, {CLASSED} SELECT msg_id, classification, filter_reason FROM classed"),
    "b1_classify_counts": (classify_counts, f"WITH {MSG}, {CLASSED} SELECT classification, filter_reason, compat, count(*) AS n FROM classed GROUP BY ALL"),
    "b5_mail_filters": (mail_filters, f"""WITH {MSG} SELECT msg_id, {has_any("lower(concat_ws(' ', subject, text))", ['debited', 'credited', 'payment of', 'transferred'])} AND {has_any("lower(concat_ws(' ', subject, text))", ['rs', '₹'])} AS training,
length(text) >= 50 AND {_VERBS} AND {has_any('lower(text)', ['rs', 'inr', '₹'])} AS benchmark, {_STRICT} AS strict,
{has_any("lower(concat_ws(' ', sender, subject))", routing.FINANCE_SENDERS)} OR {has_any("lower(concat_ws(' ', sender, subject, text))", routing.FINANCE_WORDS)} AS finance,
{_VERBS} AND regexp_matches(lower(text), '(?:rs\\.?|₹)\\s*[\\d,]+') AS amount_verb, '' AS input_error FROM msg"""),
    "b10_length_bounds": (length_bounds, "SELECT doc_id, length(substr(text, 1, 5000))::BIGINT AS n, sha256(substr(text, 1, 5000)) AS digest FROM documents WHERE length(text) >= 50"),
    "b12_validity": (validity, f"""WITH {MSG}, {RAW} SELECT msg_id, coalesce(amount > 0, false) AS amount_ok, coalesce(regexp_matches(date, '^\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}'), false) AS date_ok,
coalesce(length(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')) >= 10, false) AS reference_ok, coalesce(regexp_matches(vpa, '^[a-zA-Z0-9._-]+@[a-zA-Z0-9]+$'), false) AS vpa_ok,
amount IS NOT NULL AND type IS NOT NULL AS complete,
array_to_string(list_filter([CASE WHEN contains(lower(text), 'failed') THEN 'failed_txn' END, CASE WHEN contains(lower(text), 'pending') THEN 'pending_txn' END, CASE WHEN amount > 100000 THEN 'large_amount' END, CASE WHEN amount < 10 THEN 'small_amount' END,
CASE WHEN strlen(text) > length(text) THEN 'unicode' END, CASE WHEN type = 'credit' THEN 'credit' END], lambda x: x IS NOT NULL), ',') AS edge_tags FROM merch"""),
    "f18_confidence": (completeness, f"""WITH {MSG}, {SCORED} SELECT msg_id, round(field_score, 6) AS field_score, round(completeness, 6) AS completeness, round(confidence_score, 6) AS confidence_score, confidence,
array_to_string(list_filter([{', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in ('amount', 'type', 'merchant', 'category', 'date', 'reference'))}], lambda x: x IS NOT NULL), ',') AS missing,
amount IS NULL OR type IS NULL OR (merchant IS NULL)::INT + (category IS NULL)::INT + (date IS NULL)::INT + (reference IS NULL)::INT > 2 AS needs_enrichment,
{' + '.join(f'({f} IS NOT NULL)::INT' for f in WEIGHTS)} >= 2 AS enough_entities, CASE WHEN merchant IS NULL THEN 'missing' ELSE 'rules (85%)' END AS merchant_source FROM done"""),
    "d1_normalize": (normalized, f"""WITH {MSG}, {RAW} SELECT msg_id, amount::DECIMAL(18,2)::DOUBLE AS amount, {norm_date('date')} AS date,
CASE WHEN account IS NOT NULL THEN repeat('*', length({digits_only("account || '77'")}) - 4) || right({digits_only("account || '77'")}, 4) END AS account,
regexp_replace('ref/ ' || reference, '[^A-Za-z0-9]', '', 'g') AS reference, lower(vpa) AS vpa, vpa AS merchant,
CASE WHEN {has_any('lower(text)', normalize.DEBIT_WORDS)} THEN 'debit' WHEN {has_any('lower(text)', normalize.CREDIT_WORDS)} THEN 'credit' END AS type,
CASE msg_id % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'salary' ELSE 'other' END AS category, amount::DECIMAL(18,2)::VARCHAR AS comparable,
regexp_replace(regexp_replace(amount::DECIMAL(18,2)::VARCHAR, '0+$', ''), '\\.+$', '') AS comparable_compat FROM merch"""),
    "d8_text_cleaning": (text_cleaning, r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '\s+', ' ', 'g'), '\S{100,}', '', 'g'))) AS mail,
sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '\s+', ' ', 'g'), '\S{80,}', '', 'g'))) AS strict FROM documents"""),
    "d11_content_keys": (content_keys, f"WITH {MSG} SELECT msg_id, sha256(lower(text)) AS content_key, substr(sha256(text), 1, 16) AS short_key FROM msg"),
    "d13_money_formats": (money_formats, f"SELECT o_orderkey, {_money()} FROM orders"),
    "d14_date_formats": (date_formats, f"""SELECT o_orderkey, {', '.join(f"strftime(o_orderdate, '{f}') AS date_{k}" for k, f in _DATE_SQL.items())},
CASE date_diff('day', o_orderdate::DATE, DATE '1996-01-02') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS date_relative,
{', '.join(f"'{m}' || right(lpad(o_custkey::VARCHAR, 8, '0'), 4) AS account_{k}" for k, m in normalize.ACCOUNT_STYLES.items())},
translate(o_orderkey::VARCHAR, '0123456789', '{normalize.NATIVE_DIGITS["hi"]}') AS hindi, o_orderkey::VARCHAR AS back,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS from_millis, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS from_mail, 'yesterday' AS unknown FROM orders"""),
    "e1_merchant_lookup": (merchant_lookup, f"""WITH {MSG}, {FOUND} SELECT msg_id, vpa, merchant, category, {_text_category('text')} AS text_category,
CASE lower(split_part(vpa, '@', 2)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.VPA_APPS.items())} END AS app FROM cat"""),
    "e2_merchant_join": (merchant_join, f"""WITH r(ord, key, category) AS (VALUES {', '.join(f"({i}, {lit(k)}, {lit(c)})" for i, (k, _, c) in enumerate(rules.MERCHANTS))})
SELECT p_partkey, min_by(category, ord) AS category, count(key) AS n_rules FROM part LEFT JOIN r ON contains(lower(p_name), key) GROUP BY p_partkey"""),
    "e7_name_kinds": (name_kinds, f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' Pvt' WHEN 1 THEN upper(c_name) || ' CREDITED.' ELSE 'Asha Rao' END AS name FROM customer)
SELECT c_custkey, {_beneficiary('name')} AS beneficiary, {_is_merchant('name')} AS is_merchant FROM n"""),
    "e8_mail_classes": (mail_classes, f"WITH {MSG}, {_mail_classes()}"),
}
