"""Queries over rule, weight, template and layout tables, stores of results, benchmark sets and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats, rules, sources
from ..functions import extract as X
from ..functions import lookup, normalize, sql
from ..functions.patterns import folded
from ..operators import datasets as D
from ..operators import extraction, ranges, reports, rule_tables, store, templates
from ..operators import statements as S
from ..scratch import new_folder, written
from .dataset_queries import _AUTO, _hash, auto_labels, docs
from .extraction_queries import RAW, SCORED, _bank_part, _labels, _mail_classes, _text_category
from .messages import HANDLES, SHOPS, messages, spread
from .oracle_base import MSG, array, clean_corpus, has_any, in_order, lit
from .oracle_base import first_label as sql_label

# --- rule tables -----------------------------------------------------------------------------


def word_rules(spark: SparkSession, d: str) -> DataFrame:
    """(ord, keyword, label, weight): the words of the benchmark, from their last letters on."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("keyword")).where("length(keyword) >= 3").distinct()
    ranked = ranges.global_rank(words.select("keyword", F.reverse("keyword").alias("back")), [F.col("back")], "ord")
    return ranked.select("ord", "keyword", F.concat(F.lit("L"), (F.col("ord") % 11).cast("string")).alias("label"), (1 + F.length("keyword") % 4).cast("double").alias("weight"))


def rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a table of keyword rules: the first rule, their number, and the label of the largest weight."""
    x = docs(spark, d).select("doc_id", F.lower("text").alias("low"))
    return rule_tables.with_rules(x, "low", word_rules(spark, d)).drop("low", "exact_label")


def merchant_tables(spark: SparkSession, d: str) -> DataFrame:
    """Addresses to merchants (the exact key, else the first that the user part holds) and merchants to categories (the first whose key the merchant holds or whose name holds the merchant), by the merchants' table."""
    table = lookup.merchant_rules(spark)
    m = X.extract(messages(spark, d).select("msg_id", "text")).select("msg_id", "vpa", lookup.vpa_user(F.col("vpa")).alias("user"))
    x = rule_tables.with_rules(m, "user", table.select("ord", F.col("key").alias("keyword"), F.col("name").alias("label")))
    x = x.select("msg_id", "vpa", F.coalesce("exact_label", "first_label").alias("merchant"), F.col("n_rules").alias("keys")).withColumn("low", F.lower("merchant"))
    y = rule_tables.with_rules(x, "low", table.select("ord", F.col("key").alias("keyword"), F.col("category").alias("label"), F.lower("name").alias("name")))
    return y.select("msg_id", "vpa", "merchant", "keys", F.col("first_label").alias("category"), F.col("n_rules").alias("rules"))


def mail_rule_tables(spark: SparkSession, d: str) -> DataFrame:
    """Mail classes and text categories with their words as tables: senders' words count three times, and all are looked for at once."""
    m = messages(spark, d).select("msg_id", F.lower("sender").alias("who"), F.lower(F.concat_ws(" ", "subject", "sender", "text")).alias("everything"), F.lower("text").alias("low"))
    place = {c: 1000 * i for i, c in enumerate(rules.MAIL_CATEGORIES)}
    table = lambda at, weight: reduce(DataFrame.unionByName, [rule_tables.keyword_table(spark, {c: words[at]}, weight, place[c] + 500 * at) for c, words in rules.MAIL_CATEGORIES.items()])
    x = rule_tables.with_rules(m, "everything", table(1, 1.0), ("who", table(0, 3.0)))
    x = x.select("msg_id", "low", F.coalesce("best_label", F.lit("other")).alias("category"), F.coalesce("best_score", F.lit(0.0)).cast("int").alias("score"))
    y = rule_tables.with_rules(x, "low", rule_tables.keyword_table(spark, rules.CATEGORY_WORDS))
    y = y.select("msg_id", "low", "category", "score", F.col("best_label").alias("text_category"))
    z = rule_tables.with_rules(y, "low", rule_tables.keyword_table(spark, X.CLEAN_BANKS))
    return z.select("msg_id", "category", "score", "text_category", F.col("first_label").alias("bank"))


def all_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every match of every pattern of all eight fields."""
    named = lambda f: lambda m, i: F.struct(F.lit(f).alias("field"), i.alias("pos"), m["value"].alias("value"), m["priority"].alias("priority"))
    each = [F.transform(X.all_matches(F.col("text"), f, F.col("low")), named(f)) for f in rules.FIELD_PATTERNS]
    return messages(spark, d).select("msg_id", "text", folded(F.col("text")).alias("low")).select("msg_id", F.explode(F.flatten(F.array(*each))).alias("m")).select("msg_id", "m.*")


def matches_function(spark: SparkSession, d: str) -> DataFrame:
    """The same through SQL's table function."""
    sql.register(spark)
    messages(spark, d).select("msg_id", "text").createOrReplaceTempView("txn_messages")
    return spark.sql("SELECT field, priority, count(*) AS n, count(DISTINCT value) AS n_values FROM txn_messages, LATERAL txn_matches(text) GROUP BY field, priority")


# --- weights, templates, layouts ---------------------------------------------------------------

KINDS = ["plain", "short", "long", "formal"]


def weight_table(spark: SparkSession, d: str) -> DataFrame:
    """(bank, type, choice, weight) from what orders of each bank and type are worth."""
    o = messages(spark, d).select(F.col("true_bank").alias("bank"), F.col("true_type").alias("type"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("msg_id") % len(KINDS) + 1).cast("int")).alias("choice"))
    return o.groupBy("bank", "type", "choice").agg(F.count("*").cast("double").alias("weight"))


def weighted_table(spark: SparkSession, d: str) -> DataFrame:
    """A choice for each message by the weights of its bank and type."""
    m = messages(spark, d).select("msg_id", F.col("true_bank").alias("bank"), F.col("true_type").alias("type"), "sender")
    return rule_tables.weighted_choice(m, ["bank", "type"], D.unit_hash(F.col("msg_id"), "pick"), weight_table(spark, d))


MESSAGE_KINDS = ["debit", "credit", "otp", "balance", "unknown"]


def languages(spark: SparkSession, d: str) -> DataFrame:
    """Four kinds of messages in eight languages and one without templates; native digits for every other row, and back."""
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c + 1).cast("int"))
    m = messages(spark, d)
    key = F.col("msg_id")
    f = m.select(
        "msg_id", pick(MESSAGE_KINDS, key % len(MESSAGE_KINDS)).alias("kind"), pick([*formats.LANGUAGES, "klingon"], F.floor(key / 5) % (len(formats.LANGUAGES) + 1)).alias("language"),
        "true_bank", "true_amount", "true_account", "true_reference", "ts", F.concat_ws("@", "shop", "handle").alias("vpa"), "sender",
    )
    values = {"bank": F.col("true_bank"), "amount": F.col("true_amount"), "balance": F.col("true_amount") * 3, "account": F.col("true_account"), "date": F.col("ts"), "vpa": F.col("vpa"), "ref": F.col("true_reference"), "sender": F.col("sender"), "otp": F.col("true_reference")}
    table = templates.language_templates(spark)
    plain = templates.render_languages(f, "kind", "language", values, table).withColumnRenamed("text", "plain")
    out = templates.render_languages(plain, "kind", "language", values, table, native=key % 2 == 0)
    return out.select("msg_id", "kind", "language", "text", (normalize.ascii_digits(F.col("text")) == F.col("plain")).alias("round_trip"))


SOURCES = [*formats.LAYOUTS]
STATUSES = ["Success", "Failed", "Pending"]


def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    """A transaction for each order, with the running balance of its account."""
    o = spread(spark, spark.read.parquet(f"{d}/orders.parquet"))
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c + 1).cast("int"))
    key, amount = F.col("o_orderkey"), F.round("o_totalprice", 2).cast("decimal(18,2)")
    credit = F.col("o_orderstatus") != "F"
    shop = pick(SHOPS, key % len(SHOPS))
    f = o.select(
        key.alias("msg_id"), F.col("o_custkey").alias("account"), pick(SOURCES, F.col("o_custkey") % len(SOURCES)).alias("source"), F.col("o_orderdate").alias("date"),
        F.concat(F.lit("UPI-"), shop, F.lit("@ybl-"), F.lpad(key.cast("string"), 9, "0")).alias("description"), F.initcap(shop).alias("merchant"), amount.alias("amount"),
        F.when(credit, "credit").otherwise("debit").alias("type"), F.lpad(key.cast("string"), 12, "0").alias("reference"), pick(STATUSES, key % 3).alias("status"),
        F.concat(shop, F.lit("@"), pick(HANDLES, key % len(HANDLES))).alias("vpa"), F.when(credit, amount).otherwise(-amount).alias("signed"),
    )
    return D.running_balance(f, "account", ["date", "msg_id"], F.col("signed"), F.lit(1000000).cast("decimal(18,2)"))


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Facts as rows of their bank's or app's layouts, and what the layouts' parsers read back."""
    table = templates.layouts(spark)
    rows = templates.statement_rows(statement_facts(spark, d), table, "msg_id").select("msg_id", "source", "raw_text")
    return templates.parse_statement_rows(rows, "source", "raw_text", table).withColumn("layout_no", F.col("layout_no").cast("long"))


# --- results kept between runs -------------------------------------------------------------------


def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over a store: the second extracts only what the first has not seen."""
    kept = store.ResultStore(spark, new_folder(spark, "store"), "amount double, type string, reference string", buckets=8)
    m = messages(spark, d)
    kept.results(m.where("variant < 9"), X.extract)
    out = kept.results(m, X.extract)
    return out.groupBy("reused").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"), F.count("reference").alias("n_reference"))


# --- benchmark sets, exports, reports --------------------------------------------------------------


def simple_benchmark(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("msg_id", "text")
    out = reports.simple_set(m.where("msg_id % 4 != 0"), "msg_id", "text", m.where("msg_id % 4 = 0"))
    return out.select("id", "msg_id", "bank", "type", "amount", "account", "date", "reference", "merchant", "verified")


def clean_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Messages come once for each line of their order, so references repeat."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("msg_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    m = messages(spark, d).select("msg_id", "text", "sender").join(li, "msg_id")
    return reports.clean_set(m, "row_no", "text", "sender").select("id", "row_no", "bank", "amount", "type", "account", "date", "reference")


def export_verified(spark: SparkSession, d: str) -> DataFrame:
    """Exports of verified and of all labels, in seeded order."""
    parts = []
    labels = written(auto_labels(spark, d), "labels")
    for only in (True, False):
        path = new_folder(spark, "verified")
        reports.export_labelled(labels, "msg_id", F.col("subject"), F.to_json(F.struct("msg_id", "amount", "type")), path, only)
        back = spark.read.schema("place long, input string, output string, split string").json(path)
        parts.append(back.select(F.lit(only).alias("verified_only"), "split", "place", F.get_json_object("output", "$.msg_id").cast("long").alias("msg_id"), "input"))
    return parts[0].unionByName(parts[1])


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Messages, and one line of each order's messages again: above the share of duplicates that warns."""
    f = extraction.extract_messages(messages(spark, d))
    again = f.unionByName(f.where("msg_id % 50 = 0"))
    low = F.lower("text")
    status = F.when(F.contains(low, F.lit("failed")), "failed").when(F.contains(low, F.lit("out for delivery")), "pending").otherwise("success")
    out = reports.validation_report(again, "msg_id", F.col("text"), F.col("true_type") != "", {"amount": F.col("amount"), "type": F.col("type")}, {"category": F.col("category"), "status": status, "type": F.col("type")})
    return out.select("section", "name", "n", F.round("share", 9).alias("share"))


def word_transitions(spark: SparkSession, d: str) -> DataFrame:
    return reports.transitions(messages(spark, d), "text")


def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """Mail, chat, text files, statement rows and a glossary's sections: each cleaned text's digest and words."""
    path = new_folder(spark, "glossary")
    glossary = docs(spark, d).where("text IS NOT NULL").select(F.concat("text", F.lit("\n\n"), "lang", F.lit("\n\n"), "text").alias("value"))
    spread(spark, glossary).write.option("lineSep", "\x01").text(path)
    read = spark.read.option("lineSep", "\x01").text(path).select(F.col("value").alias("text"))
    parts = [
        messages(spark, d).select("text", F.lit("mail").alias("source")),
        spark.read.parquet(f"{d}/conversations.parquet").select("text", F.lit("chat").alias("source")),
        docs(spark, d).select("text", F.lit("file").alias("source")),
        templates.statement_rows(statement_facts(spark, d), templates.layouts(spark), "msg_id").select(F.col("raw_text").alias("text"), F.lit("statement").alias("source")),
        sources.sections(read, "text").select(F.col("section").alias("text"), F.lit("glossary").alias("source")),
    ]
    return sources.corpus(parts).groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.max("word_count").cast("long").alias("words"))


def output_json(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth as JSON without nulls, its flags, and the entity map of each row."""
    x = messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.label_fields(F.col("text")).items()])
    truth = F.to_json(F.struct("amount", "type", "account", "date", "reference", "beneficiary", F.col("is_merchant").alias("is_p2m")))
    ents = S.entities({k: F.col(k) for k in ("account", "date", "reference")})
    have = lambda c: F.col(c).isNotNull()
    return x.select(
        "msg_id", truth.alias("ground_truth"), (have("amount") & have("type") & have("reference")).alias("complete_extraction"), F.coalesce(F.length("beneficiary") > 0, F.lit(False)).alias("has_beneficiary"),
        F.size(ents).alias("n_entities"), F.element_at(ents, "account").alias("account"), F.element_at(ents, "date").alias("date"), F.element_at(ents, "reference").alias("reference"),
    )


# --- the same in SQL -----------------------------------------------------------------------------

_RULES = """words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark),
rules AS (SELECT row_number() OVER (ORDER BY reverse(keyword)) AS ord, keyword, 'L' || (row_number() OVER (ORDER BY reverse(keyword)) % 11) AS label, (1 + length(keyword) % 4)::DOUBLE AS weight FROM words WHERE length(keyword) >= 3)"""

_CLEAN = clean_corpus("text")


def _fill(template: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', coalesce({value}, ''))"
    return template


def _language_sql() -> str:
    values = {"bank": "true_bank", "amount": "printf('%.2f', true_amount)", "balance": "printf('%.2f', true_amount * 3)", "account": "true_account", "date": "strftime(ts, '%d-%m-%Y')", "vpa": "shop || '@' || handle", "ref": "true_reference", "sender": "sender", "otp": "right(true_reference, 6)"}
    rows = ", ".join(f"({lit(k)}, {lit(n)}, {lit(t)})" for k, n, t in formats.LANGUAGE_TEMPLATES)
    turned = "CASE language " + " ".join(f"WHEN '{n}' THEN translate(plain, '0123456789', '{normalize.NATIVE_DIGITS[c]}')" for n, c in formats.DIGITS.items()) + " ELSE plain END"
    return f"""WITH {MSG}, t(kind, language, template) AS (VALUES {rows}),
m AS (SELECT *, ({array(MESSAGE_KINDS)})[msg_id % 5 + 1] AS kind, ({array([*formats.LANGUAGES, 'klingon'])})[(msg_id // 5) % 9 + 1] AS language FROM msg),
f AS (SELECT msg_id, m.kind, m.language, {_fill("coalesce(a.template, b.template)", values)} AS plain FROM m LEFT JOIN t a ON a.kind = m.kind AND a.language = m.language LEFT JOIN t b ON b.kind = m.kind AND b.language = 'english')
SELECT msg_id, kind, language, CASE WHEN msg_id % 2 = 0 THEN {turned} ELSE plain END AS text, plain = plain AS round_trip FROM f"""


def _facts_sql() -> str:
    layouts = [(s, i, x) for s, xs in formats.LAYOUTS.items() for i, x in enumerate(xs)]
    sizes = " ".join(f"WHEN '{s}' THEN {len(xs)}" for s, xs in formats.LAYOUTS.items())
    word = lambda words: "CASE source " + " ".join(f"WHEN '{s}' THEN CASE WHEN type = 'credit' THEN '{c}' ELSE '{x}' END" for s, (c, x) in words.items()) + " ELSE '' END"
    money = lambda c: f"format('{{:,.2f}}', {c}::DOUBLE)"
    values = {
        "date": "strftime(date, '%d/%m/%Y')", "time": "strftime(date, '%H:%M')", "desc": "description", "merchant": "merchant", "amount": money("amount"), "debit": f"CASE WHEN type = 'debit' THEN {money('amount')} END",
        "credit": f"CASE WHEN type = 'credit' THEN {money('amount')} END", "balance": money("balance"), "wallet_balance": money("balance"), "ref": "reference", "status": "status", "upi_id": "vpa",
        "direction": "CASE WHEN type = 'credit' THEN 'from' ELSE 'to' END", "type_text": word(formats.TYPE_WORDS), "action": word(formats.ACTION_WORDS),
    }
    shop = f"({array(SHOPS)})[o_orderkey % {len(SHOPS)} + 1]"
    return f"""f AS (SELECT o_orderkey AS msg_id, o_custkey AS account, ({array(SOURCES)})[o_custkey % {len(SOURCES)} + 1] AS source, o_orderdate AS date, 'UPI-' || {shop} || '@ybl-' || lpad(o_orderkey::VARCHAR, 9, '0') AS description,
upper({shop}[1]) || {shop}[2:] AS merchant, round(o_totalprice, 2)::DECIMAL(18,2) AS amount, CASE WHEN o_orderstatus <> 'F' THEN 'credit' ELSE 'debit' END AS type, lpad(o_orderkey::VARCHAR, 12, '0') AS reference,
({array(STATUSES)})[o_orderkey % 3 + 1] AS status, {shop} || '@' || ({array(HANDLES)})[o_orderkey % {len(HANDLES)} + 1] AS vpa FROM orders),
b AS (SELECT *, 1000000 + sum(CASE WHEN type = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY account ORDER BY date, msg_id) AS balance, {_hash('msg_id', 'layout')} AS u, CASE source {sizes} END AS k FROM f),
l(source, layout_no, layout) AS (VALUES {', '.join(f"({lit(s)}, {i}, {lit(x)})" for s, i, x in layouts)}),
r AS (SELECT *, {_fill('layout', values)} AS raw_text FROM (SELECT b.*, l.layout_no, l.layout FROM b JOIN l ON l.source = b.source AND l.layout_no = len(list_filter(range(1, k), lambda j: u >= j / k::DOUBLE))))"""


def _has(*names: str) -> str:
    return "(" + " OR ".join(f"contains(layout, '{{{n}}}')" for n in names) + ")"


_STATEMENTS = f"""WITH {_facts_sql()} SELECT msg_id, source, layout_no::BIGINT AS layout_no, raw_text, strftime(date, '%d/%m/%Y') AS date, CASE WHEN {_has('desc')} THEN description ELSE merchant END AS description,
CASE WHEN {_has('amount')} OR (type = 'debit' AND {_has('debit')}) OR (type = 'credit' AND {_has('credit')}) THEN amount::DOUBLE END AS amount,
CASE WHEN {_has('type_text', 'action')} OR (type = 'debit' AND {_has('debit')}) OR (type = 'credit' AND {_has('credit')}) THEN type END AS type,
CASE WHEN {_has('balance', 'wallet_balance')} THEN balance::DOUBLE END AS balance, CASE WHEN {_has('ref')} THEN reference END AS reference, CASE WHEN {_has('status')} THEN status END AS status FROM r"""

_JSON = "'{' || concat_ws(',', " + ", ".join(
    [f"""'"amount":' || CASE WHEN amount = floor(amount) THEN amount::BIGINT || '.0' ELSE amount::VARCHAR END"""]
    + [f"""'"{c}":"' || {c} || '"'""" for c in ("type", "account", "date", "reference", "beneficiary")]
    + ["""'"is_p2m":' || is_merchant::VARCHAR"""]
) + ") || '}'"

_SIMPLE_SQL = f"""s AS (SELECT msg_id, text FROM msg WHERE msg_id % 4 <> 0 AND length(text) >= 50 AND {has_any('lower(text)', reports.SIMPLE_VERBS)} AND {has_any('lower(text)', reports.AMOUNT_SIGNS)}
AND substr(text, 1, 100) NOT IN (SELECT substr(text, 1, 100) FROM msg WHERE msg_id % 4 = 0)), k AS (SELECT *, row_number() OVER (ORDER BY {_hash('msg_id', '42')}, msg_id) AS id FROM s)"""

_ALL_FIELDS = " UNION ALL ".join(
    f"SELECT msg_id, '{field}' AS field, {n} AS priority, {i} AS k, unnest(range(len(v))) AS j, unnest(v) AS value FROM (SELECT msg_id, regexp_extract_all(text, {lit('(?i)' + p)}, 1) AS v FROM msg)"
    for field, patterns in rules.FIELD_PATTERNS.items()
    for i, (p, n) in enumerate(sorted(patterns, key=lambda x: -x[1]))
)

QUERIES = {
    "c11_all_fields": (all_fields, f"WITH {MSG}, m AS ({_ALL_FIELDS}) SELECT msg_id, field, (row_number() OVER (PARTITION BY msg_id, field ORDER BY k, j) - 1)::INTEGER AS pos, value, priority FROM m"),
    "m5_matches_function": (matches_function, f"WITH {MSG}, m AS ({_ALL_FIELDS}) SELECT field, priority, count(*) AS n, count(DISTINCT value) AS n_values FROM m GROUP BY ALL"),
    "e8_rule_tables": (mail_rule_tables, f"""WITH {MSG}, c AS (WITH {_mail_classes()}) SELECT msg_id, category, score, {_text_category('text')} AS text_category, {sql_label('lower(text)', X.CLEAN_BANKS)} AS bank FROM c JOIN msg USING (msg_id)"""),
    "e1_rule_tables": (merchant_tables, f"""WITH {MSG}, {RAW}, r(ord, key, name, category) AS (VALUES {', '.join(f"({i}, {lit(k)}, {lit(n)}, {lit(c)})" for i, (k, n, c) in enumerate(rules.MERCHANTS))}),
u AS (SELECT msg_id, vpa, split_part(lower(trim(vpa)), '@', 1) AS u FROM raw), h AS (SELECT msg_id, count(*) AS keys, arg_min(name, ord) AS part, arg_min(name, ord) FILTER (key = u) AS exact FROM u JOIN r ON contains(u, key) GROUP BY msg_id),
m AS (SELECT u.msg_id, vpa, coalesce(exact, part) AS merchant, CASE WHEN vpa IS NOT NULL THEN coalesce(keys, 0) END AS keys FROM u LEFT JOIN h USING (msg_id)),
n AS (SELECT DISTINCT merchant FROM m WHERE merchant IS NOT NULL), c AS (SELECT merchant, arg_min(category, ord) AS category, count(*) AS rules FROM n JOIN r ON contains(lower(merchant), key) OR contains(lower(name), lower(merchant)) GROUP BY merchant)
SELECT msg_id, vpa, m.merchant, keys, category, CASE WHEN m.merchant IS NOT NULL THEN coalesce(rules, 0) END AS rules FROM m LEFT JOIN c ON c.merchant = m.merchant"""),
    "e6_rule_table": (rule_table, f"""WITH {_RULES}, hit AS (SELECT doc_id, r.* FROM documents JOIN rules r ON contains(lower(text), keyword)),
f AS (SELECT doc_id, min(ord) AS first_rule, arg_min(label, ord) AS first_label, count(*) AS n_rules FROM hit GROUP BY doc_id),
s AS (SELECT doc_id, label, sum(weight) AS score, min(ord) AS place FROM hit GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM s)
SELECT d.doc_id, first_rule, first_label, CASE WHEN text IS NULL THEN NULL ELSE coalesce(n_rules, 0) END AS n_rules, b.label AS best_label, b.score AS best_score FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1"""),
    "k2_weight_table": (weighted_table, f"""WITH {MSG}, m AS (SELECT msg_id, true_bank AS bank, coalesce(true_type, '') AS type, sender, {_hash('msg_id', 'pick')} AS u, ({array(KINDS)})[msg_id % {len(KINDS)} + 1] AS kind FROM msg),
w AS (SELECT bank, type, kind AS choice, count(*)::DOUBLE AS weight FROM m GROUP BY ALL), p AS (SELECT *, sum(weight) OVER (PARTITION BY bank, type ORDER BY choice) AS upto, sum(weight) OVER (PARTITION BY bank, type) AS whole FROM w),
c AS (SELECT bank, type, choice, (upto - weight) / whole AS lo, CASE WHEN upto = whole THEN 1.0 ELSE upto / whole END AS hi FROM p)
SELECT msg_id, m.bank, m.type, sender, choice FROM m LEFT JOIN c ON c.bank = m.bank AND c.type = m.type AND u >= lo AND u < hi"""),
    "k17_languages": (languages, _language_sql()),
    "k15_statement_rows": (statement_rows, _STATEMENTS),
    "e13_result_store": (stored_results, f"""WITH {MSG}, {RAW}, k AS (SELECT lower(text) AS key, bool_or(variant < 9) AS reused, max(amount) AS amount, max(reference) AS reference FROM merch GROUP BY 1)
SELECT reused, count(*) AS n, count(amount) AS n_amount, count(reference) AS n_reference FROM k GROUP BY ALL"""),
    "k13_simple_set": (simple_benchmark, f"""WITH {MSG}, {_SIMPLE_SQL} SELECT id, msg_id, {sql_label('lower(text)', X.SIMPLE_BANKS)} AS bank,
CASE WHEN {has_any('lower(text)', ['debited', 'sent', 'paid'])} THEN 'debit' WHEN {has_any('lower(text)', ['credited', 'received'])} THEN 'credit' END AS type,
replace({in_order('text', X.SIMPLE_AMOUNT)}, ',', '') AS amount, {in_order('text', X.SIMPLE_ACCOUNT)} AS account, {in_order('text', X.SIMPLE_DATE)} AS date, {in_order('text', X.SIMPLE_REFERENCE)} AS reference,
coalesce(lower(trim(nullif(regexp_extract(text, {lit(X.SIMPLE_MERCHANT)}, 2), ''))), {sql_label('lower(text)', {m: [m] for m in X.SIMPLE_MERCHANTS})}) AS merchant, false AS verified FROM k WHERE id <= 100"""),
    "k13_clean_set": (clean_benchmark, f"""WITH {MSG}, m AS (SELECT text, sender, l_orderkey * 10 + l_linenumber AS row_no, {sql_label("lower(text || ' ' || sender)", X.CLEAN_BANKS)} AS bank FROM msg JOIN lineitem ON l_orderkey = msg_id
WHERE length(text) > 50 AND {has_any('lower(text)', reports.CLEAN_VERBS)} AND {has_any('lower(text)', reports.AMOUNT_SIGNS)}),
x AS (SELECT row_no, bank, replace({in_order('text', X.SIMPLE_AMOUNT[:3])}, ',', '') AS amount, CASE WHEN {has_any('lower(text)', X.CLEAN_DEBIT)} THEN 'debit' WHEN {has_any('lower(text)', X.CLEAN_CREDIT)} THEN 'credit' END AS type,
{_bank_part(0)} AS account, {_bank_part(1)} AS date, {_bank_part(2)} AS reference FROM m WHERE bank IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY bank, reference ORDER BY row_no) AS k FROM x WHERE amount IS NOT NULL AND type IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY {_hash('row_no', '42')}, row_no) AS r FROM o WHERE k = 1 OR reference IS NULL)
SELECT row_number() OVER (ORDER BY {_hash('row_no', '42')}, row_no) AS id, row_no, bank, amount, type, account, date, reference FROM s WHERE r <= 20"""),
    "k9_export_order": (export_verified, f"""WITH {MSG}, {_AUTO}, v AS (SELECT true AS verified_only, * FROM auto WHERE verified UNION ALL SELECT false, * FROM auto),
r AS (SELECT *, row_number() OVER (PARTITION BY verified_only ORDER BY {_hash('msg_id', '42')}, msg_id) AS place, count(*) OVER (PARTITION BY verified_only) AS n FROM v)
SELECT verified_only, CASE WHEN place <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS split, place, msg_id, subject AS input FROM r"""),
    "f14_validation_report": (validation_report, f"""WITH {MSG}, {SCORED}, g AS (SELECT msg_id, text, coalesce(true_type, '') <> '' AS txn, amount, type, category FROM done UNION ALL SELECT msg_id, text, coalesce(true_type, '') <> '', amount, type, category FROM done WHERE msg_id % 50 = 0),
c AS (SELECT count(*) AS total, count_if(txn)::BIGINT AS t, count(DISTINCT text) AS u, count_if(txn AND (amount IS NULL OR type IS NULL))::BIGINT AS flawed FROM g),
s AS (SELECT unnest([{{'section': 'category', 'name': coalesce(category, 'unknown')}}, {{'section': 'type', 'name': coalesce(type, 'unknown')}}, {{'section': 'status', 'name': CASE WHEN contains(lower(text), 'failed') THEN 'failed' WHEN contains(lower(text), 'out for delivery') THEN 'pending' ELSE 'success' END}}]) AS s FROM g WHERE txn),
i AS (SELECT msg_id, unnest(list_filter([CASE WHEN amount IS NULL THEN '1amount' END, CASE WHEN type IS NULL THEN '2type' END], lambda x: x IS NOT NULL)) AS f FROM g WHERE txn),
j AS (SELECT * FROM i ORDER BY msg_id, f LIMIT 20)
SELECT 'records' AS section, 'total' AS name, total AS n, NULL::DOUBLE AS share FROM c UNION ALL SELECT 'records', 'transactions', t, NULL FROM c UNION ALL SELECT 'records', 'others', total - t, NULL FROM c UNION ALL SELECT 'records', 'unique_texts', u, NULL FROM c
UNION ALL SELECT 'records', 'duplicates', total - u, round(1 - u / total, 9) FROM c UNION ALL SELECT 'warning', 'duplicate_rate', total - u, round(1 - u / total, 9) FROM c WHERE 1 - u / total > 0.01
UNION ALL SELECT 'valid', (flawed = 0)::VARCHAR, flawed, NULL FROM c UNION ALL SELECT s.section, s.name, count(*), round(count(*) / (SELECT t FROM c), 9) FROM s GROUP BY ALL UNION ALL SELECT 'issue', 'Missing ' || f[2:], msg_id, NULL FROM j"""),
    "f16_transitions": (word_transitions, r"""WITH """ + MSG + r""", w AS (SELECT regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM msg), t AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
SELECT 'next' AS kind, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'start', w[1], w[2], NULL, count(*) FROM w WHERE len(w) >= 2 GROUP BY ALL"""),
    "k16_corpus_texts": (corpus_build, f"""WITH {MSG}, {_facts_sql()}, g AS (SELECT unnest(string_split(text || chr(10) || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || text, chr(10) || chr(10))) AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
u AS (SELECT text, 'mail' AS source FROM msg UNION ALL SELECT text, 'chat' FROM conversations UNION ALL SELECT text, 'file' FROM documents UNION ALL SELECT raw_text, 'statement' FROM r UNION ALL SELECT text, 'glossary' FROM g WHERE length(trim(text, ' ')) > 50),
c AS (SELECT source, {_CLEAN} AS x FROM u), n AS (SELECT source, x, len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS words FROM c)
SELECT source, sha256(x) AS digest, count(*) AS n, max(words)::BIGINT AS words FROM n WHERE words >= 10 GROUP BY source, sha256(x)"""),
    "j11_ground_truth": (output_json, f"""WITH {MSG}, x AS (SELECT msg_id, {_labels()} FROM msg) SELECT msg_id, {_JSON} AS ground_truth, amount IS NOT NULL AND type IS NOT NULL AND reference IS NOT NULL AS complete_extraction,
coalesce(length(beneficiary) > 0, false) AS has_beneficiary, ((account IS NOT NULL)::INT + (date IS NOT NULL)::INT + (reference IS NOT NULL)::INT) AS n_entities, account, date, reference FROM x"""),
}
