"""Statement rows, string entities, review queues and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import jsonx, score
from ..operators import datasets as D
from ..operators import scorer
from ..operators import statements as S
from .dataset_queries import _AUTO, _RESP_AMT, _STR, _cells, _responses, _statement_lines, auto_labels, found
from .extraction_queries import SCORED
from .messages import messages
from .oracle_base import MSG, lit


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.statement_rows(_cells(spark, d)).select("doc", "row_idx", "raw_text", "date", "description", "debit", "credit", "balance")


def row_examples(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows with their entities; rows with a line number that three divides have labelled ones already."""
    rows = S.statement_rows(_cells(spark, d))
    text = lambda c: F.when(F.col(c) != 0, F.format_string("%.2f", c))
    auto = S.row_entities(F.col("date"), F.when(F.col("row_idx") % 5 == 0, "").otherwise(F.col("description")), text("debit"), text("credit"), text("balance"))
    labelled = S.entities({"amount": F.when(F.col("row_idx") % 3 == 0, text("balance"))})
    x = rows.select("doc", "row_idx", auto.alias("auto"), S.row_example(F.col("raw_text"), labelled, auto).alias("e"))
    return x.select("doc", "row_idx", F.size("auto").cast("long").alias("n_entities"), *[F.element_at("auto", k).alias(k) for k in ("date", "description", "amount", "type", "balance")], F.md5("e.prompt").alias("prompt"), F.col("e.completion").alias("completion"))


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _statement_lines(spark, d)
    marked = lines.select("*", S.is_transaction_line(F.col("line")).alias("is_transaction"))
    return S.statement_lines(marked).select("l_orderkey", "l_linenumber", "raw_text", "date", "is_transaction")


def string_entities(spark: SparkSession, d: str) -> DataFrame:
    v = _responses(spark, d).select("msg_id", jsonx.parse(F.col("response")).alias("v"))
    got = jsonx.string_entity(F.col("v"))
    return v.select("msg_id", got["amount"].try_cast("double").alias("amount"), *[got[f].alias(f) for f in ("type", "merchant", "category", "bank", "account")])


def string_predicates(spark: SparkSession, d: str) -> DataFrame:
    x = messages(spark, d).select("msg_id", *[c.alias(k) for k, c in X.string_fields(F.col("text")).items()])
    cols = {k: F.col(k) for k in ("amount", "type", "account", "date")}
    return x.select("msg_id", score.is_valid_string(cols).alias("is_valid"), score.is_complete_string(cols).alias("is_complete"))


def review_queues(spark: SparkSession, d: str) -> DataFrame:
    return D.review_queues(auto_labels(spark, d)).select("msg_id", "queue", "confidence")


def field_prompts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    made = {"one": D.field_prompt("merchant", text), "some": D.fields_prompt(["amount", "date"], text), "whole": D.fields_prompt([], text), "app": D.format_prompt("PHONEPE", text), "statement": D.format_prompt("BANK_STATEMENT", text)}
    return messages(spark, d).select("msg_id", *[F.md5(c.cast("binary")).alias(k) for k, c in made.items()])


def field_model():
    """A stand-in for a model: a name made from the question's length, a class, and nothing else."""

    def answer(text: str) -> str:
        return f"M{len(text) % 7}" if text.endswith("Merchant:") else "dining" if text.endswith("Category:") else '{"amount": "12", "type": "debit"}' if text.endswith("JSON:\n") else "unknown"

    return lambda texts: [answer(t) for t in texts]


def enriched_fields(spark: SparkSession, d: str) -> DataFrame:
    out = scorer.enrich_by_field(found(spark, d).drop("variant"), "msg_id", "text", field_model)
    return out.select("msg_id", "amount", "type", "merchant", "category", F.size("meta").alias("n_filled"), F.element_at("meta", "merchant").alias("merchant_confidence"))


_MERCHANT_EXTRA = len(D.FIELD_DESCRIPTIONS["merchant"]) + len('Give only the  of this transaction, or "unknown".\n\nTransaction: \n\nMerchant:')
_NL = "' || chr(10) || '"


def _sql(x: str) -> str:
    return lit(x).replace("\n", _NL)


QUERIES = {
    "c23_statement_rows": (statement_rows, """WITH c AS (SELECT l_orderkey::VARCHAR AS doc, l_linenumber::INTEGER AS row_idx, strftime(l_shipdate, '%d/%m/%Y') AS date, 'PART ' || l_partkey AS description,
CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS debit, CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS credit, round(l_quantity * 100, 2) AS balance FROM lineitem)
SELECT doc, row_idx, date || ' | ' || description || ' | ' || coalesce(format('{:,.2f}', debit), '') || ' | ' || coalesce(format('{:,.2f}', credit), '') || ' | Rs ' || format('{:,.2f}', balance) AS raw_text, date, description, debit, credit, balance
FROM c WHERE debit IS NOT NULL OR credit IS NOT NULL"""),
    "c27_row_entities": (row_examples, """WITH c AS (SELECT l_orderkey::VARCHAR AS doc, l_linenumber::INTEGER AS row_idx, strftime(l_shipdate, '%d/%m/%Y') AS date, 'PART ' || l_partkey AS part,
CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS debit, CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS credit, round(l_quantity * 100, 2) AS b FROM lineitem),
x AS (SELECT *, CASE WHEN row_idx % 5 <> 0 THEN part END AS description, CASE WHEN debit <> 0 THEN printf('%.2f', debit) WHEN credit <> 0 THEN printf('%.2f', credit) END AS amount, CASE WHEN debit <> 0 THEN 'debit' WHEN credit <> 0 THEN 'credit' END AS type, CASE WHEN b <> 0 THEN printf('%.2f', b) END AS balance,
date || ' | ' || part || ' | ' || coalesce(format('{:,.2f}', debit), '') || ' | ' || coalesce(format('{:,.2f}', credit), '') || ' | Rs ' || format('{:,.2f}', b) AS raw_text FROM c WHERE coalesce(debit, 0) <> 0 OR coalesce(credit, 0) <> 0)
SELECT doc, row_idx, (date IS NOT NULL)::BIGINT + (description IS NOT NULL)::BIGINT + (amount IS NOT NULL)::BIGINT + (type IS NOT NULL)::BIGINT + (balance IS NOT NULL)::BIGINT AS n_entities, date, description, amount, type, balance,
md5('[BANK_STATEMENT] Extract financial entities from this bank statement row:' || chr(10) || chr(10) || raw_text) AS prompt,
'{' || CASE WHEN row_idx % 3 = 0 AND balance IS NOT NULL THEN '"amount":"' || balance || '"' ELSE concat_ws(',', '"date":"' || date || '"', '"description":"' || description || '"', '"amount":"' || amount || '"', '"type":"' || type || '"', '"balance":"' || balance || '"') END || '}' AS completion FROM x"""),
    "c25_statement_lines": (statement_lines, """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%d/%m/%Y') || ' ' || CASE l_returnflag WHEN 'R' THEN 'UPI DEBIT' WHEN 'A' THEN 'DEPOSIT' ELSE 'FEE' END || ' ' || printf('%.2f', l_extendedprice) || ' ' || printf('%.2f', round(l_quantity * 100, 2)) AS raw_text,
strftime(l_shipdate, '%d/%m/%Y') AS date, true AS is_transaction FROM lineitem"""),
    "j7_string_entities": (string_entities, f"""WITH {MSG} SELECT msg_id, CASE WHEN msg_id % 5 < 3 THEN {_RESP_AMT}::DOUBLE END AS amount, CASE WHEN msg_id % 5 < 4 AND msg_id % 2 = 0 THEN 'debit' END AS type, CASE WHEN msg_id % 5 = 1 THEN 'Swiggy' END AS merchant,
CASE msg_id % 5 WHEN 0 THEN 'Dining' WHEN 3 THEN 'gadgets' END AS category, NULL::VARCHAR AS bank, NULL::VARCHAR AS account FROM msg"""),
    "b13_string_predicates": (string_predicates, f"WITH {MSG}, {_STR} SELECT msg_id, coalesce(amount, '') <> '' AND coalesce(type, '') <> '' AS is_valid, coalesce(amount, '') <> '' AND coalesce(type, '') <> '' AND coalesce(account, '') <> '' AND coalesce(date, '') <> '' AS is_complete FROM str"),
    "b11_review_queues": (review_queues, f"WITH {MSG}, {_AUTO} SELECT msg_id, CASE WHEN confidence < 0.5 THEN 'urgent' ELSE 'normal' END AS queue, confidence FROM auto WHERE NOT verified"),
    "k4_field_prompts": (field_prompts, f"""WITH {MSG} SELECT msg_id, md5({_sql('Give only the merchant (vendor name) of this transaction, or "unknown".' + chr(10) * 2 + 'Transaction: ')} || text || {_sql(chr(10) * 2 + 'Merchant:')}) AS one,
md5({_sql('Extract only these fields from the transaction: amount (as a number), date (DD-MM-YYYY format)' + chr(10) * 2 + 'Answer with a JSON object, null for what is not there.' + chr(10) * 2 + 'Transaction:' + chr(10))} || text || {_sql(chr(10) * 2 + 'JSON output:')}) AS some,
md5({_sql('Extract financial entities from this message.' + chr(10) * 2 + 'Message: ')} || substr(text, 1, 1500) || {_sql(chr(10) * 2 + 'Output JSON:' + chr(10))}) AS whole,
md5({_sql('[PHONEPE] Extract financial entities from this transaction:' + chr(10) * 2)} || text) AS app, md5({_sql('[BANK_STATEMENT] Extract financial entities from this bank statement row:' + chr(10) * 2)} || text) AS statement FROM msg"""),
    "m2_enriched_fields": (enriched_fields, f"""WITH {MSG}, {SCORED}, x AS (SELECT *, amount IS NULL OR type IS NULL AS lacks, amount IS NULL OR type IS NULL OR (merchant IS NULL)::INT + (category IS NULL)::INT + (date IS NULL)::INT + (reference IS NULL)::INT > 2 AS n FROM done)
SELECT msg_id, CASE WHEN n AND lacks THEN coalesce(amount, 12) ELSE amount END AS amount, CASE WHEN n AND lacks THEN coalesce(type, 'debit') ELSE type END AS type, coalesce(merchant, CASE WHEN n THEN 'M' || (length(text) + {_MERCHANT_EXTRA}) % 7 END) AS merchant,
coalesce(category, CASE WHEN n THEN 'food' END) AS category, CASE WHEN n THEN (merchant IS NULL)::INT + (category IS NULL)::INT + (amount IS NULL)::INT + (type IS NULL)::INT ELSE 0 END AS n_filled, CASE WHEN n AND merchant IS NULL THEN 0.7 END AS merchant_confidence FROM x"""),
}
