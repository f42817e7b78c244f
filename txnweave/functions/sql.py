"""The scalar functions under names that SQL text can call: SQL functions that Spark inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import rules
from .normalize import CREDIT_WORDS, DATE_FORMATS, DEBIT_WORDS, MERCHANT_PREFIXES
from .patterns import FOLDED, java, required


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_lit(r'(?U)^\s+|\s+$')}, '')"


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(x), {_lit(w)})" for w in words)


def _merchant() -> str:
    out = _strip("x")
    for prefix in MERCHANT_PREFIXES:
        out = _strip(f"regexp_replace({out}, {_lit('(?i)^' + prefix)}, '')")
    return f"nullif({out}, '')"


_SPACED = f"trim(regexp_replace(x, {_lit(r'(?U)\s+')}, ' '))"

#: name -> (type, expression over x), in order of use.
SCALARS = {
    "txn_amount": ("DOUBLE", f"try_cast(translate(regexp_replace(trim(x), {_lit(r'(?i)^(?:Rs\.?|INR|₹)\s*')}, ''), ', ', '') AS DOUBLE)"),
    "txn_day": ("DATE", f"CAST(coalesce({', '.join(f'try_to_timestamp({_SPACED}, {_lit(f)})' for f in DATE_FORMATS)}) AS DATE)"),
    "txn_date": ("STRING", "date_format(add_months(txn_day(x), CASE WHEN year(txn_day(x)) >= 2069 THEN -1200 ELSE 0 END), 'dd-MM-yyyy')"),
    "txn_account": ("STRING", f"nullif(regexp_replace(x, {_lit(r'\D')}, ''), '')"),
    "txn_reference": ("STRING", "nullif(regexp_replace(x, '[^A-Za-z0-9]', ''), '')"),
    "txn_vpa": ("STRING", f"CASE WHEN contains(x, '@') THEN lower({_strip('x')}) END"),
    "txn_merchant": ("STRING", _merchant()),
    "txn_type": ("STRING", f"CASE WHEN {_any(DEBIT_WORDS)} THEN 'debit' WHEN {_any(CREDIT_WORDS)} THEN 'credit' END"),
}


def _dates() -> str:
    """Every match of every date pattern, by falling priority."""
    each = [f"transform(regexp_extract_all(x, {_lit(java(p))}, 1), v -> named_struct('value', v, 'priority', {n}))" for p, n in sorted(rules.DATE, key=lambda p: -p[1])]
    return f"SELECT d.value, d.priority FROM (SELECT explode(concat({', '.join(each)})) AS d)"


def _guard(pattern: str) -> str:
    """Whether x, of which low is the text in lower case, holds what the pattern needs; as ``patterns.may_match``."""
    lists = [f"({' OR '.join(f'contains(low, {_lit(w.lower())})' for w in dict.fromkeys(ws))})" for ws in required(pattern)]
    return f"coalesce({' AND '.join(lists)}, true)" if lists else "true"


def _matches() -> str:
    """Every match of every pattern of every field, each field's by falling priority. Texts that lack what a pattern needs aren't searched for it."""
    each = [
        f"transform(CASE WHEN {_guard(p)} THEN regexp_extract_all(x, {_lit(java(p))}, 1) ELSE CAST(array() AS array<string>) END, v -> named_struct('field', '{field}', 'value', v, 'priority', {n}))"
        for field, patterns in rules.FIELD_PATTERNS.items()
        for p, n in sorted(patterns, key=lambda p: -p[1])
    ]
    folded = f"CASE WHEN octet_length(x) = length(x) OR NOT rlike(x, {_lit(f'[{FOLDED}]')}) THEN lower(x) END"
    return f"SELECT d.field, d.value, d.priority FROM (SELECT explode(element_at(transform(array({folded}), low -> concat({', '.join(each)})), 1)) AS d)"


def register(spark: SparkSession) -> None:
    """Temporary functions txn_* and the table functions txn_dates and txn_matches."""
    for name, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION txn_dates(x STRING) RETURNS TABLE (value STRING, priority INT) RETURN {_dates()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION txn_matches(x STRING) RETURNS TABLE (field STRING, value STRING, priority INT) RETURN {_matches()}")
