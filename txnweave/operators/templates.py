"""Texts from tables of templates, and the parsers that such tables make.

A template is text with {placeholders}. Which template a row takes is a join with
the table (by kind and language, or by source and number), so templates can be
added without code. A layout's parser is made from the layout itself: each
placeholder stands for a pattern of its type, all else for itself; a line is
read by the first layout of its source that fits it whole, the one with most
fixed text first. Layouts are configuration: at most ``MOST`` rows become columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats
from ..functions import normalize
from . import rule_tables
from .datasets import unit_hash

MOST = 2000
_NAME = re.compile(r"\{(\w+)\}")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders by their values in one go: what a value holds is never filled again."""
    table = F.create_map(*[x for n, v in values.items() for x in (F.lit(f"{{{n}}}"), F.coalesce(v.cast("string"), F.lit("")))])
    parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def _need(templates: DataFrame, column: str, values: dict[str, Column]) -> None:
    named = templates.select(F.explode(F.regexp_extract_all(column, F.lit(r"\{(\w+)\}"), 1)).alias("n")).distinct().limit(MOST).collect()
    unknown = sorted({r["n"] for r in named} - set(values))
    if unknown:
        raise ValueError(f"placeholders without a value: {', '.join(unknown)}")


# --- messages by language ----------------------------------------------------------

#: How a placeholder's value is written.
TYPES = {"amount": "money", "balance": "money", "date": "date", "account": "last4", "otp": "otp"}


def typed(name: str, value: Column) -> Column:
    """The value as text: money with two decimals, dates as dd-MM-yyyy, the last four digits of accounts, six of one-time passwords."""
    kind = TYPES.get(name, "text")
    if kind == "money":
        return F.format_string("%.2f", value.cast("double"))
    if kind == "date":
        return F.date_format(value, "dd-MM-yyyy")
    if kind == "last4":
        return F.lpad(F.right(value.cast("string"), F.lit(4)), 4, "0")
    if kind == "otp":
        return F.lpad(F.right(value.cast("string"), F.lit(6)), 6, "0")
    return value.cast("string")


def language_templates(spark: SparkSession) -> DataFrame:
    """(kind, language, template): the fixed list."""
    return spark.createDataFrame(formats.LANGUAGE_TEMPLATES, "kind string, language string, template string")


def render_languages(df: DataFrame, kind: str, language: str, values: dict[str, Column], templates: DataFrame, fallback: tuple[str, ...] = ("english",), native: Column | None = None) -> DataFrame:
    """Adds text: the template of the row's kind and language, or of the fallback languages in turn; null for an unknown kind.

    ``native``: rows whose digits are written in the language's own, where it has some and its own template is used.
    """
    _need(templates, "template", values)
    filled = {n: typed(n, v) for n, v in values.items()}
    wanted = [F.col(language), *[F.lit(x) for x in fallback]]
    out, found = df, []
    for i, lang in enumerate(wanted):
        t = templates.select(F.col("kind").alias(f"__k{i}"), F.col("language").alias(f"__l{i}"), F.col("template").alias(f"__t{i}"))
        out = out.join(t, (F.col(kind) == F.col(f"__k{i}")) & (lang == F.col(f"__l{i}")), "left")
        found.append(F.col(f"__t{i}"))
    text = fill(F.coalesce(*found), filled)
    if native is not None:
        turned = text
        for name, code in formats.DIGITS.items():
            turned = F.when(F.col(language) == name, normalize.native_digits(text, code)).otherwise(turned)
        text = F.when(native, turned).otherwise(text)
    return out.select(*[c for c in df.columns if c != "text"], text.alias("text"))


# --- statement rows by bank and app ---------------------------------------------------


def layouts(spark: SparkSession) -> DataFrame:
    """(source, layout_no, layout): the fixed list."""
    return spark.createDataFrame([(s, i, x) for s, xs in formats.LAYOUTS.items() for i, x in enumerate(xs)], "source string, layout_no int, layout string")


def _by_source(source: Column, words: dict[str, tuple[str, str]], credit: Column) -> Column:
    out = F.lit("")
    for name, (c, d) in words.items():
        out = F.when(source == name, F.when(credit, c).otherwise(d)).otherwise(out)
    return out


def statement_rows(facts: DataFrame, table: DataFrame, key: str, seed: str = "layout") -> DataFrame:
    """Adds layout_no and raw_text to facts (source, date, time, description, merchant, amount, type, balance, reference, status, vpa).

    Each row takes one of its source's layouts by the hash of its key, through the weights join.
    """
    money = lambda c: F.format_number(F.col(c).cast("decimal(20,2)"), 2)
    credit = F.col("type") == "credit"
    values = {
        "date": F.date_format("date", "dd/MM/yyyy"), "time": F.date_format("date", "HH:mm"), "desc": F.col("description"), "merchant": F.col("merchant"),
        "amount": money("amount"), "debit": F.when(~credit, money("amount")), "credit": F.when(credit, money("amount")), "balance": money("balance"), "wallet_balance": money("balance"),
        "ref": F.col("reference"), "status": F.col("status"), "upi_id": F.col("vpa"), "direction": F.when(credit, "from").otherwise("to"),
        "type_text": _by_source(F.col("source"), formats.TYPE_WORDS, credit), "action": _by_source(F.col("source"), formats.ACTION_WORDS, credit),
    }
    _need(table, "layout", values)
    weights = table.select("source", F.col("layout_no").alias("choice"), F.lit(1.0).alias("weight"))
    chosen = rule_tables.weighted_choice(facts, ["source"], unit_hash(F.col(key), seed), weights).withColumnRenamed("choice", "layout_no")
    t = table.select(F.col("source").alias("__source"), F.col("layout_no").alias("__no"), "layout")
    joined = chosen.join(t, (F.col("source") == F.col("__source")) & (F.col("layout_no") == F.col("__no")), "left")
    return joined.select(*[c for c in chosen.columns if c != "raw_text"], fill(F.col("layout"), values).alias("raw_text"))


#: Stands between the cells of a rewritten line; lines that hold it fit no layout.
_CUT = "\x01"
_MONEY = r"([\d,]+(?:\.\d+)?)"
_SIGNED = r"(-?[\d,]+(?:\.\d+)?)"
_PATTERNS = {
    "date": r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", "time": r"(\d{1,2}:\d{2}(?: ?[AP]M)?)", "amount": _MONEY, "debit": r"([\d,]*(?:\.\d+)?)", "credit": r"([\d,]*(?:\.\d+)?)",
    "balance": _SIGNED, "wallet_balance": _SIGNED, "ref": r"([A-Za-z0-9]+)", "status": r"(\w+)", "upi_id": r"(\S+@\w+)", "direction": "(from|to)", "action": r"([a-z]+)", "type_text": r"([A-Z][a-z]+)",
}


def layout_pattern(layout: str) -> tuple[str, list[str]]:
    """(pattern of a whole line, the placeholders of its groups)."""
    names, out, at = [], "^", 0
    for m in _NAME.finditer(layout):
        out += re.sub(r"([^\w\s])", r"\\\1", layout[at : m.start()]) + _PATTERNS.get(m[1], "(.+?)")
        names.append(m[1])
        at = m.end()
    return out + re.sub(r"([^\w\s])", r"\\\1", layout[at:]) + "$", names


def parse_statement_rows(df: DataFrame, source: str, line: str, table: DataFrame) -> DataFrame:
    """Adds layout_no, date, description, amount, type, balance, reference and status, as far as the line's layout has them; nulls where no layout of the source fits."""
    rows = table.select("source", "layout_no", "layout").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} layouts")
    text = F.col(line)
    credits = [w for words in (formats.TYPE_WORDS, formats.ACTION_WORDS) for w, _ in words.values()]
    debits = [w for words in (formats.TYPE_WORDS, formats.ACTION_WORDS) for _, w in words.values()]
    # A line that fits is rewritten as its cells, in one order for all layouts: one pattern and one string a layout.
    cells = [("date",), ("desc", "merchant"), ("amount",), ("debit",), ("credit",), ("type_text", "action"), ("balance", "wallet_balance"), ("ref",), ("status",)]
    out = F.lit(None).cast("string")
    for name in sorted({r["source"] for r in rows}):
        mine = sorted((r for r in rows if r["source"] == name), key=lambda r: (-len(_NAME.sub("", r["layout"])), r["layout_no"]))
        case = None
        for r in mine:
            pattern, names = layout_pattern(r["layout"])
            at = [next((f"${names.index(n) + 1}" for n in either if n in names), "") for either in cells]
            rewritten = F.regexp_replace(text, pattern, _CUT.join([str(r["layout_no"]), *at]))
            case = F.when(text.rlike(pattern), rewritten) if case is None else case.when(text.rlike(pattern), rewritten)
        out = F.when(F.col(source) == name, case).otherwise(out)
    cut = F.split(F.when(~F.contains(text, F.lit(_CUT)), out), _CUT)
    parsed = df.withColumn("__p", cut)
    cell = lambda i: F.nullif(F.try_element_at("__p", F.lit(i + 1)), F.lit(""))
    money = lambda c: F.translate(c, ",", "").try_cast("double")
    kind = F.when(cell(6).isin(credits), "credit").when(cell(6).isin(debits), "debit").when(cell(4).isNotNull(), "debit").when(cell(5).isNotNull(), "credit")
    added = {"layout_no": cell(0).cast("int"), "date": cell(1), "description": cell(2), "amount": money(F.coalesce(cell(3), cell(4), cell(5))), "type": kind, "balance": money(cell(7)), "reference": cell(8), "status": cell(9)}
    return parsed.select(*[c for c in df.columns if c not in added], *[c.alias(n) for n, c in added.items()])
