"""Statement tables and lines as transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logical column -> aliases in header cells.
ALIASES = {
    "date": ["date", "txn date", "value date"],
    "description": ["description", "narration", "particulars", "details"],
    "debit": ["debit", "withdrawal", "dr"],
    "credit": ["credit", "deposit", "cr"],
    "balance": ["balance", "closing"],
    "reference": ["ref", "chq", "cheque"],
}
LINE_NUMBER = r"([\d,]+\.?\d*)"
DATE = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
KEYS = ["doc", "page", "table_id"]


def column_map(cells: DataFrame) -> DataFrame:
    """(doc, page, table_id, one position for each logical column): the first header cell that contains an alias."""
    header = cells.where("row_idx = 0")
    at = lambda words: F.array_position(F.transform("cells", lambda c: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))), True)
    return header.select(*KEYS, *[F.nullif(at(words), F.lit(0).cast("long")).alias(f"at_{name}") for name, words in ALIASES.items()])


def clean_amount(cell: Column) -> Column:
    return F.translate(F.regexp_replace(cell, r"[^\d,.]", ""), ",", "").try_cast("double")


def is_amount(cell: Column) -> Column:
    return F.coalesce(F.translate(cell, ",. ", "").rlike(r"^\d+$"), F.lit(False))


def is_date(cell: Column) -> Column:
    return F.coalesce(cell.rlike(f"^{DATE}"), F.lit(False))


def table_transactions(cells: DataFrame) -> DataFrame:
    """One row for each table row with a valid date and a debit or credit; rows of fewer than 3 cells go."""
    rows = cells.where("row_idx > 0 AND size(cells) >= 3").join(column_map(cells), KEYS)
    cell = lambda name: F.try_element_at("cells", F.col(f"at_{name}").cast("int"))
    picked = rows.select(*KEYS, "row_idx", "cells", *[cell(n).alias(n) for n in ALIASES])
    debit, credit = is_amount(F.col("debit")), is_amount(F.col("credit"))
    out = picked.where(is_date(F.col("date")) & (debit | credit)).select(
        *KEYS, "row_idx", "date", F.col("description"), F.col("reference"),
        F.when(debit, clean_amount(F.col("debit"))).otherwise(clean_amount(F.col("credit"))).alias("amount"),
        F.when(debit, "debit").otherwise("credit").alias("type"),
        clean_amount(F.col("balance")).alias("balance"),
        F.array_join(F.filter("cells", lambda c: c != ""), " | ").alias("raw_text"),
    )
    return out


def entities(cols: dict[str, Column]) -> Column:
    """map<string, string> of what is present."""
    return F.map_filter(F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def row_entities(date: Column, description: Column, debit: Column, credit: Column, balance: Column) -> Column:
    """map<string, string> of a statement row's texts; empty ones are absent. Amount and type are the debit's, else the credit's."""
    date, description, debit, credit, balance = (F.nullif(c.cast("string"), F.lit("")) for c in (date, description, debit, credit, balance))
    kind = F.when(debit.isNotNull(), "debit").when(credit.isNotNull(), "credit")
    return entities({"date": date, "description": description, "amount": F.coalesce(debit, credit), "type": kind, "balance": balance})


def row_example(row: Column, labelled: Column, auto: Column) -> Column:
    """struct(prompt, completion): a statement row and its entities as JSON, the labelled ones if there are any."""
    found = F.when(F.size(labelled) > 0, labelled).otherwise(auto)
    ask = F.concat(F.lit("[BANK_STATEMENT] Extract financial entities from this bank statement row:\n\n"), row)
    return F.struct(ask.alias("prompt"), F.to_json(found).alias("completion"))


def line_transactions(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Lines of 20 characters or more with a date and a number.

    The amount is the first number after the date is taken out (``compat``: the
    first digit run of the line, usually the day); the balance is the last number.
    """
    line = F.col("line")
    header = F.lower(line).rlike("opening balance|closing balance|statement of account|page no")
    kept = lines.where((F.length("line") >= 20) & ~header & line.rlike(DATE))
    rest = line if compat else F.regexp_replace(line, DATE, " ")
    kept = kept.select("*", F.regexp_extract_all(rest, F.lit(r"([\d,]+(?:\.\d+)?)"), F.lit(1)).alias("numbers"))
    low = F.lower("line")
    return kept.where(F.size("numbers") > 0).select(
        *[c for c in lines.columns if c != "line"],
        F.regexp_extract("line", f"({DATE})", 1).alias("date"),
        F.translate(F.element_at("numbers", 1), ",", "").try_cast("double").alias("amount"),
        F.when(F.size("numbers") > 1, F.translate(F.element_at("numbers", -1), ",", "").try_cast("double")).alias("balance"),
        F.when(low.rlike("debit|withdraw|dr"), "debit").when(low.rlike("credit|deposit|cr"), "credit").alias("type"),
    )


def is_transaction_line(line: Column) -> Column:
    """Has a date and a number of more than three characters."""
    long = F.filter(F.regexp_extract_all(line, F.lit(r"([\d,]+\.?\d*)"), F.lit(1)), lambda x: F.length(x) > 3)
    return line.rlike(DATE) & (F.size(long) > 0)


def statement_rows(cells: DataFrame) -> DataFrame:
    """(doc, page, table_id, row_idx, raw_text, date, description, debit, credit, balance): table rows of at least 10 characters with a debit or credit that is no zero."""
    rows = cells.where("row_idx > 0").join(column_map(cells), KEYS)
    cell = lambda name: F.trim(F.try_element_at("cells", F.col(f"at_{name}").cast("int")))
    raw = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    out = rows.select(*KEYS, "row_idx", raw.alias("raw_text"), cell("date").alias("date"), cell("description").alias("description"), *[clean_amount(cell(n)).alias(n) for n in ("debit", "credit", "balance")])
    some = lambda n: F.coalesce(F.col(n), F.lit(0.0)) != 0
    return out.where((F.length(F.trim("raw_text")) >= 10) & (some("debit") | some("credit")))


def statement_lines(lines: DataFrame) -> DataFrame:
    """The other columns with raw_text and date of lines of at least 15 characters that hold a number of more than three."""
    trimmed = F.trim("line")
    numbers = F.filter(F.regexp_extract_all("line", F.lit(LINE_NUMBER), F.lit(1)), lambda x: F.length(x) > 3)
    kept = lines.where((F.length(trimmed) >= 15) & (F.size(numbers) > 0))
    return kept.select(*[c for c in lines.columns if c != "line"], trimmed.alias("raw_text"), F.nullif(F.regexp_extract("line", f"({DATE})", 1), F.lit("")).alias("date"))
