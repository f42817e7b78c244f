"""Extraction pipelines over message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import lookup, normalize, score


def extract_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the eight fields, merchant, category (rules) and normalised values, confidence last.

    Each step is one select, so Spark computes every pattern once a row.
    """
    raw = X.extract(df, text_col)
    merchant, category = lookup.merchant_and_category(F.col("vpa"), F.col(text_col))
    found = raw.select("*", merchant.alias("merchant"), category.alias("category"))
    normal = {
        "date": F.coalesce(normalize.date(F.col("date")), F.col("date")),
        "account": normalize.account(F.col("account")),
        "reference": normalize.reference(F.col("reference")),
        "vpa": normalize.vpa(F.col("vpa")),
    }
    done = found.select(*[normal[c].alias(c) if c in normal else F.col(c) for c in found.columns])
    cols = {f: F.col(f) for f in score.WEIGHTS}
    scored = done.select("*", score.combined(cols).alias("confidence_score"))
    return scored.select("*", score.level(F.col("confidence_score")).alias("confidence"))


def merge(left: DataFrame, right: DataFrame, key: str, fields: list[str], overwrite: bool = False) -> DataFrame:
    """Fill null fields of the left rows from the right ones (or overwrite with what is not null)."""
    r = right.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = left.join(r, F.col(key) == F.col("__key"), "left")
    pick = lambda f: F.coalesce(f"__{f}", f) if overwrite else F.coalesce(f, f"__{f}")
    return joined.select(*[pick(c).alias(c) if c in fields else F.col(c) for c in left.columns])


def extract_with_reuse(df: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, fields) for each distinct content: what is known is reused, only the rest is extracted."""
    keyed = df.select(normalize.content_key(F.col(text_col)).alias("content_key"), F.col(text_col).alias("text"))
    distinct = keyed.groupBy("content_key").agg(F.min("text").alias("text"))
    new = X.extract(distinct.join(known, "content_key", "left_anti"), "text")
    old = distinct.select("content_key").join(known, "content_key")
    return old.withColumn("reused", F.lit(True)).unionByName(new.select(*known.columns).withColumn("reused", F.lit(False)))


def row_quality(cols: dict[str, Column]) -> dict[str, Column]:
    """has_* flags, how many of seven fields are there, and success."""
    fields = ["amount", "type", "account", "date", "reference", "merchant", "category"]
    n = sum((cols[f].isNotNull().cast("int") for f in fields), F.lit(0))
    return {"fields_extracted": n, "success": cols["amount"].isNotNull() & cols["type"].isNotNull()}
