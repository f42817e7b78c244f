"""Confidence, completeness and validity of extracted rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of fields, reliability of sources.
WEIGHTS = {"amount": 0.25, "type": 0.15, "date": 0.15, "account": 0.10, "reference": 0.10, "merchant": 0.10, "category": 0.10, "vpa": 0.05}
SOURCES = {"regex": 0.95, "rules": 0.85, "llm": 0.70, "cache": 1.0}
FIELD_CONFIDENCE = {"regex": 0.95, "rules": 0.85, "llm": 0.70}
REQUIRED, DESIRED = ["amount", "type"], ["merchant", "category", "date", "reference"]


def field_scores(sources: dict[str, tuple[str, float] | None]) -> dict[str, float]:
    """Score of each field by where it came from: (source, confidence), or None if unknown."""
    return {f: 0.5 if s is None else SOURCES.get(s[0], 0.5) * (s[1] or 1.0) for f, s in sources.items()}


#: Fields by their tiers: patterns, and rules for merchant and category.
TIERS = {f: ("regex", 0.95) for f in ("amount", "type", "date", "account", "reference", "vpa")} | {"merchant": ("rules", 0.85), "category": ("rules", 0.80)}


def confidence_score(cols: dict[str, Column], sources: dict[str, tuple[str, float] | None] | None = None) -> Column:
    scores = field_scores(sources or TIERS)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        there = cols[f].isNotNull()
        top = top + F.when(there, w * scores[f]).otherwise(0.0)
        bottom = bottom + F.when(there, w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def share_present(cols: list[Column]) -> Column:
    n = F.lit(0.0)
    for c in cols:
        n = n + c.isNotNull().cast("double")
    return n / len(cols)


def completeness(cols: dict[str, Column], required: list[str] = REQUIRED, desired: list[str] = DESIRED) -> Column:
    return 0.7 * share_present([cols[f] for f in required]) + 0.3 * share_present([cols[f] for f in desired])


def combined(cols: dict[str, Column]) -> Column:
    return 0.7 * confidence_score(cols) + 0.3 * completeness(cols)


def level(score: Column, high: float = 0.9, medium: float = 0.7) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score > 0, "low").otherwise("failed")


def string_score(cols: dict[str, Column]) -> Column:
    optional = ["account", "date", "reference", "merchant", "category"]
    return 0.6 * share_present([cols[f] for f in REQUIRED]) + 0.4 * share_present([cols[f] for f in optional])


def missing_fields(cols: dict[str, Column], required: list[str] = REQUIRED, desired: list[str] = DESIRED) -> Column:
    """Names of null fields, required ones first."""
    return F.array_compact(F.array(*[F.when(cols[f].isNull(), f) for f in [*required, *desired]]))


def needs_enrichment(cols: dict[str, Column], required: list[str] = REQUIRED, desired: list[str] = DESIRED) -> Column:
    lacks = lambda fs: sum((cols[f].isNull().cast("int") for f in fs), F.lit(0))
    return (lacks(required) > 0) | (lacks(desired) > len(desired) / 2)


def source_summary(cols: dict[str, Column], sources: dict[str, tuple[str, float] | None] | None = None) -> Column:
    """map<field, 'source (NN%)' | unknown | missing>."""
    said = {f: "unknown" if s is None else f"{s[0]} ({s[1]:.0%})" for f, s in (sources or TIERS).items()}
    return F.create_map(*[x for f in WEIGHTS for x in (F.lit(f), F.when(cols[f].isNotNull(), said[f]).otherwise("missing"))])


def valid_amount(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"), F.lit(False))


def valid_reference(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) >= 10, F.lit(False))


def valid_vpa(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9._-]+@[a-zA-Z0-9]+$"), F.lit(False))


def edge_tags(text: Column, amount: Column, txn_type: Column) -> Column:
    """Tags of unusual rows."""
    low = F.lower(text)
    return F.array_compact(
        F.array(
            F.when(F.contains(low, F.lit("failed")), "failed_txn"),
            F.when(F.contains(low, F.lit("pending")), "pending_txn"),
            F.when(amount > 100000, "large_amount"),
            F.when(amount < 10, "small_amount"),
            F.when(text.rlike(r"[^\x00-\x7F]"), "unicode"),
            F.when(txn_type == "credit", "credit"),
        )
    )


def is_valid_string(cols: dict[str, Column]) -> Column:
    """The string variant: amount and type are there and not empty."""
    return _filled(cols, ["amount", "type"])


def is_complete_string(cols: dict[str, Column]) -> Column:
    """The string variant: amount, type, account and date are there and not empty."""
    return _filled(cols, ["amount", "type", "account", "date"])


def _filled(cols: dict[str, Column], names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(cols[n].cast("string"), F.lit("")) != "")
    return out
