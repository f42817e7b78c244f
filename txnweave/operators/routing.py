"""Which messages are transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.patterns import count_matching, has_any, let, matches_any, once

#: Fixed values.
AMOUNT_SIGN = r"(?:rs\.?|inr|₹)\s*[\d,]+"
STRICT_KEEP = [
    r"has been debited", r"has been credited", r"is debited from", r"is credited to", r"Rs\.\s*[\d,]+.*debited", r"Rs\.\s*[\d,]+.*credited",
    r"INR\s*[\d,]+.*debited", r"INR\s*[\d,]+.*credited", r"UPI transaction reference", r"UPI Ref", r"IMPS Ref", r"NEFT Ref",
]
STRICT_DROP = [
    r"welcome to your", r"greetings of the day", r"unsubscribe from", r"skills that will get you", r"daily digest", r"top picks",
    r"mutual fund nav", r"market update", r"job opportunity", r"margin statement", r"password reset",
]
FINANCE_SENDERS = ["hdfc", "icici", "sbi", "axis", "kotak", "paytm", "phonepe", "gpay", "bank"]
FINANCE_WORDS = ["debited", "credited", "transaction", "payment", "upi", "neft", "imps", "account"]


def garbage_patterns(compat: bool = False) -> list[str]:
    """The one-time-password rule is written in capitals; on lower-cased text it never fires (``compat`` keeps that)."""
    return rules.GARBAGE_PATTERNS if compat else [p.replace("OTP", "otp") for p in rules.GARBAGE_PATTERNS]


def _found(text: Column, compat: bool) -> Column:
    """What decides a message's class. The text is lower-cased once; each list of patterns is tried only where those before decided nothing."""

    def of(low: Column) -> Column:
        return (
            F.when(text.isNull() | (F.length(F.trim(text)) < 20), "short")
            .when(matches_any(low, garbage_patterns(compat)), "garbage")
            .when(count_matching(low, rules.KEEP_PATTERNS) >= 2, "keep")
            .when(low.rlike("(?U)" + AMOUNT_SIGN), "amount")
            .otherwise("none")
        )

    return let(F.lower(text), of)


def _kind(found: Column) -> Column:
    return F.when(found.isin("short", "garbage"), "garbage").when(found == "keep", "keep").otherwise("uncertain")


def _reason(found: Column) -> Column:
    reasons = {"short": "too_short", "garbage": "matched_garbage_pattern", "keep": "matched_transaction_pattern", "amount": "has_amount_no_transaction_type", "none": "no_strong_signals"}
    return F.element_at(F.create_map(*[F.lit(x) for p in reasons.items() for x in p]), found)


def classify(text: Column, compat: bool = False) -> tuple[Column, Column]:
    """(class, reason)."""
    found = _found(text, compat)
    return let(found, _kind), let(found, _reason)


def with_class(df: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    """Adds classification and filter_reason, decided once a row whatever filters follow."""
    out = once(df, {"__found": _found(F.col(text_col), compat)})
    return out.select(*df.columns, _kind(F.col("__found")).alias("classification"), _reason(F.col("__found")).alias("filter_reason"))


def training_filter(subject: Column, body: Column) -> Column:
    low = F.lower(F.concat_ws(" ", subject, body))
    return has_any(low, ["debited", "credited", "payment of", "transferred"]) & has_any(low, ["rs", "₹"])


def benchmark_filter(body: Column, verbs: list[str] | None = None, amounts: list[str] | None = None, least: int = 50) -> Column:
    low = F.lower(body)
    return (F.length(body) >= least) & has_any(low, verbs or ["debited", "credited", "sent", "received", "paid"]) & has_any(low, amounts or ["rs", "inr", "₹"])


def strict_filter(body: Column) -> Column:
    return matches_any(body, STRICT_KEEP, True) & ~matches_any(F.lower(body), STRICT_DROP)


def finance_filter(sender: Column, subject: Column, body: Column) -> Column:
    who = F.lower(F.concat_ws(" ", sender, subject))
    return has_any(who, FINANCE_SENDERS) | has_any(F.lower(F.concat_ws(" ", who, body)), FINANCE_WORDS)


def amount_and_verb(text: Column) -> Column:
    low = F.lower(text)
    return has_any(low, ["debited", "credited", "sent", "received", "paid"]) & low.rlike(r"(?U)(?:rs\.?|₹)\s*[\d,]+")


def bounded(df: DataFrame, col: str, least: int = 50, most: int = 5000) -> DataFrame:
    return df.where(F.length(col) >= least).withColumn(col, F.substring(col, 1, most))


def input_errors(subject: Column, body: Column, sender: Column) -> Column:
    """Why a row is not valid input; null if it is."""
    trimmed = F.trim(F.coalesce(body, F.lit("")))
    return (
        F.when(trimmed == "", "body_empty")
        .when(F.length(body) > 10000, "body_too_long")
        .when(F.length(subject) > 500, "subject_too_long")
        .when(F.length(sender) > 200, "sender_too_long")
    )
