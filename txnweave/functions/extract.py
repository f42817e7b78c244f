"""Entity extraction as column expressions: one select, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .normalize import ascii_digits
from .patterns import by_priority, first_label, first_match, folded, has_any, in_order, java, matches, may_match

FIELDS = ["amount", "type", "date", "reference", "account", "vpa", "bank", "payment_method"]


def amount(text: Column, compat: bool = False, low: Column | None = None) -> Column:
    """Lakhs first, then the other patterns; no fallback from one that matches but is no number.

    A lakh match that is no number counts as no lakh match (``compat``: as no amount).
    """
    lakh = first_match(text, rules.AMOUNT_LAKH, low=low)
    number = ascii_digits(lakh).try_cast("double") * 100000
    plain = F.translate(ascii_digits(by_priority(text, rules.AMOUNT, low=low)), ",", "").try_cast("double")
    return F.when(lakh.isNotNull(), number).otherwise(plain) if compat else F.coalesce(number, plain)


def txn_type(text: Column, low: Column | None = None) -> Column:
    return F.when(matches(text, rules.TYPE_DEBIT, low=low), "debit").when(matches(text, rules.TYPE_CREDIT, low=low), "credit")


def fields(text: Column, compat: bool = False, low: Column | None = None) -> dict[str, Column]:
    return {
        "amount": amount(text, compat, low),
        "type": txn_type(text, low),
        "date": by_priority(text, rules.DATE, low=low),
        "reference": by_priority(text, rules.REFERENCE, low=low),
        "account": by_priority(text, rules.ACCOUNT, low=low),
        "vpa": by_priority(text, rules.VPA, low=low),
        "bank": by_priority(text, rules.BANK, low=low),
        "payment_method": by_priority(text, rules.PAYMENT_METHOD, low=low),
    }


def extract(df: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    """The rows with the eight fields. ``compat``: a lakh match that is no number blanks every field."""
    text, columns = F.col(text_col), df.columns
    df = df.select("*", folded(text).alias("__low"))
    found = fields(text, compat, F.col("__low"))
    if compat:
        lakh = first_match(text, rules.AMOUNT_LAKH)
        broken = lakh.isNotNull() & ascii_digits(lakh).try_cast("double").isNull()
        found = {k: F.when(~broken, v) for k, v in found.items()}
    return df.select(*columns, *[v.alias(k) for k, v in found.items()])


def all_matches(text: Column, field: str, low: Column | None = None) -> Column:
    """array<struct<value, priority>>: every match of every pattern, by falling priority. ``low``: the folded text, to spare texts that lack what a pattern needs."""
    patterns = sorted(rules.FIELD_PATTERNS[field], key=lambda p: -p[1])

    def found(pattern: str) -> Column:
        every, guard = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(1)), may_match(text, pattern, True, low)
        return every if guard is None else F.when(guard, every).otherwise(F.array().cast("array<string>"))

    def with_priority(n: int):
        return lambda v: F.struct(v.alias("value"), F.lit(n).alias("priority"))

    return F.flatten(F.array(*[F.transform(found(p), with_priority(n)) for p, n in patterns]))


# --- the string-typed variant -------------------------------------------------

# Patterns of the string-typed extractor, in order.
STRING_AMOUNT = [
    r"(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d{2})?)",
    r"(?:amount|amt)[:\s]*([\d,]+(?:\.\d{2})?)",
    r"(?:debited|credited)[:\s]*(?:Rs\.?|INR|₹)?\s*([\d,]+(?:\.\d{2})?)",
]
STRING_DEBIT = ["debited", "debit", "paid", "sent", "withdrawn", "purchase", "payment", "transferred out", "dr"]
STRING_CREDIT = ["credited", "credit", "received", "deposited", "refund", "cashback", "transferred in", "cr"]
STRING_ACCOUNT = [r"(?:a/c|acct?|account)\s*(?:no\.?)?\s*[:\s]*\**[xX]*(\d{4,})", r"[*xX]+(\d{4})\b"]
STRING_DATE = [
    r"(\d{2}[-/]\d{2}[-/]\d{2,4})",
    r"(\d{2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4})",
    r"(\d{4}[-/]\d{2}[-/]\d{2})",
]
STRING_REFERENCE = [r"(?:ref(?:erence)?|txn|upi|imps)\s*(?:no\.?|id)?[:\s]*(\d{10,})", r"(?:transaction)\s*(?:id)?[:\s]*(\d{10,})"]
BALANCE = r"(?:bal(?:ance)?|avl\.?\s*bal)[:\s]*(?:Rs\.?|INR|₹)?\s*([\d,]+(?:\.\d{2})?)"


def string_fields(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    account = in_order(text, STRING_ACCOUNT)
    return {
        "amount": F.translate(in_order(text, STRING_AMOUNT), ",", ""),
        "type": F.when(has_any(low, STRING_DEBIT), "debit").when(has_any(low, STRING_CREDIT), "credit"),
        "account": F.right(account, F.lit(4)),
        "date": in_order(text, STRING_DATE),
        "reference": in_order(text, STRING_REFERENCE),
        "merchant": first_label(low, rules.KEYWORD_MERCHANTS),
        "payment_method": first_label(low, rules.KEYWORD_METHODS),
        "category": first_label(low, rules.KEYWORD_CATEGORIES),
        "bank": first_label(low, rules.KEYWORD_BANKS),
        "balance": F.translate(first_match(text, BALANCE), ",", ""),
    }


# --- format-specific labels -----------------------------------------------------

# Account, amount, date, beneficiary, reference.
LABEL_DEBIT = (
    r"ICICI Bank Acc?t?\s*XX?(\d+)\s+debited\s+(?:for\s+)?Rs\.?\s*([\d,]+(?:\.\d{2})?)\s+on\s+(\d{1,2}-[A-Za-z]{3}-\d{2,4})"
    r"[\s;]+([A-Za-z0-9\s]+?)\s+credited\.\s*UPI[:\s]*(\d+)"
)
LABEL_CREDIT = (
    r"(?:Dear Customer,?\s*)?Acc?t?\s*XX?(\d+)\s+(?:is\s+)?credited\s+(?:with\s+)?Rs\.?\s*([\d,]+(?:\.\d{2})?)\s+on\s+"
    r"(\d{1,2}-[A-Za-z]{3}-\d{2,4})\s+from\s+([A-Za-z0-9\s]+?)[\.\s]+UPI[:\s]*(\d+)"
)
LABEL_AMOUNT = r"Rs\.?\s*([\d,]+(?:\.\d{1,2})?)"
LABEL_DATE = r"(\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
LABEL_REFERENCE = r"UPI[:\s]*(\d{12,16})"
LABEL_ACCOUNT = r"XX?(\d{3,4})"


def label_fields(text: Column) -> dict[str, Column]:
    from .lookup import is_merchant
    from .normalize import beneficiary

    debit, credit = text.rlike(java(LABEL_DEBIT)), text.rlike(java(LABEL_CREDIT))
    part = lambda g: F.when(debit, first_match(text, LABEL_DEBIT, g)).when(credit, first_match(text, LABEL_CREDIT, g))
    either = debit | credit
    name = beneficiary(part(4))
    return {
        "amount": F.translate(F.when(either, part(2)).otherwise(first_match(text, LABEL_AMOUNT)), ",", "").try_cast("double"),
        "type": F.when(debit, "debit").when(credit, "credit").when(text.rlike(java(r"\bdebit")), "debit").when(text.rlike(java(r"\bcredit")), "credit"),
        "account": F.when(either, part(1)).otherwise(first_match(text, LABEL_ACCOUNT)),
        "date": F.when(either, part(3)).otherwise(first_match(text, LABEL_DATE, 1, False)),
        "reference": F.when(either, part(5)).otherwise(first_match(text, LABEL_REFERENCE)),
        "beneficiary": name,
        "is_merchant": F.coalesce(is_merchant(name), F.lit(False)),
        "extraction_method": F.when(debit, "icici_debit_pattern").when(credit, "icici_credit_pattern").otherwise("generic_fallback"),
    }


# --- labels for benchmark sets ----------------------------------------------------

# Patterns in order.
SIMPLE_BANKS = {"hdfc": ["hdfc"], "icici": ["icici"], "sbi": ["sbi"], "axis": ["axis"], "kotak": ["kotak"], "phonepe": ["phonepe"], "gpay": ["gpay", "google pay"], "paytm": ["paytm"]}
SIMPLE_AMOUNT = [r"Rs\.?\s*([\d,]+\.?\d*)", r"INR\s*([\d,]+\.?\d*)", r"₹\s*([\d,]+\.?\d*)", r"([\d,]+\.?\d*)\s*has been (?:debited|credited)"]
SIMPLE_ACCOUNT = [r"account\s*(?:no\.?|number|#|XX|X)?\s*(\d{4})", r"A/c\s*(?:XX|X)?(\d{4})", r"a/c\s*(\d{4})", r"XX(\d{4})", r"X(\d{4})"]
SIMPLE_DATE = [
    r"on\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4})",
]
SIMPLE_REFERENCE = [
    r"(?:UPI\s*)?(?:Ref(?:erence)?(?:\s*(?:No|Number|#|:))?\.?\s*:?\s*)(\d{10,})",
    r"transaction reference number is\s*(\d+)",
    r"Txn[:\s]*(\d+)",
]
SIMPLE_MERCHANT = r"VPA\s+(\w+)@\w+\s+([A-Z][A-Za-z\s]+)"
SIMPLE_MERCHANTS = ["swiggy", "zomato", "amazon", "flipkart", "uber", "ola", "rapido", "bigbasket", "blinkit", "zepto"]
#: bank -> (account, date, reference) as (pattern, ignore case)
BANK_FORMATS = {
    "hdfc": ((r"(?:account|A/c\s*\**)(\d{4})", False), (r"on\s*(\d{1,2}-\d{1,2}-\d{2,4})", False), (r"reference number is\s*(\d{10,})", False)),
    "icici": ((r"(?:A/c|Acct)\s*XX(\d{4})", True), (r"on\s*(\d{8}|\d{1,2}\s+\w+\s+\d{4}|\d{1,2}-\d{1,2}-\d{2,4})", False), (r"Ref[:\s]*(\d{10,})", True)),
    "sbi": ((r"[Aa]/c\s*X+(\d{4})", False), (r"on\s*(\d{1,2}-\d{1,2}-\d{2,4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+\w+\s+\d{4})", False), (r"Ref\s*(\d{10,})", True)),
    "axis": ((r"(?:Acct|A/c)\s*XX(\d{4})", True), (r"on\s*(\d{8}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}/\d{1,2}/\d{4})", False), (r"Ref\s*(\d{10,})", True)),
    "kotak": ((r"A/c\s*(?:XX)?(\d{4})", True), (r"on\s*(\d{8}|\d{1,2}-\d{1,2}-\d{2,4}|\d{1,2}\s+\w+\s+\d{4})", False), (r"Ref[:\s.]*(\d{10,})", True)),
}
APP_FORMAT = ((r"(?:a/c|account)\s*(?:XX)?(\d{4})", True), (r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}\s+\w+\s+\d{4})", False), (r"(?:Ref|Txn\s*ID)[:\s]*(\d{10,})", True))
APPS = ["phonepe", "gpay", "paytm"]
CLEAN_BANKS = SIMPLE_BANKS | {"sbi": ["sbi", "state bank"]}
CLEAN_DEBIT, CLEAN_CREDIT = ["debited", "sent", "paid", "payment of"], ["credited", "received", "added"]
STRICT_BANKS = {"hdfc": ["hdfc bank", "hdfcbank"], "icici": ["icici bank"], "sbi": ["state bank", "sbi:"], "axis": ["axis bank"], "kotak": ["kotak"]}
STRICT_AMOUNT = [r"Rs\.?\s*([\d,]+\.?\d*)", r"INR\s*([\d,]+\.?\d*)"]
STRICT_ACCOUNT = r"(?:XX|X|\*\*|account\s*)(\d{4})"
STRICT_DATE = r"on\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
STRICT_REFERENCE = [r"reference number is\s*(\d{10,})", r"(?:Ref(?:erence)?[:\s.]*|UPI\s*Ref[:\s]*|IMPS\s*Ref[:\s]*)(\d{10,})"]


def simple_label_fields(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    named = F.lower(F.trim(first_match(text, SIMPLE_MERCHANT, 2, False)))
    return {
        "bank": first_label(low, SIMPLE_BANKS),
        "type": F.when(has_any(low, ["debited", "sent", "paid"]), "debit").when(has_any(low, ["credited", "received"]), "credit"),
        "amount": F.translate(in_order(text, SIMPLE_AMOUNT), ",", ""),
        "account": in_order(text, SIMPLE_ACCOUNT),
        "date": in_order(text, SIMPLE_DATE),
        "reference": in_order(text, SIMPLE_REFERENCE),
        "merchant": F.coalesce(named, first_label(low, {m: [m] for m in SIMPLE_MERCHANTS})),
    }


def bank_label_fields(text: Column, bank: Column) -> dict[str, Column]:
    low = F.lower(text)

    def of(i: int) -> Column:
        out = F.when(bank.isin(APPS), first_match(text, APP_FORMAT[i][0], 1, APP_FORMAT[i][1]))
        for name, formats in BANK_FORMATS.items():
            out = out.when(bank == name, first_match(text, formats[i][0], 1, formats[i][1]))
        return out

    return {
        "amount": F.translate(in_order(text, SIMPLE_AMOUNT[:3]), ",", ""),
        "type": F.when(has_any(low, CLEAN_DEBIT), "debit").when(has_any(low, CLEAN_CREDIT), "credit"),
        "account": of(0),
        "date": of(1),
        "reference": of(2),
    }


def strict_label_fields(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "amount": F.translate(in_order(text, STRICT_AMOUNT), ",", ""),
        "type": F.when(F.contains(low, F.lit("debited")), "debit").when(F.contains(low, F.lit("credited")), "credit"),
        "account": first_match(text, STRICT_ACCOUNT),
        "date": first_match(text, STRICT_DATE, 1, False),
        "reference": in_order(text, STRICT_REFERENCE),
    }


def discovery_fields(text: Column) -> dict[str, Column]:
    """Case-sensitive probes used to find patterns."""
    return {
        "amount": F.translate(first_match(text, r"(?:Rs\.?|₹)\s*([\d,]+(?:\.\d{2})?)", 1, False), ",", ""),
        "account": first_match(text, r"(?:A/c|account)\s*(?:no\.?)?\s*[:\s]*(\w+)"),
        "date": first_match(text, r"(\d{2}[-/]\d{2}[-/]\d{2,4})", 1, False),
        "reference": first_match(text, r"(?:ref|reference)\s*(?:no\.?)?[:\s]*(\d+)"),
        "type": F.when(F.lower(text).rlike("debit"), "debit").when(F.lower(text).rlike("credit"), "credit"),
    }
