"""Scalar normalisation and formatting of amounts, dates, accounts and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .patterns import compact, has_any, strip

NATIVE_DIGITS = {"hi": "०१२३४५६७८९", "bn": "০১২৩৪৫৬৭৮৯", "ta": "௦௧௨௩௪௫௬௭௮௯", "kn": "೦೧೨೩೪೫೬೭೮೯"}
DATE_FORMATS = ["d-M-yyyy", "d-M-yy", "d/M/yyyy", "d/M/yy", "d MMM yyyy", "d MMM yy", "d MMMM yyyy", "d MMMM yy", "yyyy-M-d", "d.M.yyyy", "d.M.yy"]


def ascii_digits(text: Column) -> Column:
    """Native digits to 0-9."""
    return F.translate(text, "".join(NATIVE_DIGITS.values()), "0123456789" * len(NATIVE_DIGITS))


def native_digits(text: Column, language: str) -> Column:
    return F.translate(text, "0123456789", NATIVE_DIGITS[language])


def amount(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(text), r"(?i)^(?:Rs\.?|INR|₹)\s*", "")
    return F.translate(ascii_digits(cleaned), ", ", "").try_cast("double")


def date(text: Column) -> Column:
    """``dd-MM-yyyy``. Two-digit years from 69 on are of the last century."""
    cleaned = compact(text)
    # A format is tried only where its separator stands: what it can't read costs most.
    day = F.coalesce(*[F.when(F.contains(cleaned, F.lit(next(x for x in "-/. " if x in f))), F.try_to_timestamp(cleaned, F.lit(f))) for f in DATE_FORMATS]).cast("date")
    day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return F.date_format(day, "dd-MM-yyyy")


def account(text: Column, mask: bool = False) -> Column:
    digits = F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(""))
    if not mask:
        return digits
    return F.when(F.length(digits) > 4, F.concat(F.repeat(F.lit("*"), F.length(digits) - 4), F.right(digits, F.lit(4)))).otherwise(digits)


def reference(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^A-Za-z0-9]", ""), F.lit(""))


def vpa(text: Column) -> Column:
    cleaned = F.lower(strip(text))
    return F.when(F.contains(cleaned, F.lit("@")), cleaned)


#: Prefixes, stripped one after the other.
MERCHANT_PREFIXES = ["payment to", "paid to", "transfer to", "upi-"]


def merchant(text: Column) -> Column:
    out = strip(text)
    for prefix in MERCHANT_PREFIXES:
        out = strip(F.regexp_replace(out, f"(?i)^{prefix}", ""))
    return F.nullif(out, F.lit(""))


#: Substrings that tell the type.
DEBIT_WORDS = ["debit", "debited", "withdrawn", "sent", "paid", "spent", "purchase"]
CREDIT_WORDS = ["credit", "credited", "received", "refund", "cashback", "reversed"]


def txn_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(has_any(low, DEBIT_WORDS), "debit").when(has_any(low, CREDIT_WORDS), "credit")


def clean_mail(text: Column) -> Column:
    out = F.regexp_replace(text, r"https?://\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\S{100,}", ""))


def clean_mail_strict(text: Column) -> Column:
    out = F.regexp_replace(text, r"https?://\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"\S+@\S+", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\S{80,}", ""))


#: Fixed value: characters that a corpus text keeps beside letters, digits, the underscore and white space.
CORPUS_SIGNS = r"""₹$€£¥.,;:!?@#%&*()\[\]{}<>+=\-/\\|'"°"""


def clean_corpus(text: Column) -> Column:
    """White space to one blank, then only letters, digits and the signs of CORPUS_SIGNS; combining marks go."""
    out = F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " ")
    return F.trim(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_ {CORPUS_SIGNS}]", ""))


def content_key(text: Column) -> Column:
    return F.sha2(F.lower(strip(text)), 256)


def beneficiary(name: Column) -> Column:
    out = F.regexp_replace(F.trim(name), r"(?i)\s+credited\.?$", "")
    out = F.regexp_replace(out, r"(?i)\s+debited\.?$", "")
    return F.trim(F.when((F.upper(out) == out) & out.rlike("[A-Z]"), F.initcap(F.lower(out))).otherwise(out))


def indian_groups(whole: Column) -> Column:
    """12345678 -> 1,23,45,678."""
    return F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")


def money(value: Column) -> dict[str, Column]:
    """The formats of an amount; value is rounded half up to two places."""
    v = value.cast("decimal(18,2)")
    whole = F.floor(v).cast("long")
    cents = F.lpad((v * 100 - whole * 100).cast("int").cast("string"), 2, "0")
    scaled = lambda by, unit: F.concat(F.round(v / by, 1).cast("decimal(18,1)").cast("string"), F.lit(unit))
    return {
        "integer": whole.cast("string"),
        "two_places": F.concat(whole.cast("string"), F.lit("."), cents),
        "one_place": F.round(v, 1).cast("decimal(18,1)").cast("string"),
        "commas": F.format_number(v, 2),
        "indian": F.concat(indian_groups(whole), F.lit("."), cents),
        "indian_whole": indian_groups(whole),
        "compact": F.when(v >= 10000000, scaled(10000000, "Cr")).when(v >= 100000, scaled(100000, "L")).when(v >= 1000, scaled(1000, "K")).otherwise(whole.cast("string")),
        "padded": F.concat(F.lpad(whole.cast("string"), 8, "0"), F.lit("."), cents),
    }


#: How a date is written, by name.
DATE_STYLES = {
    "dmy": "dd-MM-yy", "dmy_long": "dd-MM-yyyy", "slashes": "dd/MM/yy", "slashes_long": "dd/MM/yyyy", "month": "dd MMM yy", "month_long": "dd MMM yyyy",
    "dashed_month": "dd-MMM-yy", "iso": "yyyy-MM-dd", "compact": "ddMMyyyy", "us": "MMM dd, yyyy",
}


def written_dates(day: Column, as_of: Column) -> dict[str, Column]:
    out = {name: F.date_format(day, f) for name, f in DATE_STYLES.items()}
    ago = F.date_diff(as_of.cast("date"), day.cast("date"))
    return out | {"relative": F.when(ago == 0, "today").when(ago == 1, "yesterday").otherwise(F.date_format(day, "dd-MM-yyyy"))}


ACCOUNT_STYLES = {"XX": "XX", "lower": "xx", "stars": "****", "dots": "...", "plain": "", "X": "X"}


def account_styles(digits: Column) -> dict[str, Column]:
    last = F.right(digits, F.lit(4))
    return {name: F.concat(F.lit(mark), last) for name, mark in ACCOUNT_STYLES.items()}


def category(text: Column) -> Column:
    """A known category, else its synonym's, else 'other'."""
    low = F.lower(text)
    table = F.create_map(*[F.lit(x) for pair in rules.CATEGORY_SYNONYMS.items() for x in pair])
    return F.when(low.isin(rules.CATEGORIES), low).otherwise(F.coalesce(F.try_element_at(table, low), F.lit("other")))


def comparable(text: Column, compat: bool = False) -> Column:
    """For comparing values: lower, trimmed, no commas; numbers as numbers (``compat``: trailing zeros and dots cut)."""
    out = F.translate(F.lower(F.trim(text)), ",", "")
    if compat:
        return F.regexp_replace(F.regexp_replace(out, r"0+$", ""), r"\.+$", "")
    return F.coalesce(out.try_cast("decimal(18,2)").cast("string"), out)


def timestamp(text: Column) -> Column:
    """Mail dates and epoch milliseconds to ISO; anything else unchanged."""
    millis = F.when(text.rlike(r"^\d{11,}$"), F.timestamp_millis(text.try_cast("long")))
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.date_format(F.coalesce(millis, mail), "yyyy-MM-dd'T'HH:mm:ss"), text)
