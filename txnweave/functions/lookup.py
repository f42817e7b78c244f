"""Rule lookups: merchants, categories, banks, mail classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .patterns import has_any, holds_any, let, strip


def merchant_rules(spark: SparkSession) -> DataFrame:
    """(ord, key, name, category): a fixed list."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(c).alias("category")) for i, (k, n, c) in enumerate(rules.MERCHANTS)]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def vpa_user(vpa: Column) -> Column:
    return F.substring_index(F.lower(F.trim(vpa)), "@", 1)


def _table(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def merchant_from_vpa(vpa: Column) -> Column:
    """The exact key, else the first key in order that the user part contains."""
    names = _table([(k, n) for k, n, _ in rules.MERCHANTS])
    keys = F.array(*[F.lit(k) for k, _, _ in rules.MERCHANTS])

    def find(user: Column) -> Column:
        part = F.try_element_at(F.filter(keys, lambda k: F.contains(user, k)), F.lit(1))
        return F.coalesce(F.try_element_at(names, user), F.when(holds_any(user, [k for k, _, _ in rules.MERCHANTS]), F.try_element_at(names, part)))

    return let(vpa_user(vpa), find)


def known_category(merchant: str) -> str | None:
    """The category of the first rule whose key the merchant contains or whose name contains the merchant."""
    low = merchant.lower()
    return next((c for k, n, c in rules.MERCHANTS if k in low or low in n.lower()), None)


def category_from_merchant(merchant: Column) -> Column:
    """As ``known_category``, for any merchant."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n.lower()).alias("n"), F.lit(c).alias("c")) for k, n, c in rules.MERCHANTS])
    hit = lambda low: F.try_element_at(F.filter(rows, lambda r: F.contains(low, r["k"]) | F.contains(r["n"], low)), F.lit(1))["c"]
    return let(F.nullif(F.lower(F.trim(merchant)), F.lit("")), hit)


def category_from_text(text: Column) -> Column:
    """The category with most words in the text; ties go to the first defined."""

    def best(low: Column) -> Column:
        scored = []
        for i, (category, words) in enumerate(rules.CATEGORY_WORDS.items()):
            n = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
            scored.append(F.struct(n.alias("n"), F.lit(-i).alias("ord"), F.lit(category).alias("category")))
        # Most texts hold no word of any category; one search tells.
        return F.when(holds_any(low, [w for words in rules.CATEGORY_WORDS.values() for w in words]), F.array_max(F.array(*scored)))

    return let(let(F.lower(text), best), lambda b: F.when(b["n"] > 0, b["category"]))


def merchant_and_category(vpa: Column, text: Column) -> tuple[Column, Column]:
    """Merchants found by address have fixed names, so their categories are a table."""
    merchant = merchant_from_vpa(vpa)
    known = _table([(n, c) for n in dict.fromkeys(n for _, n, _ in rules.MERCHANTS) if (c := known_category(n))])
    return merchant, F.coalesce(F.try_element_at(known, merchant), category_from_text(text))


def app_from_vpa(vpa: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.VPA_APPS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.try_element_at(F.split(vpa, "@"), F.lit(2))))


#: Words and company forms that tell a merchant from a person.
MERCHANT_WORDS = [
    "swiggy", "zomato", "uber", "ola", "amazon", "flipkart", "paytm", "phonepe", "google", "youtube", "netflix", "spotify", "airtel",
    "jio", "vodafone", "bsnl", "electricity", "gas", "water", "bill", "store", "mart", "shop", "restaurant", "hotel", "hospital", "clinic",
    "pharmacy", "petrol", "fuel", "charging", "parking", "toll", "metro", "railway", "flight", "bus", "cab", "taxi", "rent", "insurance",
    "zepto", "bigbasket", "blinkit", "instamart", "dunzo", "myntra", "ajio", "nykaa", "tata", "reliance", "dmart", "more", "grofers",
]
COMPANY_FORMS = ["ltd", "pvt", "inc", "llp", "corp", "store", "shop", "mart", "services", "limited", "private"]


def is_merchant(name: Column) -> Column:
    low = F.lower(strip(name))
    shouting = (F.upper(name) == name) & name.rlike("[A-Z]") & name.rlike("[0-9]")
    return has_any(low, MERCHANT_WORDS + COMPANY_FORMS) | shouting


def classify_mail(subject: Column, sender: Column, body: Column) -> dict[str, Column]:
    """category, confidence, reason, is_transaction, score."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    everything = F.lower(F.concat_ws(" ", blank(subject), blank(sender), blank(body)))
    who = F.lower(blank(sender))

    def winner(low: Column) -> Column:
        scored = []
        for i, (category, (senders, words)) in enumerate(rules.MAIL_CATEGORIES.items()):
            named = F.filter(F.array(*[F.lit(w) for w in senders]), lambda w: F.contains(who, w))
            seen = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
            why = F.slice(F.concat(F.transform(named, lambda w: F.concat(F.lit("sender:"), w)), seen), 1, 3)
            n = 3 * F.size(named) + F.size(seen)
            scored.append(F.struct(n.alias("n"), F.lit(-i).alias("ord"), F.lit(category).alias("category"), why.alias("why")))
        return F.array_max(F.array(*scored))

    return _mail_fields(let(everything, winner), everything, (blank(subject) == "") & (blank(sender) == "") & (blank(body) == ""))


def _mail_fields(best: Column, everything: Column, empty: Column) -> dict[str, Column]:
    some = (best["n"] > 0) & (F.length(F.trim(everything)) > 0)
    return {
        "category": F.when(some, best["category"]).otherwise("other"),
        "score": F.when(some, best["n"]).otherwise(0),
        "confidence": F.when(some & (best["n"] >= 5), "high").when(some & (best["n"] >= 3), "medium").otherwise("low"),
        "reason": F.when(empty, "No content to classify").when(some, F.concat(F.lit("Matched: "), F.array_join(best["why"], ", "))).otherwise("No matching patterns found"),
        "is_transaction": ~empty & has_any(everything, rules.TRANSACTION_WORDS),
    }


def with_mail_class(df: DataFrame, subject: str, sender: str, body: str) -> DataFrame:
    """Adds the columns of ``classify_mail``. The counts are plain sums made once a row; only the winner's words are listed."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    low, who = F.col("__low"), F.col("__who")
    found = lambda text, words, times: [F.contains(text, F.lit(w)).cast("int") * times for w in words]
    total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    marked = df.select("*", F.lower(F.concat_ws(" ", blank(subject), blank(sender), blank(body))).alias("__low"), F.lower(blank(sender)).alias("__who"), ((blank(subject) == "") & (blank(sender) == "") & (blank(body) == "")).alias("__empty"))
    counts = [F.struct(total(found(who, senders, 3) + found(low, words, 1)).alias("n"), F.lit(-i).alias("ord")) for i, (senders, words) in enumerate(rules.MAIL_CATEGORIES.values())]
    won = marked.select("*", F.array_max(F.array(*counts)).alias("__won"))
    at = (1 - F.col("__won.ord")).cast("int")
    lists = lambda k: F.element_at(F.array(*[F.array(*[F.lit(w) for w in pair[k]]) for pair in rules.MAIL_CATEGORIES.values()]), at)
    named = F.transform(F.filter(lists(0), lambda w: F.contains(who, w)), lambda w: F.concat(F.lit("sender:"), w))
    why = F.slice(F.concat(named, F.filter(lists(1), lambda w: F.contains(low, w))), 1, 3)
    category = F.element_at(F.array(*[F.lit(c) for c in rules.MAIL_CATEGORIES]), at)
    best = won.select("*", F.struct(F.col("__won.n").alias("n"), category.alias("category"), why.alias("why")).alias("__best"))
    fields = _mail_fields(F.col("__best"), low, F.col("__empty"))
    return best.select(*df.columns, *[c.alias(k) for k, c in fields.items()])
