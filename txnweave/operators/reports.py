"""Benchmark sets, exports of labels and reports about data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.patterns import first_label, has_any
from ..scratch import written
from . import datasets as D
from . import ranges, routing

#: Words of the filters.
SIMPLE_VERBS = ["debited", "credited", "received", "sent"]
CLEAN_VERBS = [*SIMPLE_VERBS, "paid", "payment"]
AMOUNT_SIGNS = ["rs.", "rs ", "inr", "₹"]


def _numbered(sample: DataFrame, key: str, seed: str) -> DataFrame:
    """Ids 1..n in seeded order; a sample is small by its limits."""
    return ranges.global_rank(sample, [D.unit_hash(F.col(key), seed), F.col(key)], "id")


def simple_set(df: DataFrame, key: str, text_col: str, training: DataFrame | None = None, n: int = 100, seed: str = "42") -> DataFrame:
    """A seeded sample of n messages of at least 50 characters with a verb and an amount that no training text begins like (first 100 characters), with simple labels and ids."""
    text = F.col(text_col)
    low = F.lower(text)
    found = df.where((F.length(text) >= 50) & has_any(low, SIMPLE_VERBS) & has_any(low, AMOUNT_SIGNS)).withColumn("__head", F.substring(text, 1, 100))
    if training is not None:
        heads = training.select(F.substring(text_col, 1, 100).alias("__head")).distinct()
        found = found.join(heads, "__head", "left_anti")
    sample = found.orderBy(D.unit_hash(F.col(key), seed), key).limit(n)
    labelled = sample.select(key, text_col, *[c.alias(k) for k, c in X.simple_label_fields(text).items()], F.lit(True).alias("auto_labeled"), F.lit(False).alias("verified"))
    return _numbered(labelled, key, seed)


def clean_set(df: DataFrame, key: str, text_col: str, sender_col: str, most: int = 20, seed: str = "42") -> DataFrame:
    """Messages over 50 characters with a verb and an amount, of a known bank, with amount and type by the bank's formats; one row for each reference of a bank (rows without one all count), at most ``most`` of a bank, with ids."""
    text = F.col(text_col)
    low = F.lower(text)
    found = df.where((F.length(text) > 50) & has_any(low, CLEAN_VERBS) & has_any(low, AMOUNT_SIGNS))
    found = found.withColumn("bank", first_label(F.lower(F.concat_ws(" ", text_col, sender_col)), X.CLEAN_BANKS)).where("bank IS NOT NULL")
    x = found.select(key, text_col, "bank", *[c.alias(k) for k, c in X.bank_label_fields(text, F.col("bank")).items()]).where("amount IS NOT NULL AND type IS NOT NULL")
    # Rows with and without a reference are taken apart: written once, their labels aren't found twice.
    return _numbered(_sampled(written(x, "clean-set"), key, most, seed), key, seed)


def _sampled(x: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    one = D.keep_first(x.where("reference IS NOT NULL"), ["bank", "reference"], [F.col(key)])
    return D.sample_per_group(one.select(*x.columns).unionByName(x.where("reference IS NULL")), "bank", key, most, seed)


def strict_set(df: DataFrame, key: str, text_col: str, sender_col: str, most: int = 15, seed: str = "42") -> DataFrame:
    """Messages of the strict filter with a bank, amount, type and reference; one row for each reference of a bank, at most ``most`` of a bank, with ids."""
    text = F.col(text_col)
    bank = first_label(F.lower(F.concat_ws(" ", text_col, sender_col)), X.STRICT_BANKS)
    x = df.where(routing.strict_filter(text)).select(key, text_col, bank.alias("bank"), *[c.alias(k) for k, c in X.strict_label_fields(text).items()])
    x = x.where("bank IS NOT NULL AND amount IS NOT NULL AND type IS NOT NULL AND reference IS NOT NULL")
    return _numbered(_sampled(x, key, most, seed), key, seed)


def export_labelled(labelled: DataFrame, key: str, prompt: Column, answer: Column, path: str, verified_only: bool = True, ratio: float = 0.9, seed: str = "42") -> None:
    """Labels as training lines {place, input, output}: in seeded order, the first floor(n x ratio) under split=train, the rest under split=valid.

    Unverified labels are left out unless ``verified_only`` is off. Files follow the order; place is the row's number in it.
    """
    chosen = labelled.where("verified") if verified_only else labelled
    lines = chosen.select(F.col(key).alias("__key"), prompt.alias("input"), answer.alias("output"))
    ranked = ranges.global_rank(lines, [D.unit_hash(F.col("__key"), seed), F.col("__key")], "place")
    n = ranked.count()
    split = F.when(F.col("place") <= int(n * ratio), "train").otherwise("valid")
    ordered = ranked.select("place", "input", "output", split.alias("split")).repartitionByRange("place").sortWithinPartitions("split", "place")
    ordered.write.partitionBy("split").json(path)


#: Share of repeated texts from which the report warns, and the issues that it lists.
MOST_DUPLICATES = 0.01
ISSUES = 20


def validation_report(df: DataFrame, key: str, text: Column, is_transaction: Column, required: dict[str, Column], shares: dict[str, Column]) -> DataFrame:
    """(section, name, n, share) of a data set.

    records: total, transactions, others, unique_texts, duplicates (share: of all records); warning: duplicate_rate, if it is above
    ``MOST_DUPLICATES``; one section for each of ``shares`` (a missing value is unknown) and issue: the first ``ISSUES``
    transactions by key that lack a required field (n: the key); valid: whether there is no issue. The
    rows are judged once and written as keys, flags and digests; everything is counted from those.
    """
    lacks = F.filter(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in required.items()]), lambda x: x.isNotNull())
    slim = df.select(F.col(key).alias("key"), F.sha2(text, 256).alias("digest"), is_transaction.alias("txn"), F.when(is_transaction, lacks).alias("lacks"), *[F.coalesce(c, F.lit("unknown")).alias(f"share_{n}") for n, c in shares.items()])
    slim = written(slim, "report")
    counts = slim.agg(F.count("*").alias("total"), F.count_if("txn").alias("transactions"), F.count_if(F.size("lacks") > 0).alias("flawed")).first()
    total, txn = counts["total"], counts["transactions"]
    # Null texts are one text.
    unique = slim.select("digest").distinct().count()
    rate = 1 - unique / total if total else 0.0
    spark = df.sparkSession
    fixed = [("records", "total", total, None), ("records", "transactions", txn, None), ("records", "others", total - txn, None), ("records", "unique_texts", unique, None), ("records", "duplicates", total - unique, rate), ("valid", str(not counts["flawed"]).lower(), counts["flawed"], None)]
    if rate > MOST_DUPLICATES:
        fixed.append(("warning", "duplicate_rate", total - unique, rate))
    out = spark.createDataFrame(fixed, "section string, name string, n long, share double")
    each = F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"share_{n}").alias("name")) for n in shares])
    counted = slim.where("txn").select(F.explode(each).alias("s")).groupBy("s.section", "s.name").agg(F.count("*").alias("n"))
    out = out.unionByName(counted.withColumn("share", F.col("n") / F.lit(float(txn or 1))))
    issues = slim.where(F.size("lacks") > 0).select("key", F.posexplode("lacks").alias("i", "field")).orderBy("key", "i").limit(ISSUES)
    return out.unionByName(issues.select(F.lit("issue").alias("section"), F.concat(F.lit("Missing "), "field").alias("name"), F.col("key").cast("long").alias("n"), F.lit(None).cast("double").alias("share")))


def transitions(df: DataFrame, text_col: str) -> DataFrame:
    """(kind, w1, w2, w3, n): how often texts start with a pair of words (w3 null), and how often a word follows a pair."""
    words = df.select(F.filter(F.split(F.lower(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).where(F.size("w") >= 2)
    start = F.array(F.struct(F.lit("start").alias("kind"), F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.lit(None).cast("string").alias("w3")))
    at = F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    three = F.transform(at, lambda i: F.struct(F.lit("next").alias("kind"), *[F.element_at("w", i + k).alias(f"w{k + 1}") for k in range(3)]))
    return words.select(F.explode(F.concat(start, three)).alias("t")).groupBy("t.kind", "t.w1", "t.w2", "t.w3").agg(F.count("*").alias("n"))


def next_word_shares(counts: DataFrame) -> DataFrame:
    """Adds share: of the times that a pair of words was seen, how often this word followed."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind", "w1", "w2")))
