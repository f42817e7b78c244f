"""Messages rendered from facts: templates chosen by key, placeholders filled.

The facts are orders: amount, account, date and reference are columns of the
order, so what is extracted from a message can be checked against its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANKS = ["HDFC", "ICICI", "SBI", "Axis", "Kotak"]
SHOPS = ["swiggy", "zomato", "amazon", "uber", "netflix", "airtel", "apollo", "zerodha", "ramesh.k", "priya99", "bigbasket", "irctc"]
HANDLES = ["ybl", "paytm", "okaxis", "oksbi", "icici"]
#: (type, template)
TEMPLATES = [
    ("debit", "{bank} Bank: Rs.{amt} debited from A/c XX{acct} on {dmy} to VPA {shop}@{handle}. UPI Ref: {ref}"),
    ("credit", "{bank} Bank: Rs {commas} credited to A/c XX{acct} on {slash} from VPA {shop}@{handle}. Ref {ref}"),
    ("debit", "Dear Customer, INR {amt} spent on your {bank} Credit Card ending {acct} at {shop} on {month}. Txn ID {ref}"),
    ("debit", "Rs.{amt}debited from account {acct} to {shop}@{handle} on {dmy}"),
    ("credit", "₹{commas} received in {bank} A/c no. {acct} by NEFT. Reference: {ref}. Avl bal: Rs.{bal}"),
    ("debit", "Paid {amt} to merchant. Amount: {amt} via IMPS from XX{acct}, UTR {ref}"),
    ("credit", "INR {lakh} Lakh credited to your A/c {acct} on {short} - {bank}"),
    ("debit", "ICICI Bank Acct XX{acct} debited for Rs {amt} on {dashed}; {shopname} credited. UPI:{ref}"),
    ("credit", "Dear Customer, Acct XX{acct} is credited with Rs {amt} on {dashed} from {shopname}. UPI:{ref}"),
    ("debit", "{bank}: withdrawn Rs.{amt} and fee Rs.20.00 on {dmy}. Bal Rs.{bal}"),
    (None, "Your OTP is {otp} and is valid for 10 min. Do not share it with anyone."),
    (None, "Exclusive offer! Get 20% off, shop now at {shop}. Flat Rs.500 off on orders"),
    (None, "Hi {shop}"),
    (None, "Your order at {shop} for Rs.{amt} is out for delivery"),
    ("debit", "Payment of Rs.{amt} to {shop} failed on {dmy}. Ref {ref}"),
    ("debit", "Rs.{amt} has been debited from account {acct} to VPA {shop}@{handle} SHOP on {dmy}. Your UPI transaction reference number is {ref}."),
]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def facts(orders: DataFrame) -> DataFrame:
    """One row for each order: the true values of its message."""
    key = F.col("o_orderkey")
    variant = F.pmod(key, F.lit(len(TEMPLATES)))
    return orders.select(
        key.alias("msg_id"),
        F.col("o_custkey").alias("cust_id"),
        F.col("o_orderdate").alias("ts"),
        variant.alias("variant"),
        _pick([t or "" for t, _ in TEMPLATES], variant).alias("true_type"),
        F.round("o_totalprice", 2).alias("true_amount"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("true_account"),
        F.lpad(key.cast("string"), 12, "0").alias("true_reference"),
        _pick(BANKS, F.pmod("o_custkey", F.lit(len(BANKS)))).alias("true_bank"),
        _pick(SHOPS, F.pmod(F.floor(key / len(TEMPLATES)), F.lit(len(SHOPS)))).alias("shop"),
        _pick(HANDLES, F.pmod(key, F.lit(len(HANDLES)))).alias("handle"),
    )


def render(fact: DataFrame) -> DataFrame:
    """Adds text, sender and subject."""
    amount, day = F.col("true_amount"), F.col("ts")
    filled = {
        "bank": F.col("true_bank"),
        "amt": F.format_string("%.2f", amount),
        "commas": F.format_number(amount, 2),
        "lakh": F.format_string("%.2f", F.round(amount / 100000, 2)),
        "bal": F.format_string("%.2f", F.round(amount * 3, 2)),
        "acct": F.col("true_account"),
        "dmy": F.date_format(day, "dd-MM-yyyy"),
        "slash": F.date_format(day, "dd/MM/yy"),
        "short": F.date_format(day, "dd-MM-yy"),
        "month": F.date_format(day, "dd MMM yyyy"),
        "dashed": F.date_format(day, "dd-MMM-yy"),
        "shop": F.col("shop"),
        "shopname": F.translate(F.upper(F.col("shop")), ".", " "),
        "handle": F.col("handle"),
        "ref": F.col("true_reference"),
        "otp": F.lpad((F.col("msg_id") % 1000000).cast("string"), 6, "1"),
    }
    # Only the values that a template names are formatted; a row with a null fact has no text, whatever its template.
    texts = F.when(F.col("true_amount").isNull() | day.isNull() | F.col("true_account").isNull() | F.col("msg_id").isNull(), None)
    for i, (_, template) in enumerate(TEMPLATES):
        parts = re.split(r"\{(\w+)\}", template)
        said = [filled[p] if at % 2 else F.lit(p) for at, p in enumerate(parts) if p]
        texts = texts.when(F.col("variant") == i, F.concat(*said))
    text = texts
    sender = F.concat(F.lit("VM-"), F.upper("true_bank"), F.lit("BK"))
    subject = F.when(F.col("variant") % 3 == 0, F.concat("true_bank", F.lit(" transaction alert"))).otherwise("")
    # A generator keeps the text one column: filters on it don't repeat the rendering below.
    return fact.select("*", F.explode(F.array(text)).alias("text"), sender.alias("sender"), subject.alias("subject"))


#: Bytes of orders for which one task renders the messages.
TASK_BYTES = 1 << 20


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(facts(spread(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"), TASK_BYTES)))


def spread(spark: SparkSession, df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Deals a table over all cores: here rendering is the work, not reading.

    A table of fewer partitions than cores is dealt anew; with ``task_bytes`` also one with fewer than a partition for each
    so many bytes of its files, as a file's row groups can't be split further, however few they are.
    """
    wanted = spark.sparkContext.defaultParallelism
    if task_bytes:
        wanted = max(wanted, -(-files_size(spark, df) // task_bytes))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def files_size(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in df.inputFiles())
