"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. A stage works on all rows that
its predecessor kept:

* quality rules: rejected documents go;
* line dedup: repeated template lines go from the texts; a document whose every line with words
  goes that way is a repeat as a whole and goes too;
* near-dedup: of each group the document with the least id stays;
* decontamination: documents with a benchmark window go;
* encoding: doc_id, n_tokens, the ids (little-endian, 32 bits), their digest and whether decoding gives the text back.

Documents that no rule names pass unchanged, those with null or empty text included
where their stage allows it (the quality rules reject texts of fewer than ten words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnweave.llm import bpe, decontaminate, line_dedup, minhash, quality_rules
from txnweave.llm.common import new_path

#: A subword encoding can't be said in SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.filter_documents(spark, docs, labels)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(spark, docs)
    emptied = (F.col("__n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    ids = bpe.encode(spark, given, carry=["doc_id", "text_sha256"])
    out = bpe.decode(spark, ids.withColumn("n_tokens", F.size("ids").cast("long")))
    return out.select("doc_id", "n_tokens", "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
