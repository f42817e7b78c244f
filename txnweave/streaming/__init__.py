"""The same pipelines over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import extraction, routing


def extract_stream(messages: DataFrame) -> DataFrame:
    """Stateless: classify and extract each message."""
    return extraction.extract_messages(routing.with_class(messages))


def drop_repeats(messages: DataFrame, time_col: str = "ts", delay: str = "10 days") -> DataFrame:
    """The first of messages with one content within the watermark."""
    keyed = messages.withColumn("content_key", normalize.content_key(F.col("text")))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_key"])


def live_counts(events: DataFrame, time_col: str = "ts", width: str = "1 minute", delay: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def running_totals(events: DataFrame, keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Totals since the first event, as keyed state of the stream: it lives in the checkpoint, so a later run goes on from it.

    One row of state a key; values are added as decimals, so that the order of arrival doesn't matter.
    """
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).alias("total"), F.max("ts").alias("last_seen"))


def keep_totals(totals: DataFrame, out: str, checkpoint: str, update: bool = False) -> None:
    """Each batch's totals to a folder of its own; a batch that runs again overwrites what it wrote.

    ``update``: only the keys that the batch changed; ``latest_totals`` takes each key's last ones either way.
    """
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream = totals.writeStream.outputMode("update" if update else "complete").foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_totals(spark: SparkSession, out: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The last totals of each key."""
    written = spark.read.parquet(out)
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def run_once(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, mode: str = "append", partition_by: str | None = None) -> None:
    """Process what is there and stop; a later call goes on where this one ended."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(partition_by) if partition_by else writer).start()
    query.awaitTermination()


def fan_out(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Each batch's keep, garbage and uncertain rows to their own folders, classification=... in the batch's own folder, in one pass.

    A batch that runs again overwrites what it wrote before, so no row is there twice.
    """
    stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batch(batch: DataFrame, number: int, out: str) -> None:
    batch.write.mode("overwrite").partitionBy("classification").parquet(f"{out}/batch={number}")
