"""Queries through files and streams: what is written is derived from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators import routing
from ..scratch import new_folder
from .extraction_queries import CLASSED, SCORED
from .messages import files_size, messages
from .oracle_base import MSG, clean_corpus


def _text(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("msg_id", "ts", "sender", "subject", "text", "variant")


def _said(c: str = "text") -> F.Column:
    """Some texts hold quotes, commas and line ends."""
    return F.when(F.col("msg_id") % 5 == 0, F.concat(F.col(c), F.lit('\nsaid "yes, {and} no"\n'), F.col("sender"))).otherwise(F.col(c))


_SAID = "CASE WHEN msg_id % 5 = 0 THEN text || chr(10) || 'said \"yes, {and} no\"' || chr(10) || sender ELSE text END"


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of exports with headers of their own; some bodies are blank, some go over several lines."""
    path = new_folder(spark, "csv")
    m = _text(spark, d)
    body = F.when(F.col("msg_id") % 10 == 1, "").otherwise(_said())
    day = F.date_format("ts", "yyyy-MM-dd")
    m.where("variant < 8").select(day.alias("Date"), F.col("sender").alias("From"), body.alias("SMS")).write.option("header", True).option("escape", '"').csv(f"{path}/a")
    m.where("variant >= 8").select(F.col("msg_id").alias("no"), body.alias("MESSAGE"), F.col("sender").alias("Bank"), day.alias("created_at")).write.option("header", True).option("escape", '"').csv(f"{path}/b")
    return sources.read_csv(spark, path)


def json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bare lists, objects that hold one, and single objects."""
    path = new_folder(spark, "json")
    merchant = F.struct(F.col("sender").alias("name"))
    row = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("variant") % 2 == 0, F.col("sender")).alias("address"), F.when(F.col("variant") != 3, _said()).alias("message"), F.when(F.col("variant") == 3, F.col("msg_id")).alias("amount"), merchant.alias("merchant"))
    _write_exports(_text(spark, d), row, path)
    return sources.read_json(spark, path)


def _write_exports(m: DataFrame, row, path: str, name: str = "messages") -> None:
    """A JSON document for each 500 messages: [...], {name: [...]} and, for the last in a pack, {...}. Documents share files, one after the other: a file each costs more than its messages."""
    item = F.to_json(row)
    packs = m.groupBy(F.floor(F.col("msg_id") / 500).alias("pack"), (F.col("msg_id") % 500 == 499).alias("alone")).agg(F.array_join(F.collect_list(item), ",\n").alias("x"))
    whole = F.when(F.col("alone"), F.col("x")).when(F.col("pack") % 2 == 0, F.concat(F.lit("["), "x", F.lit("]"))).otherwise(F.concat(F.lit(f'{{"about": {{"n": [1]}}, "{name}": ['), "x", F.lit("]}")))
    packs.select(whole.alias("value")).write.text(path)


def xml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two exports, one with each of the known tags."""
    path = new_folder(spark, "xml")
    m = _text(spark, d)
    _write_xml(m.where("msg_id % 2 = 0"), f"{path}/a", "sms")
    _write_xml(m.where("msg_id % 2 = 1"), f"{path}/b", "message")
    return sources.read_sms_xml(spark, f"{path}/*")


def _write_xml(m: DataFrame, path: str, tag: str) -> None:
    millis = F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    m = m.select(F.col("sender").alias("_address"), millis.alias("_date"), F.col("text").alias("_body"), F.lit("x").alias("kind"))
    m.write.format("xml").option("rowTag", tag).option("rootTag", "smses").save(path)


def mbox_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "mbox")
    _write_mails(_text(spark, d), path)
    return sources.read_mbox(spark, path)


def _write_mails(m: DataFrame, path: str) -> None:
    date = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss")
    mail = F.concat(
        F.lit("From x\nDate: "), date, F.lit(" +0000\nFrom: =?utf-8?q?"), "sender", F.lit("?=\nSubject: "), "subject", F.lit("\nMIME-Version: 1.0\nContent-Type: "),
        F.when(F.col("variant") % 2 == 0, "text/plain").otherwise("text/html"), F.lit("; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(F.when(F.col("variant") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("<p>"), "text", F.lit("</p>"))).cast("binary")),
    )
    m.select(mail.alias("value")).write.text(path)


def unified(spark: SparkSession, d: str) -> DataFrame:
    """Every message in one of the four formats, every fifth in a second one, in folders within folders, told apart by extension."""
    root = new_folder(spark, "unify")
    m = _text(spark, d)
    of = lambda i: m.where((F.col("msg_id") % 4 == i) | (F.col("msg_id") % 5 == i))
    of(0).select(F.date_format("ts", "yyyy").alias("Date"), "sender", F.col("text").alias("SMS")).write.option("header", True).option("escape", '"').csv(f"{root}/2023/csv")
    _write_exports(of(1), F.struct(F.date_format("ts", "yyyy").alias("date"), F.col("sender").alias("address"), F.col("text").alias("message")), f"{root}/2023/raw/json", "items")
    _write_xml(of(2), f"{root}/2024/xml", "message")
    _write_mails(of(3), f"{root}/mbox")
    _rename(spark, f"{root}/2023/raw/json", "json")
    _rename(spark, f"{root}/mbox", "mbox")
    return sources.unify(spark, root).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))


def _rename(spark: SparkSession, folder: str, kind: str) -> None:
    """Spark's text files get the extension of what they hold."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.listStatus(path(folder)):
        name = x.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(x.getPath(), path(folder, f"{name[:-4]}.{kind}"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Training lines with broken ones among them."""
    path = new_folder(spark, "jsonl")
    m = _text(spark, d).select(F.col("text").alias("input"), F.col("msg_id").cast("string").alias("output"))
    sources.write_training_jsonl(m, f"{path}/good")
    m.select(F.concat(F.lit('{"input": '), "output").alias("value")).write.text(f"{path}/bad")
    return sources.read_jsonl(spark, f"{path}/*", "input string, output string")


def line_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "lines")
    _text(spark, d).select(F.concat(F.lit("\n"), "text", F.lit("\n  "))).write.text(path)
    return sources.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def routed_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "routed")
    sources.write_routed(routing.with_class(_text(spark, d)).select("msg_id", "text", "filter_reason", "classification"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("classification", "filter_reason").agg(F.count("*").alias("n"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages, and every fifth one cut in the middle, so that a tag or comment may stay open."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    html = F.when(F.col("page_id") % 5 == 0, F.substring("html", 1, 400)).otherwise(F.col("html"))
    return p.withColumn("html", html).select("page_id", F.sha2(F.coalesce(sources.html_text(F.col("html")), F.lit("")), 256).alias("digest"))


def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    lines = sources.term_lines(x, "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))
    parts = sources.sections(x, "text").groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    return lines.join(parts, "doc_id", "left").select("doc_id", "n_lines", "chars", F.coalesce("n_sections", F.lit(0)).cast("long").alias("n_sections"))


def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    m = _text(spark, d).select("text", F.lit("mail").alias("source"))
    c = spark.read.parquet(f"{d}/conversations.parquet").select("text", F.lit("chat").alias("source"))
    return sources.corpus([m, c]).groupBy("source").agg(F.count("*").alias("docs"))


# --- streams ------------------------------------------------------------------

#: Bytes of messages that one task of a stream classifies.
STREAM_TASK_BYTES = 8 << 20


def _stream(spark: SparkSession, d: str, tag: str) -> tuple[DataFrame, str]:
    root = new_folder(spark, tag)
    _text(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    return spark.readStream.schema(schema).parquet(f"{root}/in"), root


def _dealt(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    """The stream's rows in as many tasks as its first files' bytes ask for: Spark packs files into tasks for reading, here searching the texts is the work."""
    tasks = -(-files_size(spark, spark.read.schema(stream.schema).parquet(f"{root}/in")) // STREAM_TASK_BYTES)
    return stream.repartition(max(tasks, spark.sparkContext.defaultParallelism))


def stream_extract(spark: SparkSession, d: str) -> DataFrame:
    stream, root = _stream(spark, d, "stream")
    streaming.run_once(spark, streaming.extract_stream(_dealt(spark, stream, root)), f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").groupBy("classification", "confidence").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    stream, root = _stream(spark, d, "dedup")
    streaming.run_once(spark, streaming.drop_repeats(stream, delay="36500 days"), f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").agg(F.count("*").alias("n"), F.count_distinct("content_key").alias("keys"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows closed by the watermark; a last event far ahead closes them all."""
    root = new_folder(spark, "counts")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    last = e.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    e.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    streaming.run_once(spark, streaming.live_counts(stream), f"{root}/out", f"{root}/ck")
    last.write.mode("append").parquet(f"{root}/in")
    streaming.run_once(spark, streaming.live_counts(stream), f"{root}/out", f"{root}/ck")
    out = spark.read.parquet(f"{root}/out").where("event_type != 'end'")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", "n", "total")


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals since the start from the stream's state: two arrivals, each a run of its own from one checkpoint."""
    root = new_folder(spark, "totals")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    for first in (True, False):
        half = F.col("event_id") % 3 == 0
        e.where(half if first else ~half).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        streaming.keep_totals(streaming.running_totals(stream), f"{root}/out", f"{root}/ck")
    batches = spark.read.parquet(f"{root}/out").where("batch > 0").select("event_type", F.col("n").alias("n_last_batch"))
    out = streaming.latest_totals(spark, f"{root}/out")
    return out.join(batches, "event_type").select("event_type", "n", "n_last_batch", F.col("total").cast("double").alias("total"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def stream_fan_out(spark: SparkSession, d: str) -> DataFrame:
    stream, root = _stream(spark, d, "fan")
    streaming.fan_out(routing.with_class(_dealt(spark, stream, root)), f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").groupBy(F.col("classification").alias("folder")).agg(F.count("*").alias("n"))


def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two arrivals; the second call processes only the new files."""
    stream, root = _stream(spark, d, "inc")
    streaming.run_once(spark, stream, f"{root}/out", f"{root}/ck")
    more = _text(spark, d).where("msg_id % 7 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    more.write.mode("append").parquet(f"{root}/in")
    streaming.run_once(spark, stream, f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("ids"))


_HTML = "html"
for _t in ("script", "style", "nav", "footer", "header"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_t}\\b.*?(?:</{_t}\\s*>|\\z)', '', 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '<[^>]*>', chr(10), 'g')"
for _n, _c in sources.ENTITIES.items():
    _HTML = "replace({}, '{}', '{}')".format(_HTML, _n, _c.replace("'", "''"))
_HTML = f"substr(array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)), 1, 10000)"

QUERIES = {
    "a5_csv_scan": (csv_scan, f"WITH {MSG} SELECT strftime(ts, '%Y-%m-%d') AS timestamp, sender, {_SAID} AS body, 'csv' AS source FROM msg WHERE msg_id % 10 <> 1"),
    "a4_json_scan": (json_scan, f"WITH {MSG} SELECT strftime(ts, '%Y-%m-%d') AS timestamp, sender, CASE WHEN variant = 3 THEN 'Transaction: Rs.' || msg_id || ' to ' || sender ELSE {_SAID} END AS body, 'json' AS source FROM msg"),
    "a6_xml_scan": (xml_scan, f"WITH {MSG} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, sender, text AS body, 'xml' AS source FROM msg"),
    "a1_mbox_scan": (mbox_scan, f"WITH {MSG} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, sender, text AS body, 'mbox' AS source, subject FROM msg"),
    "a7_unify": (unified, f"""WITH {MSG}, u AS ({" UNION ALL ".join(f"SELECT text, '{k}' AS source FROM msg WHERE msg_id % 4 = {i} OR msg_id % 5 = {i}" for i, k in enumerate(("csv", "json", "xml", "mbox")))}),
f AS (SELECT text, min(source) AS source FROM u GROUP BY text) SELECT source, count(*) AS n, count(DISTINCT text) AS bodies FROM f GROUP BY ALL"""),
    "a13_jsonl": (jsonl_round_trip, f"WITH {MSG} SELECT text AS input, msg_id::VARCHAR AS output FROM msg"),
    "a11_lines": (line_scan, f"WITH {MSG} SELECT text, count(*) AS n FROM msg GROUP BY ALL"),
    "a12_routed_sink": (routed_sink, f"WITH {MSG}, {CLASSED} SELECT classification, filter_reason, count(*) AS n FROM classed GROUP BY ALL"),
    "a18_page_text": (page_text, f"WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN substr(html, 1, 400) ELSE html END AS html FROM pages), t AS (SELECT page_id, {_HTML} AS x FROM p) SELECT page_id, sha256(CASE WHEN length(x) > 100 THEN x ELSE '' END) AS digest FROM t"),
    "a16_doc_sections": (doc_sections, """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents),
a AS (SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM l WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#') GROUP BY ALL), b AS (SELECT doc_id, count(*) AS n_sections FROM s WHERE length(trim(part, ' ')) > 50 GROUP BY ALL)
SELECT doc_id, n_lines, chars, coalesce(n_sections, 0) AS n_sections FROM a LEFT JOIN b USING (doc_id)"""),
    "k16_corpus_build": (corpus_build, f"""WITH {MSG}, u AS (SELECT text, 'mail' AS source FROM msg UNION ALL SELECT text, 'chat' FROM conversations)
SELECT source, count(*) AS docs FROM u WHERE len(regexp_extract_all({clean_corpus('text')}, '[^ ]+')) >= 10 GROUP BY ALL"""),
    "l1_stream_extract": (stream_extract, f"WITH {MSG}, {SCORED}, {CLASSED} SELECT classification, confidence, count(*) AS n, count(amount) AS n_amount FROM done JOIN classed USING (msg_id) GROUP BY ALL"),
    "l2_stream_dedup": (stream_dedup, f"WITH {MSG} SELECT count(DISTINCT lower(text)) AS n, count(DISTINCT lower(text)) AS keys FROM msg"),
    "l3_stream_counts": (stream_counts, "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "l3_stream_totals": (stream_totals, "SELECT event_type, count(*) AS n, count(*) AS n_last_batch, sum(value::DECIMAL(28,6))::DOUBLE AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY ALL"),
    "l4_stream_incremental": (stream_incremental, f"WITH {MSG} SELECT count(*) + count_if(msg_id % 7 = 0)::BIGINT AS n, count(DISTINCT msg_id) AS ids FROM msg"),
    "l5_stream_fan_out": (stream_fan_out, f"WITH {MSG}, {CLASSED} SELECT classification AS folder, count(*) AS n FROM classed GROUP BY ALL"),
}
