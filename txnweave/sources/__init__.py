"""Readers and writers of message exports, mails, statements and corpora.

Every reader gives columns (timestamp, sender, body, source) unless it says otherwise.
"""

from __future__ import annotations

import email
import email.header
import html
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import clean_corpus, timestamp
from ..functions.patterns import once
from ..operators.datasets import keep_first
from . import splittable

UNIFIED = ["timestamp", "sender", "body", "source"]
#: Names that columns go by, in order.
ALIASES = {
    "timestamp": ["timestamp", "date", "time", "datetime", "created_at"],
    "sender": ["sender", "from", "address", "phone"],
    "body": ["body", "message", "text", "content", "sms"],
}
CSV_ALIASES = {
    "timestamp": ALIASES["timestamp"],
    "sender": ["sender", "from", "source", "bank", "merchant", "address", "phone"],
    "body": ["body", "message", "text", "content", "description", "sms"],
}
JSON_ALIASES = {
    "timestamp": ["timestamp", "date", "time", "created_at", "datetime"],
    "sender": ["sender", "from", "source", "address", "phone"],
    "body": ["body", "message", "text", "content", "description", "title", "sms"],
}


def _first_of(df: DataFrame, names: list[str]) -> Column:
    """The first non-empty of the columns that are there, by case-insensitive name."""
    there = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{there[n]}`").cast("string")), F.lit("")) for n in names if n in there]
    return F.coalesce(*found, F.lit(None).cast("string"))


def _unified(df: DataFrame, source: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    body = _first_of(df, aliases["body"])
    out = df.select(timestamp(_first_of(df, aliases["timestamp"])).alias("timestamp"), _first_of(df, aliases["sender"]).alias("sender"), body.alias("body"), F.lit(source).alias("source"))
    return out.where(F.col("body").isNotNull() & (F.lower("body") != "nan"))


def read_csv(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """CSV with any of the known headers, each file its own; records with too many fields are skipped. Large files are read in splits."""
    return _unified(splittable.csv_records(spark, path, CSV_ALIASES, suffix), "csv")


#: Names under which an object holds its messages, in order.
WRAPPERS = ("messages", "transactions", "items", "data")


def read_json(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Lists of messages, objects that hold one under a known name, and single objects, each file its own way; rows with an amount become sentences.

    The fields are known, so no pass infers them; an item is parsed once for all of them; large files are read in splits.
    """
    names = list(dict.fromkeys(x for aliases in JSON_ALIASES.values() for x in aliases))
    schema = ", ".join(f"`{n}` string" for n in [*names, "amount", "merchant"])
    raw = once(splittable.json_items(spark, path, WRAPPERS, suffix), {"x": F.from_json("item", schema)}).select("x.*")
    who = F.when(F.startswith("merchant", F.lit("{")), F.get_json_object("merchant", "$.name")).otherwise(F.col("merchant"))
    said = F.when(F.col("amount").isNotNull(), F.concat(F.lit("Transaction: Rs."), F.col("amount"), F.lit(" to "), F.coalesce(who, F.lit("unknown"))))
    sender = F.coalesce(_first_of(raw, JSON_ALIASES["sender"]), who)
    return _unified(raw.withColumns({"body": F.coalesce(said, _first_of(raw, JSON_ALIASES["body"])), "sender": sender}), "json", JSON_ALIASES)


def read_sms_xml(spark: SparkSession, path: str, suffix: str = "", tags: tuple[str, ...] = ("sms", "message")) -> DataFrame:
    """<sms address date body/> exports; of a file without the first tag the elements of the next one."""
    out, before = [], None
    for tag in tags:
        raw = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
        if not raw.columns:
            continue
        rows = raw.select("*", F.col("_metadata.file_path").alias("__file"))
        if before is not None:
            rows = rows.join(before, "__file", "left_anti")
        seen = raw.select(F.col("_metadata.file_path").alias("__file")).distinct()  # one row a file
        before = seen if before is None else before.union(seen)
        rows = rows.drop("__file")
        out.append(_unified(rows.toDF(*[c.lstrip("_") for c in rows.columns]), "xml"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "timestamp string, sender string, body string, source string")


def _header(value: str | None) -> str:
    if not value:
        return ""
    parts = []
    for text, charset in email.header.decode_header(value):
        try:
            parts.append(text.decode(charset or "utf-8", "ignore") if isinstance(text, bytes) else text)
        except LookupError:
            parts.append(text.decode("utf-8", "ignore"))
    return "".join(parts)


def _mail_body(message: email.message.Message) -> str:
    """The first plain part, else the text of the first html part."""
    plain, markup = None, None
    for part in message.walk():
        if part.is_multipart():
            continue
        payload = part.get_payload(decode=True)
        text = payload.decode("utf-8", "ignore") if payload else ""
        if part.get_content_type() == "text/plain" and plain is None:
            plain = text
        elif part.get_content_type() == "text/html" and markup is None:
            markup = html.unescape(re.sub(r"<[^>]+>", " ", text))
    return (plain if plain is not None else markup or "").strip()


def read_mbox(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Mails of mbox files, split in parallel at their From lines; adds subject. MIME is decoded by the standard library."""
    raw = spark.read.option("lineSep", "\nFrom ").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mails = [email.message_from_string(x.partition("\n")[2]) for x in batch["value"]]
            yield pd.DataFrame({"timestamp": [m["Date"] for m in mails], "sender": [_header(m["From"]) for m in mails], "body": [_mail_body(m) for m in mails], "subject": [_header(m["Subject"]) for m in mails]})

    out = raw.mapInPandas(decode, "timestamp string, sender string, body string, subject string")
    return out.where("body != ''").select(timestamp(F.col("timestamp")).alias("timestamp"), "sender", "body", F.lit("mbox").alias("source"), "subject")


READERS = {"csv": read_csv, "json": read_json, "xml": read_sms_xml, "mbox": read_mbox}


def _any_case(kind: str) -> str:
    return "." + "".join(f"[{c}{c.upper()}]" for c in kind)


def find_exports(spark: SparkSession, folder: str) -> set[str]:
    """The kinds of files that a folder and all folders below it hold, by extension in any case. Spark lists them in parallel; nothing is read."""
    files = lambda k: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{_any_case(k)}").load(folder)
    return {k for k in READERS if not files(k).select("path").isEmpty()}


def unify(spark: SparkSession, folder: str) -> DataFrame:
    """All exports of a folder and the folders below it, each file by its extension, one row for each distinct body: the first by source and time."""
    kinds = find_exports(spark, folder)
    parts = [READERS[k](spark, folder, _any_case(k)).select(*UNIFIED) for k in READERS if k in kinds]
    if not parts:
        return spark.createDataFrame([], "timestamp string, sender string, body string, source string")
    return keep_first(reduce(DataFrame.unionByName, parts), ["body"], [F.col("source"), F.col("timestamp"), F.col("sender")])


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(text, filename): one document for each file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("filename"))


#: What ends a text in a file of many, and how it and the escape are written inside a text.
TEXT_END, TEXT_ESCAPES = "\x01", [("\x02", "\x02b"), ("\x01", "\x02a")]


def write_text_packs(df: DataFrame, text_col: str, path: str) -> None:
    """Whole texts, many to a file: a file for each text costs more than the text, and a folder of them more than any job."""
    value = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), TEXT_ESCAPES, F.coalesce(text_col, F.lit("")))
    df.select(value.alias("value")).write.option("lineSep", TEXT_END).text(path)


def read_text_packs(spark: SparkSession, path: str) -> DataFrame:
    """(text, filename): the texts of ``write_text_packs``, as they were; large files are read in splits."""
    packs = spark.read.text(path, lineSep=TEXT_END, recursiveFileLookup=True)
    text = reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(TEXT_ESCAPES), F.col("value"))
    return packs.select(text.alias("text"), F.col("_metadata.file_name").alias("filename"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("text"))


def sections(df: DataFrame, text_col: str, least: int = 50) -> DataFrame:
    """Parts between blank lines of more than ``least`` characters."""
    return df.select("*", F.posexplode(F.split(text_col, "\n\n")).alias("section_no", "section")).where(F.length(F.trim("section")) > least)


def term_lines(df: DataFrame, text_col: str) -> DataFrame:
    """Non-empty lines that don't start with #."""
    return df.select("*", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).where("trim(line) != '' AND trim(line) NOT LIKE '#%'")


#: Entities that pages use most.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(page: Column, least: int = 100, most: int = 10000) -> Column:
    """Text of a page: no scripts, styles or navigation (one that is never closed goes on to the end), trimmed lines, cut; null if too short."""
    out = page
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(out, r"<[^>]*>", "\n")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.substring(F.array_join(lines, "\n"), 1, most)
    return F.when(F.length(text) > least, text)


def corpus(parts: list[DataFrame], least_words: int = 10) -> DataFrame:
    """(text, source, word_count) of parts (text, source): cleaned, of at least so many words."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Made by generators, so that the filter on the words doesn't clean each text again.
    cleaned = once(out.select("source", "text"), {"text": clean_corpus(F.col("text"))})
    counted = once(cleaned, {"word_count": F.size(F.filter(F.split("text", " "), lambda w: w != ""))})
    return counted.select("text", "source", "word_count").where(F.col("word_count") >= least_words)


def write_training_jsonl(df: DataFrame, path: str) -> None:
    """{input, output} lines."""
    df.select(F.to_json(F.struct("input", "output")).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """An aggregate as JSON, one object a line: no row passes through another's task."""
    df.write.json(path)


LABELED = "raw_text string, date string, description string, debit string, credit string, balance string, bank string, page int, row_index int, labeled boolean, entities map<string,string>"


def read_labeled_rows(spark: SparkSession, path: str) -> DataFrame:
    """Statement rows of documents {rows: [...]} and of bare lists [...], with defaults for keys that are not there."""
    r = splittable.json_items(spark, path, ("rows",)).select(F.from_json("item", LABELED).alias("r")).select("r.*")
    defaults = {"raw_text": "", "bank": "unknown", "page": 0, "row_index": 0, "labeled": False}
    none = F.create_map().cast("map<string,string>")
    return r.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.coalesce(c, none).alias(c) if c == "entities" else F.col(c) for c in r.columns])


def write_corpus(df: DataFrame, path: str, plain: bool = False) -> None:
    """Corpus rows (text, source, ...) as JSON lines; ``plain``: the texts alone, a blank line after each."""
    if plain:
        df.select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
    else:
        df.select("text", "source", F.to_json(F.struct(*[c for c in df.columns if c not in ("text", "source", "word_count")])).alias("metadata"), F.size(F.split("text", " ")).alias("word_count")).write.json(path)


def write_routed(df: DataFrame, path: str) -> None:
    """keep, garbage and uncertain rows in one pass, a folder for each."""
    df.write.partitionBy("classification").option("header", True).option("escape", '"').csv(path)
