"""Legacy archive converter: ARC files in, equivalent WARC files out.

``parse_arc`` reads version 1 and version 2 ARC files (the version block names the
version and so the fields of each record line), cuts records by their declared lengths and
splits the HTTP header from the payload. The converter synthesises WARC records: a record id from the
record's file, number, url and date (so a task that runs again writes the same), the ARC
date as WARC-Date, a type (response, or revisit for a payload that an earlier
record has, with the id, url and date of that record), SHA-256 digests of block and payload. Each
file begins with a warcinfo record. ``parse_warc`` reads them back by
Content-Length, and the reader checks digests and what revisits refer to.

Archives are written by Spark's text writer (each row is a record, the
separator between rows is the format's own), so they go to any store that Spark
writes, and read by its binaryFile source. The number of files follows the bytes of the
pages; a page of any size is one record. A file is one gzip stream: Spark's writer compresses
files, not records.

Of equal payloads of at least ``MIN_REVISIT`` bytes the record with the least page id
is the response, the others revisit it. Only (digest, ids) rows are grouped,
with partial minima first; payloads are not.

Defined cases: null html is an empty payload; a null url is ``about:blank``, and
blanks and control characters in urls are percent-encoded; repeated pages of
the least id are responses all; rows with a null page id are responses and refer nowhere;
a header line that doesn't fit its version or a length beyond the file fails
with the place named; page ids may be of any type that a string can be cast to; rows that share an
id but not the payload are judged each by its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Payload in one file, on average; the least for which a shuffle partition more gets a file.
FILE_BYTES, SMALL_FILE_BYTES = 64 << 20, 1 << 20
MIN_REVISIT = 100
#: Fields of a record line, by version; fixed by the format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
_FIELD_NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


# --- ARC --------------------------------------------------------------------


def version_block(version: int, name: str) -> bytes:
    """The first record of a file, without the line end that follows it."""
    body = b"%d 0 txnweave\n%s\n" % (version, _FIELD_NAMES[version])
    head = f"filedesc://{name} 0.0.0.0 19700101000000 text/plain"
    head += f" {len(body)}" if version == 1 else f" 200 - - 0 {name} {len(body)}"
    return head.encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str) -> bytes:
    head = f"{quote(url, safe=_URL_SAFE)} 0.0.0.0 {date} text/html"
    head += f" {len(block)}" if version == 1 else f" 200 - - 0 {name} {len(block)}"
    return head.encode() + b"\n" + block


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~"


def parse_arc(raw: bytes) -> Iterator[dict]:
    """Records after the version block: url, ip, date, type and block."""
    pos, version = 0, None
    while pos < len(raw):
        if raw[pos : pos + 1] == b"\n":
            pos += 1
            continue
        end = raw.find(b"\n", pos)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {pos}")
        parts = raw[pos:end].rstrip(b"\r").split(b" ")
        if version is None:
            if not parts[0].startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(raw[end + 1 : raw.find(b"\n", end + 1)].split(b" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        names = ARC_FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields at byte {pos}, {len(names)} in version {version}")
        record = dict(zip(names, (x.decode("latin-1") for x in parts), strict=True))
        size = int(record["length"])
        block = raw[end + 1 : end + 1 + size]
        if size < 0 or len(block) < size:
            raise ValueError(f"the record at byte {pos} declares {size} bytes")
        pos = end + 1 + size
        if not record["url"].startswith("filedesc://"):
            yield record | {"block": block}


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields, header bytes, payload)."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    fields = {}
    for line in block[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    return fields, block[: end + 4], block[end + 4 :]


# --- WARC -------------------------------------------------------------------


def warc_date(date: str) -> str:
    """14 digits to ISO 8601; what is no date is the epoch."""
    if len(date) < 14 or not date[:14].isdigit():
        date = "19700101000000"
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(*parts: str) -> str:
    h = hashlib.sha256("\n".join(parts).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=5)}>"


def warc_info(seed: str) -> bytes:
    """The record that says what made the file."""
    body = b"software: txnweave\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', seed)}", f"WARC-Date: {warc_date('')}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body


def warc_record(record: dict, original: dict | None = None) -> bytes:
    """The WARC record of an ARC record (rid, url, date, block), without the two line ends that follow it.

    original: rid, url and date of the response that has the same payload; the record is then a revisit.
    """
    _, head, payload = split_http(record["block"])
    block = record["block"] if original is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record['rid']}",
        f"WARC-Date: {warc_date(record['date'])}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if original is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {original['rid']}",
            f"WARC-Refers-To-Target-URI: {original['url']}",
            f"WARC-Refers-To-Date: {warc_date(original['date'])}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    pos = 0
    while pos < len(raw):
        if raw[pos : pos + 2] == b"\r\n":
            pos += 2
            continue
        end = raw.find(b"\r\n\r\n", pos)
        if end < 0 or not raw.startswith(b"WARC/", pos):
            raise ValueError(f"no WARC record at byte {pos}")
        fields = {}
        for line in raw[pos:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if size < 0 or len(block) < size:
            raise ValueError(f"the record at byte {pos} declares {size} bytes")
        yield fields, block
        pos = end + 4 + size


# --- Spark ------------------------------------------------------------------


def _dealt(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, int]:
    """The pages over files of about FILE_BYTES, by their number in the table: no id or url is a file of its own. And the number of files."""
    size = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 500), F.lit(0)).alias("bytes")).first()["bytes"]
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SMALL_FILE_BYTES)
    n = max(1, few, -(-size // FILE_BYTES))
    return pages.withColumn("__row", F.monotonically_increasing_id()).repartition(n, F.xxhash64("__row")).drop("__row"), n


def _batches(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The records in batches of about a megabyte."""
    held, size = [], 0
    for x in records:
        held.append(x)
        size += len(x)
        if size > 1 << 20:
            yield pa.record_batch([pa.array(held, pa.binary())], names=["record"])
            held, size = [], 0
    yield pa.record_batch([pa.array(held, pa.binary())], names=["record"])


def _arc_rows(version: int, seed: str):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        name = f"{seed}-{version}-{TaskContext.get().partitionId():05d}.arc"
        yield version_block(version, name)
        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):
                payload = html.as_py() if html.is_valid else b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += f"X-Page-Id: {quote(page.as_py(), safe='')}\r\n" if page.is_valid else ""
                block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                yield arc_record(version, url.as_py() or "about:blank", "20240229120000", block, name)

    return lambda batches: _batches(records(batches))


def write_arc(spark: SparkSession, pages: DataFrame, out: str, version: int) -> None:
    """ARC files of one version. pages: page_id, url, html (string)."""
    given = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("binary"))
    records = _dealt(spark, given)[0].mapInArrow(_arc_rows(version, "pages"), "record binary")
    records.select(F.col("record").cast("string")).write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(out)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.txt.gz") -> DataFrame:
    """(path, content) of archive files; files hold a bounded number of bytes (or one record), and Spark bounds the bytes of a batch."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _unpack(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _page(block: bytes) -> str | None:
    page = split_http(block)[0].get("x-page-id")
    return None if page is None else unquote(page)


def _records(path: str, raw: bytes) -> Iterator[dict]:
    """The records of an ARC file with an id (rid) that no other record has: it holds the file's name and the record's number."""
    source = path.rpartition("/")[2]
    for number, record in enumerate(parse_arc(_unpack(raw))):
        yield record | {"rid": record_id(source, str(number), record["url"], record["date"])}


def _rows(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, names.values(), strict=True)], names=[*names])


def _arc_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"rid": pa.string(), "page": pa.string(), "url": pa.string(), "date": pa.string(), "digest": pa.binary(), "size": pa.int64()}
    for batch in batches:
        for path, raw in zip(*batch.columns, strict=True):
            rows = []
            for r in _records(path.as_py(), raw.as_py()):
                payload = split_http(r["block"])[2]
                rows.append((r["rid"], _page(r["block"]), r["url"], r["date"], hashlib.sha256(payload).digest(), len(payload)))
            yield _rows(rows, names)


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"rid": pa.string(), "url": pa.string(), "date": pa.string(), "block": pa.binary()}
    for batch in batches:
        for path, raw in zip(*batch.columns, strict=True):
            rows, size = [], 0
            for r in _records(path.as_py(), raw.as_py()):
                rows.append((r["rid"], r["url"], r["date"], r["block"]))
                size += len(r["block"])
                if size > 1 << 20:
                    yield _rows(rows, names)
                    rows, size = [], 0
            yield _rows(rows, names)


def _warc_rows(seed: str):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield warc_info(f"{seed} {TaskContext.get().partitionId()}")
        for batch in batches:
            for rid, url, date, block, *original in zip(*batch.columns, strict=True):
                first = dict(zip(("rid", "url", "date"), (x.as_py() for x in original), strict=True)) if original[0].is_valid else None
                yield warc_record({"rid": rid.as_py(), "url": url.as_py(), "date": date.as_py(), "block": block.as_py()}, first)

    return lambda batches: _batches(records(batches))


def convert_arc(spark: SparkSession, arc: str, warc: str, files: int, id_type: str = "long") -> None:
    """Write the WARC equivalents of the ARC files in a folder, as ``files`` files."""
    digests = read_archives(spark, arc).mapInArrow(_arc_digests, "rid string, page string, url string, date string, digest binary, size long")
    digests = digests.where((F.col("size") >= MIN_REVISIT) & F.col("page").isNotNull()).withColumn("page", F.col("page").cast(id_type))
    digests = materialize(spark, digests, "arc-digests")
    first = digests.groupBy("digest").agg(F.min(F.struct("page", "rid", "url", "date")).alias("first"), F.count("*").alias("m")).where("m > 1").select("digest", "first")
    again = digests.select("rid", "page", "digest").join(first, "digest").where(F.col("page") != F.col("first.page"))
    again = materialize(spark, again.select("rid", F.col("first.rid").alias("to_rid"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date")), "revisits")
    records = read_archives(spark, arc).mapInArrow(_arc_records, "rid string, url string, date string, block binary")
    # Records are dealt once, by their own ids; the join keeps that.
    dealt = records.repartition(files, "rid").join(again, "rid", "left")
    out = dealt.select("rid", "url", "date", "block", "to_rid", "to_url", "to_date").mapInArrow(_warc_rows(warc), "record binary")
    out.select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc)


def _warc_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"rid": pa.string(), "page": pa.string(), "size": pa.int64(), "digest": pa.string(), "kind": pa.string(), "to_rid": pa.string()}
    for batch in batches:
        for raw in batch.column(1):
            rows = []
            for fields, block in parse_warc(_unpack(raw.as_py())):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                payload = split_http(block)[2]
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                    raise ValueError(f"the block of {fields['warc-record-id']} has another digest")
                if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
                rows.append((fields["warc-record-id"], _page(block), len(payload), digest, fields["warc-type"], fields.get("warc-refers-to")))
            yield _rows(rows, names)


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record.

    Block and payload digests are checked against the bytes; a revisit has the payload of the
    response that it refers to, which must be there and have the revisit's digest.
    """
    index = read_archives(spark, path).mapInArrow(_warc_index, "rid string, page string, size long, digest string, kind string, to_rid string")
    index = materialize(spark, index.withColumn("page", F.col("page").cast(id_type)), "warc-index")
    responses = index.where("kind = 'response'")
    wanted = responses.where(F.col("size") >= MIN_REVISIT).select(F.col("rid").alias("__rid"), F.col("page").alias("__page"), F.col("size").alias("__size"), F.col("digest").alias("__digest"))
    revisits = index.where("kind = 'revisit'").join(wanted, F.col("to_rid") == F.col("__rid"), "left")
    same = F.coalesce(F.col("digest") == F.col("__digest"), F.lit(False))
    checked = F.when(same, F.col("__size")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of the revisit "), F.col("rid"))).cast("long"))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    none = F.lit(None).cast(index.schema["page"].dataType)
    whole = responses.select("page", "size", "digest", "kind", none.alias("to")).toDF(*names)
    return whole.unionByName(revisits.select("page", checked.alias("size"), "digest", "kind", "__page").toDF(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files (half in version 1, half in version 2, by a digest of the id), converted to WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    odd = F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(2)) == 1, F.lit(False))
    write_arc(spark, pages.where(~odd), arc, 1)
    write_arc(spark, pages.where(odd), arc, 2)
    kind = pages.schema["page_id"].dataType.simpleString()
    convert_arc(spark, arc, warc, _dealt(spark, pages)[1], kind)
    return read_warc(spark, warc, kind)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), r AS (
  SELECT *, coalesce(payload_bytes >= {MIN_REVISIT} AND page_id <> first, false) AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""
