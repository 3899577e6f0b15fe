"""Web archives: writing captures as WARC records, and assembling transactions when reading them back.

Writing: each page becomes a request, a response or revisit, and a metadata record. The request and the metadata point
at the response or revisit through ``WARC-Concurrent-To``. Of pages with equal payloads of at least ``min_bytes``
bytes, the one with the largest page id (then the largest url) is the response; the others are revisits whose
``WARC-Refers-To`` names its record, and carry no payload. The records go out through Spark's text writer with the
WARC terminator as its line separator, gzipped, ``records_per_file`` at most in a file.

Reading: files are parsed by content length, not by separators, so a payload may hold any bytes. Each response or
revisit is then joined with its request and metadata through the concurrent-to identifiers, and a revisit with the
capture it refers to; the result is one nested row per capture. Joins on a payload or on a response, which may be
shared by a third of all pages, are dealt over ``SALTS`` parts of each key.

Null html is an empty payload. Null page ids and urls are kept as null; pages of one payload whose ids are all null
are all responses. Exactly repeated rows that hold the largest id are all responses, so no row is lost. A capture
without request or metadata has null there. An empty table gives an empty archive and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 8
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
BATCH = 500

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "digest string, payload_bytes bigint, page_id string, payload binary")


def payload_digest(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32, from whole-stage functions: forty bits are eight digits of base 32."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _salted(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join on ``key`` where one key may hold most of ``left``; ``right`` has one row for each key."""
    dealt = left.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def _record(kind: str | Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text without its terminator; header lines whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
           min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_type, first_id, first_url (of the response referred to)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        payload_digest(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    first = keyed.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("first"))
    joined = _salted(keyed, first, "digest", F.xxhash64("page_id", "url"))
    own = F.struct("page_id", "url").eqNullSafe(F.col("first"))
    revisit = F.col("first").isNotNull() & ~own & (F.col("payload_bytes") >= min_bytes)
    return joined.select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("first_id"), F.when(revisit, F.col("first.url")).alias("first_url"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 0, records_per_file: int = 3000) -> None:
    """Write every page to gzipped WARC files below ``path``."""
    rows = decide(pages, page_id, url, html, min_bytes)
    revisit = F.col("record_type") == "revisit"
    own = _urn(F.col("digest"), F.col("page_id"), F.col("url"), F.lit("capture"))
    # Blanks and control characters would break header lines: there each stands as %20, and the metadata hold the url itself.
    unfit = "[\\x00-\\x20\\x7F]"
    target = F.coalesce(F.regexp_replace("url", unfit, "%20"), F.lit("about:blank"))
    host = F.coalesce(F.try_parse_url(target, F.lit("HOST")), F.lit("-"))
    common = [("WARC-Target-URI", target), ("WARC-Date", F.lit(DATE))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    request = _record("request", [
        ("WARC-Record-ID", _urn(own, F.lit("request"))), ("WARC-Concurrent-To", own), *common,
        ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    capture = _record(F.col("record_type"), [
        ("WARC-Record-ID", own),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("digest"), F.col("first_id"), F.col("first_url"),
                                                F.lit("capture")))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))))
    fields = F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"),
                      F.coalesce(F.concat(F.lit("\r\npage-id: "), F.col("page_id").cast("string")), F.lit("")),
                      F.when(F.col("url").isNull(), F.lit("\r\nno-url: 1")).when(F.col("url").rlike(unfit) | (F.col("url") == ""), F.concat(
                          F.lit("\r\nurl-base64: "), F.base64(F.col("url").cast("binary")))).otherwise(F.lit("")))
    metadata = _record("metadata", [
        ("WARC-Record-ID", _urn(own, F.lit("metadata"))), ("WARC-Concurrent-To", own), *common,
        ("Content-Type", F.lit("application/warc-fields"))], fields)
    rows.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case, ``type`` line included) and block of each record of a file."""
    if content[:2] == b"\x1f\x8b":
        members, rest = [], content
        while rest:
            part = zlib.decompressobj(31)
            members.append(part.decompress(rest) + part.flush())
            rest = part.unused_data
        content = b"".join(members)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].split(b"\r\n")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields[b"content-length"])
        yield fields, content[stop + 4:stop + 4 + length]
        at = stop + 4 + length


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; digest and size of a response come from its own payload."""
    def text(value: bytes | None) -> str | None:
        return None if value is None else value.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()),
                            ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                            ("digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.string()),
                            ("payload", pa.binary())])
        rows: list[dict] = []
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse(content.as_py()):
                    kind = text(fields[b"warc-type"])
                    row = {"record_id": text(fields[b"warc-record-id"]), "type": kind,
                           "concurrent_to": text(fields.get(b"warc-concurrent-to")),
                           "refers_to": text(fields.get(b"warc-refers-to")),
                           "target_uri": text(fields.get(b"warc-target-uri")), "date": text(fields.get(b"warc-date")),
                           "digest": (text(fields.get(b"warc-payload-digest")) or "").removeprefix("sha1:") or None}
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        row["payload_bytes"] = len(payload)
                        row["digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        row["payload"] = payload if with_payload else None
                    elif kind == "metadata":
                        said = dict(line.partition(b": ")[::2] for line in block.split(b"\r\n"))
                        row["payload_bytes"] = int(said[b"payload-bytes"]) if b"payload-bytes" in said else None
                        row["page_id"] = text(said.get(b"page-id"))
                        if b"no-url" in said:
                            row["target_uri"] = None
                        if b"url-base64" in said:
                            row["target_uri"] = text(base64.b64decode(said[b"url-base64"]))
                    elif kind == "request" and with_payload:
                        row["payload"] = block
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response or revisit), its ``request`` and ``metadata``, and
    ``original``, the metadata of the capture that a revisit refers to."""
    def side(kind: str) -> DataFrame:
        fields = [F.col(c) for c in records.columns if c != "concurrent_to"]
        return records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(
            F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(*fields)).alias(kind))
    captures = records.filter(F.col("type").isin("response", "revisit"))
    nested = captures.select("record_id", "refers_to", F.struct(*captures.columns).alias("capture"))
    nested = nested.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    whence = side("metadata").select(F.col("record_id").alias("refers_to"), F.col("metadata").alias("original"))
    return _salted(nested, whence, "refers_to", F.xxhash64("record_id")).select(
        "capture", "request", "metadata", "original")


def captures(spark: SparkSession, path: str, page_type: T.DataType | str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each capture in the archives."""
    nested = assemble(read_records(spark, path, with_payload=False))
    return nested.select(
        F.col("metadata.page_id").cast(page_type).alias("page_id"), F.col("metadata.target_uri").alias("url"),
        F.coalesce("capture.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"), F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", F.col("original.page_id")).cast(page_type).alias("refers_to"))


def archive_folder(shared: str) -> str:
    """A new folder for archives below the shared one."""
    return f"{shared.rstrip('/')}/warc-{uuid.uuid4().hex}"
