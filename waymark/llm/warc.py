"""WARC: write captures as archives, read archives back as records, and assemble the records of each transaction.

Writing is DataFrame expressions and Spark's text writer (one record a row, gzip, files of a bounded number of records in any
folder Spark can write). Reading frames records by Content-Length from `binaryFile`, archive by archive, in bounded batches.
Assembly joins request and metadata records to the response or revisit whose id their WARC-Concurrent-To names and emits one
nested row per capture.

Null payloads are empty, null urls become urn:page:<id>; pages of null id are responses and read back with a null id. Of pages
that repeat the smallest id of a payload each is a response. An empty table writes no records and reads back as no rows. Further
requests or metadata records of one capture are counted, the one with the least record id is kept. Records whose concurrent-to
names no capture in the archives belong to no transaction and are left out. What a revisit refers to is resolved by its
WARC-Refers-To among the captures of the archives. Very long payloads are written and read whole, up to the 2 GB that a row can
hold; other columns of the pages don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, remove_shared, shared_path, shared_table

#: RFC 4648 digits against those of conv(…, 32), and the identical-payload profile of the standard.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 12_000
BROADCAST_ROWS = 500_000
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

RECORD_SCHEMA = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), DIGITS32, BASE32)


def urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: Column, headers: list[Column], block: Column) -> Column:
    """A record without its last line break, which the text writer adds."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, *headers, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def header(name: str, value: Column) -> Column:
    """Nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to: the smallest page_id of equal payloads, null for that page itself."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    firsts = p.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # only digests that repeat are joined: where they are few they are broadcast and no payload moves, else AQE splits a hot digest
    p = join_sized(p, shared_table(firsts.where("n > 1").drop("n"), "repeats"), "payload_digest", "left", BROADCAST_ROWS)
    repeats = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("first_id"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(repeats, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Three records a page: request, response or revisit, metadata."""
    p = decided(pages, least_bytes)
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), "[\\x00-\\x20]", "%20")
    p = p.withColumn("_uri", clean)
    common = [header("WARC-Target-URI", F.col("_uri")), header("WARC-Date", F.lit(date))]
    capture, again = urn("capture", F.col("page_id")), F.col("refers_to").isNotNull()
    host = F.regexp_extract("_uri", "://([^/?#]*)", 1)
    target = F.regexp_extract("_uri", "://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.col("payload")))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    request = record(F.lit("request"), [*common, header("WARC-Record-ID", urn("request", F.col("page_id"))), header("WARC-Concurrent-To", capture), header("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    response = record(
        F.when(again, "revisit").otherwise("response"),
        [*common, header("WARC-Record-ID", capture), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), header("WARC-Refers-To", F.when(again, urn("capture", F.col("refers_to")))), header("WARC-Profile", F.when(again, PROFILE)), header("Content-Type", F.lit("application/http;msgtype=response"))],
        answer,
    )
    metadata = record(F.lit("metadata"), [*common, header("WARC-Record-ID", urn("metadata", F.col("page_id"))), header("WARC-Concurrent-To", capture), header("Content-Type", F.lit("application/warc-fields"))], about)
    rows = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Inflated:
    """Reads bytes of an archive in memory, gzip members one after another or plain, a piece at a time."""

    def __init__(self, content: memoryview, piece: int = 1 << 20):
        self.content, self.piece, self.at, self.buffer = content, piece, 0, bytearray()
        self.gzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.content):
            return False
        got = bytes(self.content[self.at : self.at + self.piece])
        self.at += len(got)
        while got and self.gzip is not None:
            self.buffer += self.gzip.decompress(got)
            got = self.gzip.unused_data
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
        if self.gzip is None:
            self.buffer += got
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes:
        """Up to and with an empty line; empty at the end."""
        start = 0
        while (found := self.buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 3)
            if not self.more():
                return b""
        return self.take(found + 4)


def fields_of(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed(content: memoryview, keep_payload: bool) -> Iterator[tuple]:
    source = Inflated(content)
    while head := source.head():
        h = fields_of(head.lstrip(b"\r\n").partition(b"\r\n")[2])
        block = source.take(int(h.get("content-length", 0)))
        source.take(4)
        kind, digest, size, text, payload = h.get("warc-type"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, None, None, None
        if "application/http" in h.get("content-type", ""):
            http, _, payload = block.partition(b"\r\n\r\n")
            if kind == "revisit":
                said = fields_of(http.partition(b"\r\n")[2]).get("content-length", "")
                size, payload = int(said) if said.isdigit() else None, None
            else:
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "metadata":
            text = block.decode("utf-8", "replace")
        else:
            payload, size = block, len(block)
        yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, text, payload if keep_payload else None


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All records of the archives below a path. An archive is one row of `binaryFile`, so keep archives under 2 GB."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for content in batch.column(0):
                for row in parsed(memoryview(content.as_buffer()).cast("B"), keep_payload):
                    rows.append(row)
                    held += len(row[9] or b"") + len(row[8] or "")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """capture_id, response struct, request struct, metadata struct, n_requests, n_metadata: one row per response or revisit."""
    inner = F.struct(*[c for c in records.columns if c not in ("concurrent_to",)])
    captures = records.where(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), inner.alias("response"))

    def side(kind: str, count: str) -> DataFrame:
        return records.where((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(inner, "record_id").alias(kind), F.count("*").alias(count))

    return captures.join(side("request", "n_requests"), "capture_id", "left").join(side("metadata", "n_metadata"), "capture_id", "left")


def captures(records: DataFrame) -> DataFrame:
    """capture_id, page_id, payload_bytes, payload_digest, record_type, refers_to, n_requests, n_metadata: one row a transaction, the
    page ids as its metadata say, what a revisit refers to as the page id of the capture that WARC-Refers-To names."""
    said = F.regexp_extract("metadata.fields", "(?:^|\\n)page-id: (-?[0-9]+)", 1)
    t = transactions(records).select("capture_id", F.when(said != "", said.cast("long")).alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("to_id"), "n_requests", "n_metadata")
    t = shared_table(t, "captures")
    named = t.where("record_type = 'response'").select(F.col("capture_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    wanted = t.where("to_id is not null").select("to_id").distinct()
    known = named.join(wanted, "to_id", "left_semi").groupBy("to_id").agg(F.min("refers_to").alias("refers_to"))
    return join_sized(t, known, "to_id", "left", BROADCAST_ROWS).select("capture_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("n_requests", F.lit(0)).cast("long").alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).cast("long").alias("n_metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = shared_table(captures(read_records(spark, path, keep_payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_requests", "n_metadata"), "warc-pages")
    remove_shared(spark, path)  # what was asked for has been read back
    return found
