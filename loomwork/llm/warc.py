"""WARC archives: write them with Spark's own text writer, then read them index first.

A record is one row of the text writer, whose line separator is the ``\\r\\n\\r\\n`` that ends a WARC
record; Spark's commit protocol and any of its file systems therefore hold for the archives.
A ``response`` carries the HTML; a ``revisit`` carries only the HTTP header and points to the response
of the same payload. Every record has the fields that WARC 1.1 requires. Reading first writes an index (archive,
offset, length, URL, digest, kind per record): archives are read in large ranges in which record headers are
walked, and payloads beyond a range are skipped. Then selected records are read in coalesced ranges sorted by offset.

Of rows with equal payloads of at least ``min_payload`` bytes the one with the smallest id is the response.
Defined results: a null payload counts as empty; a null URL has no header line; rows that repeat
the smallest id with the same payload are responses each, under one record id; a null id is larger than any other and
revisits, or is a response where the payload has no other id, and its record id is a random-looking UUID; a very long
payload is one record; other columns of any name are left out; an empty table gives no records.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, fresh_path, saved, ship

END = "\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, header_bytes bigint, kind string, record_id string, url string, digest string, refers_to string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest_ok boolean"
#: The profile of revisits that have the payload of another record, a fixed value of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_RANGE = 8 << 20
GAP = 64 << 10
RANGE = 4 << 20


def with_kinds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_payload: int = 100, broadcast_rows: int = 200_000) -> DataFrame:
    """Columns page_id, url, payload, digest, refers_to (null for responses).

    Only ids and digests are shuffled. The revisits found are written and counted: up to
    ``broadcast_rows`` of them are broadcast, more are joined by shuffling, so that payloads move
    only where there is no other way."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    keys = base.filter(F.octet_length("payload") >= min_payload).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = keys.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    revisits = saved(revisits, "revisits")
    if revisits.count() <= broadcast_rows:
        revisits = F.broadcast(revisits)
    return base.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").drop("of", "of_digest")


def record(kinds: DataFrame, date: str) -> DataFrame:
    """One string column: the records without their end, all of one ``date`` (as ``2025-01-31T12:00:00Z``)."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    # control characters and percent signs of a URL are escaped, as header lines can't hold them
    url = F.regexp_replace(F.col("url"), "%", "%25")
    for c, code in (("\r", "%0D"), ("\n", "%0A"), ("\x00", "%00")):
        url = F.replace(url, F.lit(c), F.lit(code))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    some = F.md5(F.concat_ws(" ", "url", "digest", F.monotonically_increasing_id().cast("string")))
    uuid = F.regexp_replace(some, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    own = F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))).otherwise(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", own),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", url),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return kinds.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, *, records_per_archive: int = 50_000, date: str | None = None, **columns) -> None:
    """Write the archives ``path/part-*``, of ``records_per_archive`` records at most, dated ``date`` or now."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    record(with_kinds(pages, **columns), date).write.option("lineSep", END).option("maxRecordsPerFile", records_per_archive).text(path)


def _field(head: str, name: str) -> str | None:
    m = re.search(rf"^{name}: (.*?)\r$", head, re.MULTILINE)
    return m[1] if m else None


def _plain_url(url: str | None) -> str | None:
    if url is None:
        return None
    for c, code in (("\r", "%0D"), ("\n", "%0A"), ("\x00", "%00"), ("%", "%25")):
        url = url.replace(code, c)
    return url


def _urn(text: str | None) -> str | None:
    return text[len("<urn:page:") : -1] if text and text.startswith("<urn:page:") else None


class _Ranges:
    """A file read in ranges of ``size`` bytes that begin where something outside the last one is asked for."""

    def __init__(self, f, end: int, size: int) -> None:
        self.f, self.end, self.size, self.start, self.held = f, end, size, 0, b""

    def head(self, at: int) -> bytes:
        """The bytes from ``at`` to the next empty line."""
        want = self.size
        while True:
            if self.start <= at < self.start + len(self.held) and (cut := self.held.find(b"\r\n\r\n", at - self.start)) >= 0:
                return self.held[at - self.start : cut]
            self.start, self.held = at, self.f.read_at(min(want, self.end - at), at)
            if len(self.held) == self.end - at and self.held.find(b"\r\n\r\n") < 0:
                raise ValueError(f"no record header at {at}")
            want *= 2  # a header longer than a range


def index(spark, path: str, *, range_bytes: int = INDEX_RANGE) -> DataFrame:
    """The index of the archives under ``path``: one row per record, from headers alone, a task per archive."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    files = [(s.getPath().toString(), s.getLen()) for s in listed if s.getPath().getName().startswith("part-") and s.getLen()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(archive.replace("file:///", "/").replace("file:/", "/"))
                rows, at = [], 0
                with system.open_input_file(name) as f:
                    ranges = _Ranges(f, size, range_bytes)
                    while at < size:
                        raw = ranges.head(at)
                        head = raw.decode("utf-8") + "\r\n"
                        length = len(raw) + 4 + int(_field(head, "Content-Length"))
                        rows.append((archive, at, length, len(raw) + 4, _field(head, "WARC-Type"), _urn(_field(head, "WARC-Record-ID")), _plain_url(_field(head, "WARC-Target-URI")), _field(head, "WARC-Payload-Digest").removeprefix("sha256:"), _urn(_field(head, "WARC-Refers-To"))))
                        at += length + len(END)
                        if len(rows) >= 5000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    if not files:
        return spark.createDataFrame([], INDEX)
    names = spark.createDataFrame(files, "archive string, size bigint").repartitionByRange(len(files), "archive")
    return names.mapInArrow(batches_of(scan), INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read(selected: DataFrame) -> DataFrame:
    """Read the selected rows of an index: neighbours up to GAP apart are fetched in one range of
    at most about RANGE bytes, and each record's payload is checked against its digest.

    A revisit's payload is its response's; its size is in the HTTP header that it repeats."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            i = 0
            while i < len(rows):
                j, stop = i + 1, rows[i][1] + rows[i][2]
                while j < len(rows) and rows[j][0] == rows[i][0] and 0 <= rows[j][1] - stop <= GAP and rows[j][1] + rows[j][2] - rows[i][1] <= RANGE:
                    stop = rows[j][1] + rows[j][2]
                    j += 1
                if rows[i][0] != last:
                    if f is not None:
                        f.close()
                    last = rows[i][0]
                    system, name = fs.FileSystem.from_uri(last.replace("file:///", "/").replace("file:/", "/"))
                    f = system.open_input_file(name)
                data = memoryview(f.read_at(stop - rows[i][1], rows[i][1]))
                out = []
                for _, offset, length, head, kind, record_id, url, digest, refers_to in rows[i:j]:
                    block = bytes(data[offset - rows[i][1] + head : offset - rows[i][1] + length])
                    cut = block.index(b"\r\n\r\n")
                    size = int(_field(block[: cut + 2].decode("utf-8"), "Content-Length"))
                    if kind == "response":
                        body = block[cut + 4 :]
                        real = hashlib.sha256(body).hexdigest()
                        out.append((None if record_id is None else int(record_id), url, len(body), real, kind, None, real == digest and len(body) == size))
                    else:
                        out.append((None if record_id is None else int(record_id), url, size, digest, kind, int(refers_to), True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in RECORD.split(", ")])
                i = j
        if f is not None:
            f.close()

    spread = selected.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(batches_of(fetch), RECORD)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, index them, and read every record back."""
    spark = pages.sparkSession
    ship(spark)
    path = fresh_path(spark, "warc")
    write(pages, path, **columns)
    return read(saved(index(spark, path), "warc-index"))
