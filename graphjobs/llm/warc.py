"""WARC archives with revisit records for payloads that are already there.

Headers (id, digest, length) are shuffled by payload digest; of equal payloads of at least ``least`` bytes the one with the
largest id is written as a response, the others as revisits without payload that refer to its record. What that finds is a
small table, broadcast while Spark's own limit allows and else joined by digest. Each task then writes archives: a warcinfo
record, then a record for each page, each a gzip member of its own, with headers made afresh (record ids, date, digests,
lengths). An archive is closed once it holds ``archive_bytes`` of compressed records, so a task holds about that much and one
page. Reading gives back each record, checks payloads against digests, and joins revisits to responses by record id.

Record ids are drawn from the run, the page id and the digest, so the record that a revisit refers to is known before it is
written, and a task that runs again writes the same archive. The page id is kept in a header of its own, Page-ID.

Defined cases: a null html is an empty payload. A null url is an empty one; in others each space and control character is
percent-encoded and the rest stays as it is. Of rows that share the largest id and the payload all are responses, under one
record id. A null id is written as such and read back as null. Other columns of pages aren't archived. No pages give no
records. Spark names the files (part-…), each one archive with a zero byte of padding behind it. One archive, and so one
page, must stay below two gigabytes, the limit of a value in Spark.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, new_folder, small_batches, stage

#: Payloads shorter than this are always written.
LEAST = 1000
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: How hard gzip tries; above this it takes much more time for a little less space.
LEVEL = 3
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(r"[\x00-\x20\x7f]")


def _own(pages: DataFrame) -> DataFrame:
    page_id, url, html = columns(pages, "page_id", "url", "html")
    own = pages.select(page_id.cast("long").alias("page_id"), F.coalesce(url.cast("string"), F.lit("")).alias("url"), F.coalesce(html.cast("string"), F.lit("")).alias("html"))
    return own.withColumn("digest", F.sha1(F.col("html").cast("binary")))


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, n, refers_to) of payloads that several pages have: how many, and the page that keeps it."""
    heads = _own(pages).select("page_id", "digest", F.octet_length("html").alias("size"))
    groups = heads.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
    return groups.where("n > 1 and refers_to is not null")


def _record_id(run: uuid.UUID, page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(run, f'{page_id}:{digest}').urn}>"


def _record(kind: str, record_id: str, date: str, body: bytes, content_type: str, *more: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", *more]
    head += [f"Content-Type: {content_type}", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + _END + body + _END, LEVEL, mtime=0)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each page into archives below path."""
    small_batches(pages.sparkSession)
    run, date = uuid.uuid4(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    twice = stage(resolve(pages, least), "repeated")
    met = _own(pages).join(twice.select("digest", "refers_to"), "digest", "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches):
        from pyspark import TaskContext

        info = _record("warcinfo", f"<{uuid.uuid5(run, f'info {TaskContext.get().partitionId()}').urn}>", date, b"format: WARC File Format 1.1\r\n", "application/warc-fields")
        held, size = [], 0
        for b in batches:
            for page_id, url, html, digest, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = to is not None and page_id != to
                uri = _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url)
                more = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {'' if page_id is None else page_id}"]
                if revisit:
                    more += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(run, to, digest)}"]
                body = _HTTP if revisit else _HTTP + html.encode()
                held.append(_record("revisit" if revisit else "response", _record_id(run, page_id, digest), date, body, "application/http; msgtype=response", *more))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join((info, *held))], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join((info, *held))], pa.binary())], ["value"])

    # the text sink writes bytes as they are; gzip readers pass over zeros behind a member
    archives = met.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def _parsed(data: bytes):
    """(record id, page, type, target, digest, refers to, payload length) of each response and revisit, read one at a time."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        head = {}
        while (line := file.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        body = file.read(int(head["Content-Length"]))
        if file.read(4) != _END:
            raise ValueError(f"{head['WARC-Record-ID']}: the record doesn't end where it says")
        kind = head["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), body[body.index(_END) + 4 :]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
        page = int(head["Page-ID"]) if head["Page-ID"] else None
        yield head["WARC-Record-ID"], page, kind, head["WARC-Target-URI"], digest, head.get("WARC-Refers-To"), len(payload) if kind == "response" else None


def read_archives(spark, path: str) -> DataFrame:
    """(record_id, page_id, record_type, url, payload_digest, refers_to, payload_bytes); refers_to is a record id, and a
    revisit's length is null."""
    names = ["record_id", "page_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes"]
    small_batches(spark)  # bounds a batch to one archive or a few small ones

    def run(pdfs):
        for pdf in pdfs:
            for data in pdf["content"]:
                if len(data.rstrip(b"\x00")):
                    out = pd.DataFrame(_parsed(data), columns=names)
                    for n in ("page_id", "payload_bytes"):
                        out[n] = out[n].astype("Int64")
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, "record_id string, page_id long, record_type string, url string, payload_digest string, refers_to string, payload_bytes long")


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the archives, read them back and give revisits page and length of the response that they refer to."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, least)
    rows = stage(read_archives(spark, path), "records")
    held = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("r")).agg(F.max("page_id").alias("to"), F.max("payload_bytes").alias("held"))
    met = rows.join(held, rows.refers_to == held.r, "left")
    return met.select("page_id", F.coalesce("payload_bytes", "held").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"))


ORACLE_SQL = f"""
WITH heads AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS most FROM heads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id < most THEN most END AS refers_to
FROM kept"""
