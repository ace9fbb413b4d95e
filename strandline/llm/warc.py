"""WARC archives whose repeated payloads are revisit records.

Only headers are shuffled by payload digest. The record with the largest id of a
payload stays a response, the others become revisits that name it, and archives are
written with fresh headers by Spark's own writer. Reading takes records by their
content length, whatever the payload holds, and joins revisits to their originals.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import BATCH_BYTES, fresh, python_tasks
from strandline.operators.joins import attach_group_facts
from strandline.session import new_path, staged

# Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LINE = "\r\n"

#: Records and bytes (before compression) of one archive file at most, as one task reads it; a longer record has its own.
RECORDS_PER_FILE, BYTES_PER_FILE = 4000, 64 << 20
#: Records are written by class of size, each of records this many times as long as the one before.
SIZE_STEP = 8
#: Bytes of a record besides payload, urls and page ids, at most, and bytes that are read at once.
HEADER_BYTES, PIECE = 1200, 1 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a text or binary column in upper-case base 32, without padding."""
    hexed = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), DIGITS32, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line; none for a null value. Line ends in a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def headers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_url``, without payloads.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    largest ``page_id`` is a response and the others revisits; smaller payloads are
    all responses. Rows that share the largest id are all responses; a null id is
    below any other, and rows of a payload that has no other id are all responses.
    A payload that a third of all pages share is combined map-side, and only its
    headers are spread over tasks.
    """
    heads = staged(pages.select("page_id", "url", F.octet_length(_payload()).cast("long").alias("payload_bytes"),
                                base32_sha1(_payload()).alias("payload_digest")), "headers")
    originals = staged(heads.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("original"),
        F.max_by("url", "page_id").alias("original_url")), "originals")
    facts = attach_group_facts(heads, originals, ["payload_digest"], ["page_id"], "copies")
    revisit = ((F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull()
               & ~F.col("page_id").eqNullSafe(F.col("original")))
    return facts.select("page_id", "url", "payload_bytes", "payload_digest",
                        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                        F.when(revisit, F.col("original")).alias("refers_to"),
                        F.when(revisit, F.col("original_url")).alias("refers_url"))


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _record(payload: Column | None, captured: str) -> Column:
    """The text of one record, up to the line end that the writer adds."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(LINE * 2))
    block = F.concat(http, payload) if payload is not None else http
    original = payload is None
    lines = [
        _header("WARC-Type", F.lit("revisit" if original else "response")),
        _header("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"))),
        _header("WARC-Date", F.lit(captured)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Page-Id", F.col("page_id")),
    ]
    if original:
        lines += [
            _header("WARC-Profile", F.lit(REVISIT_PROFILE)),
            _header("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"))),
            _header("WARC-Refers-To-Target-URI", F.col("refers_url")),
            _header("WARC-Refers-To-Date", F.lit(captured)),
            _header("X-Refers-To-Page-Id", F.col("refers_to")),
        ]
    lines += [_header("Content-Type", F.lit("application/http; msgtype=response")),
              _header("Content-Length", F.octet_length(block))]
    return F.concat(F.lit(VERSION + LINE), *lines, F.lit(LINE), block, F.lit(LINE))


def _size_class(limits: list[tuple[int, int]], payload: Column | None, *others: str) -> Column:
    """The class of size of a record: the first whose records may be as long, or ``len(limits)``."""
    length = F.lit(HEADER_BYTES).cast("long")
    if payload is not None:
        length += payload
    for name in others:
        length += F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    found = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        found = F.when(length <= limits[i][1], i).otherwise(found)
    return found


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, captured: str = "2024-01-01T00:00:00Z",
                   records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip",
                   bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write ``pages`` (``page_id, url, html``) as archives with repeated payloads as revisits.

    A page is a response unless its id and digest are among the revisits. Html is shuffled
    by that pair once, to leave out the revisits (never by digest alone, so copies of a
    page do not meet), and only responses carry it into the archives.
    Records go to files by class of size, the longer the fewer to a file, so that a file
    has at most ``bytes_per_file`` bytes or a single record.
    """
    limits, records = [], records_per_file  # records of a file, and bytes of a record, at most
    while records > 1:
        limits.append((records, bytes_per_file // records))
        records //= SIZE_STEP
    marked = headers(pages, min_bytes)
    as_response = _size_class(limits, F.col("payload_bytes"), "url", "page_id", "page_id")
    as_revisit = _size_class(limits, None, "url", "refers_url", "page_id", "refers_to")
    planned = staged(marked.withColumns({"as_response": as_response, "as_revisit": as_revisit}), "planned")
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("as_revisit")).otherwise(F.col("as_response"))
    used = sorted(r["size"] for r in planned.select(size.alias("size")).distinct().collect())
    on = (F.col("w.page_id").eqNullSafe(F.col("g.page_id"))) & (F.col("w.payload_digest") == F.col("g.payload_digest"))
    for n, i in enumerate(used or [0]):
        written = (pages.select("page_id", "url", "html").withColumn("payload_bytes", F.octet_length(_payload()).cast("long"))
                   .where(as_response == i).withColumn("payload_digest", base32_sha1(_payload())))
        gone = planned.where(revisit & (F.col("as_response") == i)).select("page_id", "payload_digest").distinct()
        responses = written.alias("w").join(gone.alias("g"), on, "left_anti")
        records = responses.select(_record(_payload(), captured).alias("value")).unionAll(
            planned.where(revisit & (F.col("as_revisit") == i)).select(_record(None, captured).alias("value")))
        (records.write.mode("append" if n else "errorifexists").option("lineSep", LINE)
         .option("maxRecordsPerFile", limits[i][0] if i < len(limits) else 1)
         .option("compression", compression).text(path))


_RECORD = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to_record", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("sound", T.BooleanType())])


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def parse_archive(content: bytes, payloads: bool = True):
    """The headers of each record of an archive, compressed or not, and size, SHA-1 and (if asked for) bytes of its payload.

    The archive is read as a stream, and payloads in pieces; a truncated record ends it.
    """
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while True:
        lines = []
        while (line := stream.readline()) != LINE.encode() or not lines:
            if not line:
                return
            if line != LINE.encode():
                lines.append(line)
        fields = _fields(b"".join(lines)[:-len(LINE)])
        size = int(fields.get("content-length", "0"))
        head = b"" if fields.get("content-type", "").startswith("application/http") else None
        read = length = 0
        sha, kept = hashlib.sha1(), []
        while read < size and (piece := stream.read(min(size - read, PIECE))):
            read += len(piece)
            if head is not None:
                head += piece
                _, end, piece = head.partition(b"\r\n\r\n")
                head = None if end else head[-3:]
            sha.update(piece)
            length += len(piece)
            if payloads:
                kept.append(piece)
        if read < size:
            return
        yield fields, length, sha.digest(), b"".join(kept) if payloads else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``.

    ``sound`` tells whether the payload of a response has the digest its header
    names. With ``payloads=False`` payloads are checked and measured, not returned.
    """
    python_tasks(spark)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW)], names=_RECORD.names)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, size, sha, payload in parse_archive(content.as_py(), payloads):
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    response = fields.get("warc-type") == "response"
                    found = base64.b32encode(sha).decode() if response else None
                    rows.append((
                        fields.get("x-page-id"), fields.get("warc-target-uri"), fields.get("warc-record-id"),
                        fields.get("warc-type"), fields.get("warc-refers-to"), fields.get("x-refers-to-page-id"),
                        digest, size if response else None, payload if response else None,
                        found == digest if response else None))
                    held += len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, _RECORD)


_ARROW = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.bool_()]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payload facts of revisits taken from the response they refer to.

    Only headers are joined, by record id. A popular original has many revisits, so
    its facts are repeated over salts as the revisits are spread.
    """
    found, copies = fresh(records, "found_bytes", "copies")
    revisits = records.where(F.col("record_type") == "revisit").select(
        "page_id", "url", "record_id", "record_type", F.col("refers_to_record").alias("target"), "refers_to", "payload_digest")
    asked = revisits.groupBy("target").agg(F.count(F.lit(1)).alias(copies))
    answers = (records.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("target"))
               .agg(F.max("payload_bytes").alias(found)).join(asked, "target"))
    resolved = attach_group_facts(revisits, staged(answers, "answers"), ["target"], ["page_id"], copies)
    names = ["page_id", "url", "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    return records.where(F.col("record_type") == "response").select(names).unionAll(
        resolved.withColumn("payload_bytes", F.col(found)).select(names))


def archived(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return what the records say of each page.

    A null html is an empty payload, null ids and urls come back as null, and rows with the
    same id are records each. No rows give no rows; other columns are not written.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    records = staged(read_archives(spark, path, payloads=False).drop("payload"), "records")
    if records.where("not sound").count():
        raise ValueError(f"records of {path} do not hold the payload that their header names")
    kind = pages.schema["page_id"].dataType
    return resolve_revisits(records).withColumns({
        "page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
