"""Web archives: one transaction of WARC records for each page, written by Spark and assembled again by Spark.

A capture is a request, a response or revisit, and a metadata record; the last two name the request in
WARC-Concurrent-To.  Of equal payloads of `least` bytes or more, the capture with the largest page id keeps the payload
in a response; the others are revisits that name it in WARC-Refers-To and keep only its HTTP header.  Digests are
compared through partial aggregates, and joined by ids and digests with salted keys, so that a payload that a third of all
pages have is one row a task, and no payload is moved for it.

Files are valid WARC/1.1, every record a gzip member of its own, so that a reader can seek to any; a file holds some
FILE_BYTES (more only for a record that is larger itself), wherever Spark can write.  Reading takes a file at a time and
inflates a record at a time; it follows Content-Length, so payloads may hold anything, a record's first line included.

Defined results: a null payload is empty; a null url has no WARC-Target-URI, and line breaks in one are written in percent
form; a null page id is read back as null and never keeps a payload for others; of rows that share the largest page id,
each keeps its payload; repeated rows are captures of their own; an empty table has no captures.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm._store import cut

#: Payloads under this size are always written out.
REVISIT_BYTES = 1000
#: Compressed bytes of a file.
FILE_BYTES = 4 << 20
_SALTS = 16
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(F.substring(h, a, n) if a else F.lit("-") for a, n in ((1, 8), (0, 0), (9, 4), (0, 0), (13, 4), (0, 0), (17, 4), (0, 0), (21, 12))), F.lit(">"))


def _record(kind: Column, record: Column, fields: list[tuple[str, Column]], content: str, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {_DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # a null value has no line
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), block)


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", *, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes three records for each row of pages; see the module's text."""
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.regexp_replace(F.regexp_replace(url_column, "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    prints = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page").alias("holder"), F.count("*").alias("n"))
    holders = cut(prints.where("n > 1 and holder is not null").drop("n"), "holders")
    holders = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own_id = F.coalesce(F.col("page").cast("string"), F.lit("")).alias("own_id")
    ids = rows.select(own_id, "page", "digest", "bytes", F.pmod(F.xxhash64("page"), F.lit(_SALTS)).cast("int").alias("salt")).where(F.col("bytes") >= least)
    revisits = ids.join(holders, ["digest", "bytes", "salt"]).where(F.coalesce(F.col("page") < F.col("holder"), F.lit(True))).select("own_id", "digest", "holder").distinct()
    rows = rows.withColumn("own_id", own_id).join(cut(revisits, "revisits"), ["own_id", "digest"], "left").withColumn("capture", F.monotonically_increasing_id())
    again = F.col("holder").isNotNull()
    response = lambda page: _urn(F.lit("response"), page.cast("string"), F.col("digest"))
    request = _urn(F.lit("request"), F.col("capture").cast("string"), F.col("page").cast("string"))
    own = F.when(again | F.col("page").isNull(), _urn(F.lit("own"), F.col("capture").cast("string"))).otherwise(response(F.col("page")))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END + _END))
    digest, url, to = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", request)
    asked = _record(F.lit("request"), request, [url], "application/http;msgtype=request", F.concat_ws(" ", F.lit("GET"), F.col("url"), F.lit("HTTP/1.1\r\n\r\n")))
    origin = F.when(again, response(F.col("holder")))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    answered = _record(F.when(again, "revisit").otherwise("response"), own, [url, to, digest, ("WARC-Refers-To", origin), ("WARC-Profile", profile)], "application/http;msgtype=response", F.when(again, header).otherwise(F.concat(header, F.col("payload"))))
    told = _record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("capture").cast("string")), [url, to], "application/warc-fields", F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit(_END)), F.lit("")))
    records = rows.select(F.explode(F.array(asked, answered, told)).alias("value"))
    packed = records.mapInArrow(_compressed(file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    # A row is a file: its bytes, and in place of a line break a gzip member that holds nothing.
    packed.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _compressed(file_bytes: int) -> callable:
    """Rows of gzip members, one for each record, of about file_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for value in batch.column("value"):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                held += packer.compress(value.as_py().encode() + b"\r\n\r\n") + packer.flush()
                if len(held) >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], ["value"])
                    held = bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], ["value"])

    return run


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds, one at a time; members that hold nothing are passed over."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a member")
            chunk = view[at : at + (1 << 16)]
            parts.append(unpacker.decompress(chunk))
            at += len(chunk)
        at -= len(unpacker.unused_data)
        if body := b"".join(parts):
            yield body


_RECORD = "kind string, record string, uri string, date string, concurrent_to string, refers_to string, digest string, bytes long, block_digest string, page long, payload binary"


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a decompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(_END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read_records(payloads: bool) -> callable:
    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, bytes_, found, page, payload = fields["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            lengths = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            bytes_ = len(payload) if kind == "response" else int(lengths[0])
            found = hashlib.sha1(payload).hexdigest() if kind == "response" else None
        if kind == "metadata" and block.startswith(b"page-id:"):
            page = int(block[8:])
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), digest, bytes_, found, page, payload if payloads and kind == "response" else None

    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in (record for body in members(content.as_py()) for record in parse_archive(body)):
                    rows.append(row(fields, block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives; block_digest is of the payload that was read."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_records(payloads), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata, joined through concurrent_to."""
    request = records.where("kind = 'request'").select(F.col("record").alias("id"), F.struct("record", "uri", "date").alias("request"))
    response = records.where("kind in ('response', 'revisit')").select(F.col("concurrent_to").alias("id"), F.struct("kind", "record", "refers_to", "digest", "block_digest", "bytes", "payload").alias("response"))
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record", "page").alias("metadata"))
    return request.join(response, "id").join(metadata, "id", "left").drop("id")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture, as the archives tell it."""
    rows = cut(assemble(read_records(spark, path, payloads=False)), "captures")
    origin = rows.where("response.kind = 'response'").select(F.col("response.record").alias("record"), F.col("metadata.page").alias("refers_to")).where("refers_to is not null").distinct()
    flat = rows.select(F.col("metadata.page").alias("page_id"), F.col("response.bytes").alias("payload_bytes"), F.coalesce("response.block_digest", "response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("record"))
    alone = flat.where("record is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    origin = cut(origin, "origins").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    revisits = flat.where("record is not null").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    return revisits.join(origin, ["record", "salt"]).select(alone.columns).union(alone)
