"""WARC archives: writing with segments and chunked framing, and reassembly on reading.

A page becomes a ``response`` record whose HTTP body is framed in chunks; a block that is
longer than a segment is cut into a first record and ``continuation`` records that name
their origin, their number and, in the last one, the total length. A page whose payload an
other page already holds becomes a ``revisit``. Reading parses the files, groups
continuations by origin, orders them by number, verifies the total length, undoes the
chunks and verifies the payload's digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_among, release_memory, remove_path, stored

#: Bytes of a record's block, of an HTTP chunk, and records of a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16_384, 4_096, 1_024
#: Bytes of a gzip member at most, so that the highest byte of its size is 0; a longer record is several members.
MEMBER_BYTES = (1 << 24) - 1
_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts] + [b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line doesn't end")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) < n or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size line says")
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + _END + block


def _header_text(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def _uri(header: str, url) -> list[tuple[str, object]]:
    return [(header, _header_text(url))] if url is not None else []


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def page_records(page_id, url, payload: bytes, digest: str, refers_to, refers_url, revisit: bool, copy: int | None, copies: bool, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines that end them.

    Records are named by page id, digest and segment number, so that writing a page again
    gives the same ones; a page whose id and payload are repeated has a number of its own,
    and revisits then name it by its page id and URI alone.
    """
    name = f"{page_id}/{digest}" + ("" if copy is None else f"/{copy}")
    own = record_id(name)
    named = _uri("WARC-Target-URI", url)
    named += [("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Page-Id", "" if page_id is None else page_id)]
    digests = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = [("Content-Type", "application/http; msgtype=response")]
    if revisit:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to)]
        profile += [] if copies else [("WARC-Refers-To", record_id(f"{refers_to}/{digest}"))]
        profile += [*_uri("WARC-Refers-To-Target-URI", refers_url), ("WARC-Refers-To-Date", "2024-01-01T00:00:00Z")]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *named, *digests, *profile, *kind], head)]
    block = head + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *named, *digests, *kind], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *named, *digests, ("WARC-Segment-Number", 1), *kind], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{name}#{i}")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), *total], part))
    return out


def gzip_member(record: bytes) -> bytes:
    """A record with the blank lines that end it, as a gzip member of its own (of 16 MB or more as several)."""
    data = record + _END
    return b"".join([gzip.compress(data[i : i + MEMBER_BYTES], 6, mtime=0) for i in range(0, len(data), MEMBER_BYTES)])


def unzipped(data: bytes, step: int = 8_192) -> bytes:
    """The content of all gzip members of a file, or the file's own where it isn't gzipped.

    Members are fed in small steps, since what one leaves over is copied each time.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            part = view[at : at + step]
            if not part:
                raise ValueError("the file ends within a gzip member")
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
    return b"".join(out)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str | None = "url", html: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the rows of ``pages`` as WARC files under ``path``, by Spark's own writer, each record a gzip member.

    Of equal payloads of at least ``least_bytes`` bytes the row with the largest id is the
    response. Rows that share id and payload with it tie and are responses, too; so are rows
    with null ids if no id is known for their payload. A null or empty html is a payload of
    no bytes; a very long one becomes as many segments as it needs. Repeated urls are
    headers like any other; a null one, or one of over 65,536 characters, is left out; an empty table gives an archive without
    records; other columns, whatever their names, are not read.

    A table of bits of fixed size tells most payloads that are not repeated; those are
    written where they are read. The others meet their groups in a join by digest, in which
    a hot payload is on one side once and can be split.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(f"`{key}`").alias("page_id"),
        (F.col(f"`{url}`") if url and url in pages.columns else F.lit(None)).cast("string").alias("url"),
        body.alias("payload"),
        F.unhex(F.sha1(body)).alias("sha1"),
    )
    by_page = rows.groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"), F.max(F.octet_length("payload")).alias("size"))
    groups = by_page.groupBy("sha1").agg(
        F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.sum("n").alias("n"), (F.sum("n") > F.count(F.lit(1))).alias("copies"), F.max("size").alias("size")
    )
    enough = F.col("size") >= least_bytes
    groups = stored(groups.where("n > 1").select("sha1", F.when(enough, F.col("refers_to")).alias("refers_to"), F.when(enough, F.col("refers_url")).alias("refers_url"), "copies"), "warc-groups")
    flagged = maybe_among(rows, "sha1", groups, "maybe")
    names = ["page_id", "url", "payload", "sha1", "refers_to", "refers_url", "copies"]
    nothing = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in ("refers_to", "refers_url", "copies")]
    alone = flagged.where("not maybe").select(*names[:4], *nothing)
    marked = alone.unionByName(flagged.where("maybe").select(*names[:4]).join(groups, "sha1", "left").select(names))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    copy = F.when(F.col("copies"), F.monotonically_increasing_id())
    marked = marked.select("page_id", "url", "payload", "sha1", "refers_to", "refers_url", revisit.alias("revisit"), copy.alias("copy"), F.coalesce("copies", F.lit(False)).alias("copies"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                out = []
                for page_id, u, payload, sha1, *rest in zip(*part.values(), strict=True):
                    digest = base64.b32encode(sha1).decode("ascii")
                    # a member's last byte is 0, the highest of its size's four; the line separator puts it back
                    out += [gzip_member(r)[:-1] for r in page_records(page_id, u, payload, digest, *rest, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        release_memory()

    records = marked.mapInArrow(run, "record binary")
    # bytes pass through the cast unchanged
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    remove_path(pages.sparkSession, groups._scratch)


RECORD = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("total", T.LongType()),
    T.StructField("warc_type", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("refers_to", T.StringType()), T.StructField("block", T.BinaryType()),
])


def parsed_records(data: bytes):
    """(origin, segment or 0 if there is but one, total, type, page id, digest, length, refers to, block) of a file's records."""
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("the file ends within a record")
        at = end + 4 + n + len(_END)
        number = int(headers.get("warc-segment-number", 0))
        total = headers.get("warc-segment-total-length")
        yield (
            headers.get("warc-segment-origin-id", headers["warc-record-id"]), number, int(total) if total else None, headers["warc-type"], headers.get("x-page-id"),
            headers.get("warc-payload-digest", "").removeprefix("sha1:"), int(headers.get("x-payload-length", -1)), headers.get("x-refers-to-page-id"), block,
        )


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``, one row each; files may be gzipped or plain."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = parsed_records(unzipped(content.as_py()))
                while some := list(itertools.islice(rows, 256)):
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in some], schema=_ARROW)

    return files.mapInArrow(run, RECORD)


_ARROW = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.string()), ("block", pa.binary())])


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments are put together by origin; ``whole`` says that none is missing.

    Only segmented records are shuffled; a group is the segments of one record.
    """
    alone = records.where("segment = 0").withColumn("whole", F.lit(True))
    groups = records.where("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("warc_type", "page_id", "digest", "length", "refers_to")),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    numbers = F.transform("parts", lambda p: p["segment"])
    joined = groups.withColumn("block", block).withColumn(
        "whole", F.coalesce((F.octet_length("block") == F.col("total")) & (numbers == F.sequence(F.lit(1), F.size("parts"))), F.lit(False))
    )
    names = ["origin", "warc_type", "page_id", "digest", "length", "refers_to", "block", "whole"]
    return alone.select(names).unionByName(joined.select(names))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: page_id, record_type, payload, payload_bytes, payload_digest, refers_to, whole.

    A response's payload is decoded and hashed anew; ``whole`` is false where its segments,
    chunks or digest don't agree, and the payload is then null. A revisit has no payload of
    its own; its size and digest are those its record gives, as the format has it. Pages
    without an id, repeated ones and very long payloads come back as they were written; no
    files give no rows.
    """
    whole = reassembled(warc_records(spark, path))
    fields = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("whole", T.BooleanType()),
    ])
    arrow = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    row = {"page_id": int(r["page_id"]) if r["page_id"] else None, "record_type": r["warc_type"], "payload": None, "payload_bytes": r["length"], "payload_digest": r["digest"], "refers_to": int(r["refers_to"]) if r["refers_to"] else None, "whole": r["whole"]}
                    if r["warc_type"] == "response" and r["whole"]:
                        head, _, body = r["block"].partition(_END)
                        try:
                            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        except ValueError:
                            payload = None
                        digest = payload_digest(payload) if payload is not None else None
                        row |= {"whole": digest == r["digest"]}
                        if row["whole"]:
                            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return whole.mapInArrow(run, fields)
