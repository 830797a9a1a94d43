"""WARC archives: writing, and reading with segment reassembly and chunk decoding.

Long records are written in segments: the record itself is number 1, `continuation`
records carry the rest, and the last one states the total length. Reading groups
segments by the id of their origin, orders them by number, checks that none is missing
and that the lengths add up, then decodes the chunked transfer framing of the HTTP
message. Equal payloads are stored once: the page of the smallest id is the `response`,
the others are `revisit` records that refer to it.

Archives are plain files of the text writer, whose line separator is the end mark of a
record, so they go wherever Spark can write; a file holds a bounded number of bounded
records. Reading goes through Spark's binary files for the same reason.

Defined cases: NULL html is an empty payload; a NULL url leaves the header out; rows
with equal id and payload give equal records, all of the same type; a NULL id is
larger than any other. A record with missing segments (the first one included), a wrong
total length, broken framing or a wrong digest is returned with the fault in `error` and
without payload. What a truncated or damaged file still holds is read; the record at the
break, or a row without record id if its header is incomplete, states the fault.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.session import stored

#: Bytes of a record's block before it is segmented, and of a chunk.
SEGMENT_BYTES = 1 << 14
CHUNK_BYTES = 1 << 12
#: With the segment size, the bound of an archive file: 64 MB.
RECORDS_PER_FILE = 4096
#: Parsed blocks are handed on after so many bytes.
BATCH_BYTES = 8 << 20
WRITTEN = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as bare upper-case base 32, with built-in functions: 40 bits are 8 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """`id`, `url`, `payload`, `digest` and `refers_to` (NULL for responses) of every page.

    Only groups of equal payloads with several rows are joined back, so payloads move
    only where such groups are too many to broadcast.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload")))
    slim = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    groups = slim.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    groups = stored(groups.select("digest", "first"), "payload-groups")
    joined = spread_join(rows, groups, ["digest"], "left")
    return joined.select("id", "url", "payload", "digest", F.when(
        F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def _header(pairs: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{name}: {re.sub(r'[\r\n]+', ' ', value)}" for name, value in pairs if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def _name(page, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk length")
        parts.append(body[at:at + size])
        at += size + 2


def records(page, url: str | None, payload: bytes, digest: str, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without their end marks."""
    name = _name(page, digest)
    common = [("WARC-Date", WRITTEN), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name),
                       ("WARC-Refers-To", _name(refers_to, digest)),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common,
                       ("Content-Length", "0")])
        return
    block = HTTP + chunked(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        extra = [("WARC-Segment-Number", str(number))] if len(parts) > 1 else []
        if number == len(parts) > 1:
            extra.append(("WARC-Segment-Total-Length", str(len(block))))
        if number == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"),
                    ("WARC-Segment-Origin-ID", name), ("WARC-Date", WRITTEN)]
        yield _header([*head, *extra, ("Content-Length", str(len(part)))]) + part


def write_archives(plan: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES,
                   per_file: int = RECORDS_PER_FILE) -> None:
    """Stores the planned pages as gzipped archives."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to"))):
                out.extend(records(*(value.as_py() for value in row), segment_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = plan.mapInArrow(encoded, "record binary").select(F.col("record").cast("string").alias("value"))
    (lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip")
     .text(path))


_FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Target-URI": "url", "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "stated", "WARC-Segment-Number": "number", "WARC-Segment-Origin-ID": "origin",
    "WARC-Segment-Total-Length": "total",
}
_NUMBERS = {"number", "total"}
_PARSED = ", ".join(f"{c} {'bigint' if c in _NUMBERS else 'string'}" for c in _FIELDS.values())
_PARSED += ", fault string, block binary"
_LOWER = {name.lower(): column for name, column in _FIELDS.items()}


def unzipped(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members, as far as they can be read, and the fault that ended them."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            parts.append(member.decompress(content) + member.flush())
        except zlib.error as fault:
            return b"".join(parts), f"damaged gzip: {fault}"
        if not member.eof:
            return b"".join(parts), "truncated gzip"
        content = member.unused_data
    return b"".join(parts), None


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive, by their stated lengths; gzip is recognised.

    A break in the file is the `fault` of the record in which it lies, or of a row of its own.
    """
    broken = None
    if content[:2] == b"\x1f\x8b":
        content, broken = unzipped(content)
    end, at = 0, content.find(b"WARC/")
    while at >= 0:
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0:
            yield {"fault": broken or "truncated header", "block": b""}
            return
        fields, length = {}, 0
        for line in content[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.decode(errors="replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            column = _LOWER.get(name)
            if column in _NUMBERS or name == "content-length":
                # more digits than a length can have are a fault, too
                if not re.fullmatch("[0-9]{1,18}", value):
                    fields["fault"] = f"no number in {name}"
                elif column:
                    fields[column] = int(value)
                else:
                    length = int(value)
            elif column:
                fields[column] = value
        block = content[stop + 4:stop + 4 + length]
        if len(block) < length:
            fields["fault"] = broken or "truncated block"
            broken = None
        yield {**fields, "block": block}
        end = stop + 4 + len(block)
        at = content.find(b"WARC/", end)
    if broken or content[end:].strip():
        yield {"fault": broken or "truncated header", "block": b""}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives under `path`."""
    columns = [*_FIELDS.values(), "fault", "block"]
    types = [*(pa.int64() if c in _NUMBERS else pa.string() for c in columns[:-1]), pa.binary()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) for r in rows], t) for c, t in zip(columns, types)], names=columns)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row["block"]) + 400
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, _PARSED)


def reassembled(parsed: DataFrame) -> DataFrame:
    """One row per logical record: its blocks in order, and the stated total.

    Records in one piece stay where they are. Equal records are counted before their
    segments meet, so that many copies of one page do not meet in one task.
    """
    kept = ["record_id", "type", "url", "refers_to", "stated", "fault"]
    whole = parsed.filter("number is null").select(*kept, F.array("block").alias("blocks"),
                                                   F.lit(True).alias("complete"))
    parts = parsed.filter("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    once = parts.groupBy("origin", "number").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.max("block").alias("block"),
        *(F.max(c).alias(c) for c in kept[1:]))
    once = once.withColumn("type", F.when(F.col("number") == 1, F.col("type")))
    size = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"]))
    joined = once.groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"), F.max("total").alias("total"),
        F.max("number").alias("last"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        *(F.max(c).alias(c) for c in kept[1:]))
    complete = (F.size("parts") == F.col("last")) & F.col("type").isNotNull() & (size == F.col("total"))
    segmented = joined.select(
        F.col("origin").alias("record_id"), *kept[1:], F.transform("parts", lambda p: p["block"]).alias("blocks"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
        F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies").cast("int"), F.lit(1)))).alias("copy"))
    return whole.unionAll(segmented.drop("copy"))


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message; ValueError if it is broken."""
    head = block.index(b"\r\n\r\n")
    body = block[head + 4:]
    return unchunked(body) if re.search(rb"(?i)transfer-encoding: *chunked", block[:head]) else body


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Record id, type, url, refers_to, payload_bytes, payload_digest, error and payload of each logical record.

    Revisit records have the size and digest of the record that they refer to.
    """
    names = ["record_id", "type", "url", "refers_to", "stated", "fault"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, errors, payloads = [], [], [], []
            for kind, stated, fault, blocks, complete in zip(*(
                    batch.column(c) for c in ("type", "stated", "fault", "blocks", "complete"))):
                payload, error, digest = None, fault.as_py(), None
                if error:
                    pass
                elif not complete.as_py():
                    error = "segments missing or total length wrong"
                elif kind.as_py() != "revisit":
                    try:
                        payload = payload_of(b"".join(blocks.as_py()))
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if stated.as_py() and stated.as_py().rpartition(":")[2] != digest:
                            payload, error = None, "payload digest wrong"
                    except ValueError as wrong:
                        error = f"broken framing: {wrong}"
                sizes.append(None if payload is None else len(payload))
                digests.append(None if payload is None else digest)
                errors.append(error)
                payloads.append(payload if with_payload else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(errors, pa.string()), pa.array(payloads, pa.binary())],
                names=[*names, "payload_bytes", "payload_digest", "error", "payload"])

    schema = ", ".join(f"{c} string" for c in names)
    rows = reassembled(read_records(spark, path)).mapInArrow(
        decoded, f"{schema}, payload_bytes bigint, payload_digest string, error string, payload binary")
    rows = rows.drop("stated", "fault")
    if not with_payload:
        rows = stored(rows, "records")
    revisits = rows.filter("type = 'revisit'").withColumn("target", F.col("refers_to"))
    found = rows.filter("type = 'response' and error is null").groupBy(F.col("record_id").alias("target")).agg(
        F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    resolved = spread_join(revisits.drop("payload_bytes", "payload_digest"), found, ["target"], "left")
    resolved = resolved.select(
        "record_id", "type", "url", "refers_to", F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.coalesce("error", F.when(F.col("bytes").isNull(), "referred record missing")).alias("error"), "payload")
    return rows.filter("not type <=> 'revisit'").unionAll(resolved)


def page_of(record_id: Column) -> Column:
    """The page id in a record id written here."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:x-page:([^:]*):", 1), F.lit(""))
