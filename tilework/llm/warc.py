"""Web archives: writing WARC files with segmented records, and reading them back.

Writing: every page becomes one HTTP response, its body in chunked transfer
framing. A payload that an earlier page (smaller page_id) has already is not
written again but as a revisit of that page. Blocks over ``segment_bytes`` are
split into a first record and continuation records (WARC-Segment-Number,
WARC-Segment-Origin-ID, WARC-Segment-Total-Length on the last).

Reading: the archives are cut into records; continuation records are grouped by
the identifier of their origin, ordered by segment number, checked against the
total length, joined, and the chunked framing is decoded. A missing, repeated or
short segment raises an error instead of giving a damaged page, and so does an
archive that ends within a record or a gzip member. A file may have any number of
members. Archives whose names end in .gz are read as streams, by Spark's text reader with the empty line as line end, and no
more than a record is held of them, whatever their size; plain ones, which that reader would split, are read whole and can have 2 GB.

Files are made by Spark's text writer with the record separator as line end, so
they go wherever Spark can write, are valid archives (gzip by default), and a
lost task is simply written again. An archive holds about ``archive_bytes``.
Segments of one record may be in different archives.

A null html is an empty payload; payloads may be of any length; equal payloads,
also very many, are found by digest and length with pre-aggregation; owners of repeated ones are broadcast while they are
at most ``broadcast_rows``, so that pages stay where they lie, and joined beyond. Repeated page_ids give
records of their own (numbered by a running id), and of equal payloads all rows with
the smallest page_id are responses. Empty tables give no records. Columns but
page_id, url and html are ignored, whatever their names.
A null page_id is kept: its record has an empty page identifier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise

EOL = b"\r\n"
EMPTY_LINE = b"\r\n\r\n"
RECORD_END = EMPTY_LINE.decode()
DATE = "2024-01-01T00:00:00Z"
RECORDS = "origin string, segment int, kind string, page_id long, uri string, digest string, refers_to long, total long, block binary"


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(block: bytes, size: int) -> list[bytes]:
    """Pieces of about size bytes that don't end inside a UTF-8 character."""
    out, at = [], 0
    while len(block) - at > size:
        end = at + size
        while end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def chunked(payload: bytes, size: int = 1 << 14) -> bytes:
    """Chunked transfer framing; no chunk ends inside a UTF-8 character."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size) if c]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; an error where the framing is damaged."""
    out, at = [], 0
    while True:
        end = framed.index(EOL, at)
        n = int(framed[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        part = framed[end + 2 : end + 2 + n]
        if len(part) != n or framed[end + 2 + n : end + 4 + n] != EOL:
            raise ValueError("damaged chunk")
        out.append(part)
        at = end + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + EOL + block


def page_records(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, record: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    name = "" if page_id is None else str(page_id)
    target = " ".join((uri or "").split()) or None
    own = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", name), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record}>"), *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = _cuts(block, segment_bytes)
    for i, piece in enumerate(pieces, 1):
        fields = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", f"<{record}>" if i == 1 else f"<{record}-{i}>"), *own]
        if len(pieces) > 1:
            fields += [("WARC-Segment-Number", i)] + [("WARC-Segment-Origin-ID", f"<{record}>")] * (i > 1) + [("WARC-Segment-Total-Length", len(block))] * (i == len(pieces))
        yield _record([*fields, ("Content-Type", "application/http;msgtype=response")], piece)


def _digests(column: pa.Array) -> pa.Array:
    return pa.array([payload_digest((x or "").encode()) for x in column.to_pylist()], pa.string())


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 8192, archive_bytes: int = 32 << 20, compression: str = "gzip", broadcast_rows: int = 500_000) -> None:
    """Writes a record per row of pages (page_id, url, html) to archives under path."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").withColumn("digest", F.arrow_udf(_digests, "string")(F.col("html")))
    own = own.withColumn("size", F.length(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    # Who owns a payload is settled on digests and lengths alone; pages meet the owners of repeated payloads only, and stay where they lie while these are few.
    owners = materialise(own.groupBy("digest", "size").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__tw_digest"), F.col("size").alias("__tw_size"), "owner"))
    owners = F.broadcast(owners) if owners.count() <= broadcast_rows else owners
    marked = own.join(owners, (F.col("digest") == F.col("__tw_digest")) & (F.col("size") == F.col("__tw_size")), "left").select("page_id", "url", "html", "digest", F.expr("if(page_id = owner, null, owner)").alias("refers_to"), F.monotonically_increasing_id().alias("row"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, digest, refers_to, row = r
                for x in page_records(page_id, url, (html or "").encode(), digest, refers_to, f"urn:tilework:{row}", segment_bytes):
                    out.append(x.decode())
                    size += len(x)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    per_file = max(1, archive_bytes // segment_bytes)
    marked.mapInArrow(records, "value string").write.option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


class RecordReader:
    """Records of archives from pieces of their bytes that were cut at each empty line. Holds one record at a time.

    A block that ends in a line end makes the cut come earlier than the record's end, so what a piece has beyond the record is kept for the next one.
    """

    def __init__(self) -> None:
        self.name: str | None = None
        self.fields: dict[str, object] | None = None
        self.parts: list[bytes] = []
        self.missing = 0
        self.rest = b""

    def end(self) -> None:
        """The file ends here. A last piece isn't followed by an empty line, which may be left over."""
        if self.fields is not None or self.rest not in (b"", EMPTY_LINE):
            raise ValueError(f"a record of {self.name} is cut short")
        self.rest = b""

    def add(self, name: str, piece: bytes) -> dict[str, object] | None:
        """Header fields of the record that this piece ends, with its content under "block"; None in between."""
        if name != self.name:
            self.end()
            self.name = name
        # files that follow each other in one task: what the one before left over is no part of a record
        left = b"" if self.rest == EMPTY_LINE and piece.startswith(b"WARC/") else self.rest
        data, self.rest = left + piece + EMPTY_LINE, b""
        if self.fields is None:
            return self._begin(data)
        self.parts.append(data)
        self.missing -= len(data)
        if self.missing > 0:
            return None
        whole = b"".join(self.parts)
        fields, size = self.fields, len(whole) + self.missing
        if whole[size - len(EMPTY_LINE) : size] != EMPTY_LINE:
            raise ValueError(f"a record of {name} is longer than it says")
        fields["block"] = whole[: size - len(EMPTY_LINE)]
        self.fields, self.parts, over = None, [], whole[size:]
        if over.startswith(b"WARC/"):
            self._begin(over)
        else:
            self.rest = over
        return fields

    def _begin(self, head: bytes) -> None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin in {self.name}")
        self.fields = dict(x.split(": ", 1) for x in head[: -len(EMPTY_LINE)].decode().split("\r\n")[1:])
        self.missing = int(self.fields["Content-Length"]) + len(EMPTY_LINE)


def parse_archive(data: bytes, name: str = "archive") -> Iterator[dict[str, object]]:
    """Header fields of each record of an archive that is held as a whole, with its content under "block"."""
    if data and not data.endswith(EMPTY_LINE):
        raise ValueError(f"a record of {name} is cut short")
    reader = RecordReader()
    for piece in data.split(EMPTY_LINE)[:-1]:
        if record := reader.add(name, piece):
            yield record
    reader.end()


SCHEMA = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])


def _rows(records: Iterator[dict[str, object]]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 256 records or about 4 MB."""
    whole = lambda x: int(x) if x else None
    send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
    rows, size = [], 0
    for r in records:
        origin = r.get("WARC-Segment-Origin-ID") or r["WARC-Record-ID"]
        rows.append((origin, whole(r.get("WARC-Segment-Number")), r["WARC-Type"], whole(r.get("WARC-Page-ID", "").strip()), r.get("WARC-Target-URI"), r["WARC-Payload-Digest"].removeprefix("sha1:"), whole(r.get("WARC-Refers-To-Page-ID")), whole(r.get("WARC-Segment-Total-Length")), r["block"]))
        size += len(r["block"])
        if len(rows) >= 256 or size > 1 << 22:
            yield send()
            rows, size = [], 0
    if rows:
        yield send()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[dict[str, object]]:
        reader = RecordReader()
        for batch in batches:
            for piece in batch["piece"].to_pylist():
                if record := reader.add("an archive", piece):
                    yield record
        reader.end()

    yield from _rows(records())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(r for batch in batches for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True) for r in parse_archive(data.as_py(), name))


def _joined(pieces: pa.Array) -> pa.Array:
    return pa.array([None if x is None else b"".join(x) for x in pieces.to_pylist()], pa.binary())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page: page_id, uri, kind, digest, refers_to, payload (null for revisits)."""
    pieces = spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "*.gz").text(path)
    streamed = pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(_streamed, RECORDS)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[^z]").load(path).select("path", "content").mapInArrow(_held, RECORDS)
    records = streamed.unionByName(plain)
    single = records.where("segment is null").select("page_id", "uri", "kind", "digest", "refers_to", F.when(F.col("kind") == "response", F.col("block")).alias("block"))
    parts = records.where("segment is not null")
    whole = parts.groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("page_id", "uri", "digest"))).alias("page"),
        F.max("segment").alias("last"), F.count("*").alias("n"), F.max("total").alias("total"), F.sum(F.length("block")).alias("bytes"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
    )
    fits = F.col("page").isNotNull() & F.col("total").isNotNull() & (F.col("last") == F.col("n")) & (F.col("bytes") == F.col("total"))
    joined = F.arrow_udf(_joined, "binary")(F.transform("pieces", lambda p: p["block"]))
    checked = F.when(fits, joined).otherwise(F.raise_error(F.concat(F.lit("segments of "), F.coalesce("origin", F.lit("?")), F.lit(" are missing or damaged"))))
    segmented = whole.select("page.page_id", "page.uri", F.lit("response").alias("kind"), "page.digest", F.lit(None).cast("long").alias("refers_to"), checked.alias("block"))
    return single.unionByName(segmented).withColumn("payload", F.arrow_udf(_payloads, "binary")(F.col("block"))).drop("block")


def _payloads(blocks: pa.Array) -> pa.Array:
    """Bodies of HTTP responses, chunked framing decoded."""
    out = []
    for x in blocks.to_pylist():
        if x is None:
            out.append(None)
            continue
        head, _, body = x.partition(b"\r\n\r\n")
        out.append(unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
    return pa.array(out, pa.binary())


def _checked(digest: pa.Array, payload: pa.Array) -> pa.Array:
    for d, p in zip(digest.to_pylist(), payload.to_pylist(), strict=True):
        if p is not None and payload_digest(p) != d:
            raise ValueError(f"payload doesn't have the digest {d}")
    return pa.array([None if p is None else len(p) for p in payload.to_pylist()], pa.int64())


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per page read back: page_id, payload_bytes, payload_digest, record_type, refers_to. Every payload is held against its digest. Only these rows are kept: the archives may go afterwards."""
    read = materialise(read_archives(spark, path).withColumn("bytes", F.arrow_udf(_checked, "long")(F.col("digest"), F.col("payload"))).drop("payload"))
    # A revisit has the length of the response that it refers to.
    sizes = read.where("kind = 'response'").groupBy("digest").agg(F.max("bytes").alias("size")).withColumnRenamed("digest", "__tw_digest")
    again = read.where("kind = 'revisit'").join(sizes, F.col("digest") == F.col("__tw_digest"), "left").select("page_id", F.col("size").alias("bytes"), "digest", "kind", "refers_to")
    rows = read.where("kind = 'response'").select("page_id", "bytes", "digest", "kind", "refers_to").unionByName(again)
    return rows.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
