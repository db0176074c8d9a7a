"""WARC archives: a writer with revisit records, and a sequential reader (operator 7).

Every record is a gzip member of its own. The reader takes the archive in fixed chunks, inflates member after member
with one zlib object, frames each record by Content-Length and checks the SHA-256 of its block.

Of pages with equal payloads of at least `least` bytes the one with the smallest id is written as response, the others
as revisit records without a payload that name it. Equal payloads are found by their digest with map-side combining;
payloads themselves are never gathered by content.

Defined cases: a null payload is empty (a response, for it is short); a null id never is what others refer to (a group
of null ids only are all responses); rows that repeat the smallest id of a group are all responses; an archive with other
than the announced number of records is an error; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, texts_of
from .files import reading, writing

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def member(head: bytes, block: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def safe(url: str | None) -> str:
    """A URL as a header value: one line."""
    return "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    name = f"urn:page:{'null' if page_id is None else page_id}"
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", safe(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{digest if kind == 'response' else hashlib.sha256(b'').hexdigest()}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
    return member(header([*fields, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]), block)


class WarcError(ValueError):
    """A record that is cut short, badly framed or fails its digest."""


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator over its inflated pieces; one must be used up before the next."""
    data = stream.read(CHUNK)

    def pieces() -> Iterator[bytes]:
        nonlocal data
        z = zlib.decompressobj(31)
        while True:
            if piece := z.decompress(data, CHUNK):
                yield piece
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data or stream.read(CHUNK)
                return
            data = data or stream.read(CHUNK)
            if not data and not z.eof:
                if piece := z.flush():
                    yield piece
                raise WarcError("the archive ends within a member")

    while data:
        yield pieces()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in turn; the block's length and digest are verified."""
    for pieces in members(stream):
        head = b""
        for piece in pieces:
            head += piece
            if b"\r\n\r\n" in head:
                break
        lines, found, rest = head.partition(b"\r\n\r\n")
        first, *fields = lines.decode("utf-8").split("\r\n")
        if not found or not first.startswith("WARC/"):
            raise WarcError("a member does not begin with a WARC header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
        length = int(headers["content-length"])
        digest, block, held = hashlib.sha256(), [], 0
        tail = b""
        for piece in _chain(rest, pieces):
            take = piece[: length - held]
            digest.update(take)
            block.append(take)
            held += len(take)
            tail += piece[len(take) :]
        if held != length or tail != b"\r\n\r\n":
            raise WarcError(f"a block of {held} bytes, where {length} were announced")
        if (said := headers.get("warc-block-digest")) and said != f"sha256:{digest.hexdigest()}":
            raise WarcError("a block does not match its digest")
        yield headers, b"".join(block)


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def payload_groups(pages: DataFrame, least: int) -> DataFrame:
    """digest, first_id, n: payloads of at least `least` bytes that more than one row has."""
    own = pages.where(F.octet_length("html") >= least).select(F.sha2(F.col("html").cast("binary"), 256).alias("digest"), "page_id")
    return own.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def write_warc(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """uri, n_records of the archives written into folder. pages: page_id, url, html."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = payload_groups(pages, least)
    # only digests meet in this join's other side; the hot payload is one row there, and skewed partitions are split
    joined = pages.join(groups.select("digest", "first_id"), "digest", "left")
    schema = pa.schema([("uri", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
        k = 0
        row = next(rows, None)
        while row is not None:
            uri, n, size = f"{folder}/part-{part:06d}-{k:04d}.warc.gz", 0, 0
            with writing(uri) as f:
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, payload, digest, first = row
                    response = first is None or page_id == first
                    size += f.write(record(page_id, url, payload, digest, "response" if response else "revisit", first))
                    n += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n]}, schema=schema)
            k += 1

    return cut(joined.select("page_id", "url", "html", "digest", "first_id").mapInArrow(run, "uri string, n_records long"), "archives")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, in one sequential pass per archive."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None):
        value = (name or "").strip("<>").rpartition(":")[2]
        return int(value) if value not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, announced in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                n = 0
                with reading(uri) as f:
                    for n, (h, block) in enumerate(records(f), 1):
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise WarcError("a payload does not match its digest")
                        rows.append((number(h["warc-record-id"]), len(block) if kind == "response" else int(h["x-payload-length"]), digest, kind, number(h.get("warc-refers-to"))))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f2.type) for x, f2 in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if n != announced:
                    raise WarcError(f"{uri} has {n} records, where {announced} were announced")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f2.type) for x, f2 in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    tasks = max(1, archives.count())
    return archives.select("uri", "n_records").repartition(tasks).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, folder: str | None = None) -> DataFrame:
    """What the archives say after they were written and read back."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return read_warc(write_warc(pages, folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}", least))


SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""
