"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

Writing: each page is one record in its own gzip member. Of pages with equal payloads of at least ``least`` bytes the
one with the largest id is the response; the others are revisits that name it. Digests that occur more than once are
broadcast within a counted bound, and payloads stay where they were read. Beyond it pages' ids and digests alone meet
the table of shared digests, common ones spread over tasks, and the decision is joined to the pages by id.

Reading: a record is taken if its version line and headers parse, its block has the stated length and the block's digest
agrees; in a gzip member of several records each is taken, and one without digest only if the member inflates whole.
After a failed check the reader tries each later version line, in the member's bytes and then in the file, and each
later gzip mark until a record passes; what lies between is logged as a gap, and reading goes on there. Plain records
are read as well. Blocks are read in pieces, so memory is bounded by headers and a piece, whatever the length of a
record; nothing is too large to be read.

A null payload is empty. Pages with a null id never own a payload while one with an id has it. Repeated rows with the
largest id each stay responses. A null url gives a record without target. Extra columns are ignored, an empty table
gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fits, spread_join, work_path, written
from .files import RangeReader, ShardWriter

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: Bytes after which a writer starts a new file, and those read at once.
SHARD, PIECE = 256 << 20, 1 << 16
#: Bytes of a block beyond which it has no HTTP head.
HEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: Any, url: str | None, payload: bytes, digest: str, owner: Any = None) -> bytes:
    """The bytes of a record; a revisit if ``owner`` names the response that holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    lines = [
        "WARC/1.1", "WARC-Type: " + ("response" if owner is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if owner is not None:
        lines += [f"WARC-Refers-To: <urn:page:{owner}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest, owner (the response's id if the page is to be a revisit)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    all_pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = all_pages.filter(F.length("payload") >= least).groupBy("digest").agg(F.count("*").alias("c"), F.max("page_id").alias("owner")).filter("c > 1 AND owner IS NOT NULL").select("digest", "owner")
    again = written(again, "shared-payloads")
    if fits(again, 100):
        out = all_pages.join(F.broadcast(again), "digest", "left")
    else:
        key = F.struct(F.coalesce("page_id", F.lit(-1)), F.col("page_id").isNull()).alias("key")
        owners = spread_join(all_pages.select(key, "digest"), again, ["digest"], "inner", 100).distinct()
        out = all_pages.withColumn("key", key).join(owners, ["key", "digest"], "left").drop("key")
    return out.withColumn("owner", F.when(~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner")))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in ``folder``; the written table of files: path, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        out, told = ShardWriter(folder, ".warc.gz", shard), {}
        for b in batches:
            for page, url, payload, digest, owner in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "owner"))):
                path, at = out.place()
                out.write(member(record(page, url, payload, digest, owner)))
                told[path] = (told.get(path, (0, 0))[0] + 1, out.at)
        out.close()
        yield {"path": [*told], "n_records": [n for n, _ in told.values()], "n_bytes": [m for _, m in told.values()]}

    return written(arrow_map(decided(pages, least), run, "path string, n_records long, n_bytes long"), "archives")


class Damaged(ValueError):
    """A record that fails a check."""


class Broken(Damaged):
    """A gzip member that doesn't inflate whole."""


class Pieces:
    """Bytes that come in pieces: looked at, then taken. ``at`` is how many were taken."""

    def __init__(self, source: Iterator[bytes]) -> None:
        self.source, self.held, self.at = source, b"", 0

    def more(self) -> bool:
        """Holds another piece; false at the end."""
        data = next(self.source, b"")
        self.held += data
        return bool(data)

    def look(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return self.held[:n]

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes, or as many as are left."""
        while n and (self.held or self.more()):
            data, self.held = self.held[:n], self.held[n:]
            n, self.at = n - len(data), self.at + len(data)
            yield data

    def skip(self, n: int) -> None:
        for _ in self.take(n):
            pass

    def seek(self, mark: bytes) -> bool:
        """Goes on to the next ``mark``; false, and at the end, if there is none."""
        while (k := self.held.find(mark)) < 0:
            k = max(0, len(self.held) - len(mark) + 1)
            self.held, self.at = self.held[k:], self.at + k
            if not self.more():
                self.at, self.held = self.at + len(self.held), b""
                return False
        self.held, self.at = self.held[k:], self.at + k
        return True


def headers(source: Pieces) -> dict[str, str]:
    """Takes the version line and the headers, of any length; Damaged as soon as they can't be such."""
    if not source.look(len(VERSION)).startswith(VERSION):
        raise Damaged("no version line or no end of headers")
    told, first, start = {}, True, 0
    while True:
        end = source.held.find(b"\r\n", start)
        if end < 0:
            if not source.more():
                raise Damaged("no version line or no end of headers")
            continue
        try:
            line = source.held[start:end].decode()
        except UnicodeDecodeError as e:
            raise Damaged("headers aren't UTF-8") from e
        start = end + 2
        name, colon, value = line.partition(":")
        if not line:
            break
        if colon:
            told[name.strip().lower()] = value.strip()
        elif not first and line[0] not in " \t":
            raise Damaged("no version line or no end of headers")
        first = False
    if not re.fullmatch(r"[0-9]+", told.get("content-length", "")):
        raise Damaged("no content length")
    source.skip(start)
    return told


@dataclass
class Record:
    """A record as read: its headers, the HTTP head of its block, and length and digest of the payload after that."""

    headers: dict[str, str]
    http: bytes
    payload_bytes: int
    payload_digest: str
    #: Whether the block's digest was stated, and so checked.
    proven: bool


def taken(source: Pieces) -> Record:
    """The next record, checked."""
    told = headers(source)
    n, seen, whole, own = int(told["content-length"]), 0, hashlib.sha1(), hashlib.sha1()
    http, in_head, size = b"", told.get("content-type", "").startswith("application/http"), 0
    for data in source.take(n):
        seen += len(data)
        whole.update(data)
        if in_head:
            http, found, data = (http + data).partition(b"\r\n\r\n")
            in_head = not found and len(http) < HEAD
            if in_head:
                continue
            if not found:  # no head after all
                http, data = b"", http
        own.update(data)
        size += len(data)
    if seen < n:
        raise Damaged("block is cut short")
    stated = told.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:].lower() != whole.hexdigest():
        raise Damaged("block digest disagrees")
    if source.look(4) == b"\r\n\r\n":
        source.skip(4)
    return Record(told, http, size, own.hexdigest(), stated.startswith("sha1:"))


class Member:
    """The bytes of the gzip member at ``at``; ``end`` is where it ends, once they were all read."""

    def __init__(self, source: RangeReader, at: int) -> None:
        self.source, self.at, self.end = source, at, at

    def pieces(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            data = self.source.read(self.end, min(PIECE, self.source.size - self.end))
            if not data:
                raise Broken("member is cut short")
            self.end += len(data)
            while data and not z.eof:
                try:
                    part = z.decompress(data, 16 * PIECE)
                except zlib.error as e:
                    raise Broken("member doesn't inflate") from e
                data = z.unconsumed_tail
                if part:
                    yield part
        self.end -= len(z.unused_data)


def inside(member: Member) -> Iterator[tuple[int, int, Record | None, str]]:
    """(place, length, record or None for a gap, reason) of what a member's bytes hold; Broken where it doesn't inflate.
    Records without a digest come last, once it did."""
    unproven, start, gap, reason = [], 0, None, ""
    while True:
        member.end, failed = member.at, ""
        stream = Pieces(member.pieces())
        stream.skip(start)
        if gap is not None:
            stream.seek(VERSION)
        while stream.look(1):
            begin = stream.at
            try:
                found = taken(stream)
            except Broken:
                raise
            except Damaged as e:
                failed = str(e)
                break
            if gap is not None:
                yield gap, begin - gap, None, reason
                gap = None
            told = (begin, stream.at - begin, found, "")
            if found.proven:
                yield told
            else:
                unproven.append(told)
        if not failed:
            break
        if gap is None:
            gap, reason = begin, failed
        start = begin + 1
    if gap is not None:
        yield gap, stream.at - gap, None, reason
    yield from unproven


def salvage(path: str) -> Iterator[tuple[int, int | None, int, Record | None, str]]:
    """(start, inner, length, record, reason) of every record and quarantined gap (without record). ``start`` is a place in
    the file; in a gzip member it is that of the member, and ``inner`` and ``length`` count its inflated bytes."""
    source, at, gap, reason = RangeReader(path), 0, None, ""

    def plain(at: int) -> Iterator[bytes]:
        while at < source.size:
            yield (data := source.read(at, min(PIECE, source.size - at)))
            at += len(data)

    try:
        while at < source.size:
            try:
                if source.read(at, min(3, source.size - at)) == GZIP:
                    member = Member(source, at)
                    for inner, length, record, why in inside(member):
                        if gap is not None:
                            yield gap, None, at - gap, None, reason
                            gap = None
                        yield at, inner, length, record, why
                    end = member.end
                else:
                    stream = Pieces(plain(at))
                    record = taken(stream)
                    if gap is not None:
                        yield gap, None, at - gap, None, reason
                        gap = None
                    yield at, None, stream.at, record, ""
                    end = at + stream.at
                at = end
            except Damaged as e:
                if gap is None:
                    gap, reason = at, str(e)
                at = source.find((GZIP, VERSION), at + 1)
        if gap is not None:
            yield gap, None, source.size - gap, None, reason
    finally:
        source.close()


def named(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.+)>", urn or "")
    return found[1] if found else None


def read_archives(files: DataFrame) -> DataFrame:
    """Salvages every file of ``files`` (path). A row per record and per gap: path, start, inner, length (see ``salvage``),
    kind (WARC type or ``gap``), page, refers_to, uri, payload_bytes, payload_digest, reason. A response's digest and
    length are taken from the payload that was read (``reason`` tells if it states another), a revisit's from what it
    states of the response's."""
    names = ("path", "start", "inner", "length", "kind", "page", "refers_to", "uri", "payload_bytes", "payload_digest", "reason")

    def row(path: str, start: int, inner: int | None, length: int, record: Record | None, reason: str) -> tuple:
        if record is None:
            return path, start, inner, length, "gap", None, None, None, None, None, reason
        told, n, digest = record.headers, record.payload_bytes, record.payload_digest
        stated = told.get("warc-payload-digest", "").removeprefix("sha1:").lower()
        if told.get("warc-type") == "revisit":
            size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", record.http)
            n, digest = int(size[1]) if size else None, stated
        elif stated and stated != digest:
            reason = "payload digest disagrees"
        return path, start, inner, length, told.get("warc-type", ""), named(told.get("warc-record-id")), named(told.get("warc-refers-to")), told.get("warc-target-uri"), n, digest, reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for found in salvage(path):
                    rows.append(row(path, *found))
                    if len(rows) == 5000:
                        yield dict(zip(names, zip(*rows)))
                        rows = []
                if rows:
                    yield dict(zip(names, zip(*rows)))

    spread = files.select("path").repartition(max(1, files.count()))
    return arrow_map(spread, run, "path string, start long, inner long, length long, kind string, page string, refers_to string, uri string, payload_bytes long, payload_digest string, reason string")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_path(spark, "warc"))
    read = read_archives(files).filter("kind <> 'gap'")
    return read.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to FROM o
"""
