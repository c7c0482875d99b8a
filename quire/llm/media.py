"""Media columns: content-addressed payloads in tar shards, rows that carry digest, offset and length.

A payload is stored as a grey PNG of one line, 8 bits a sample, under the SHA-256 of the payload. Each distinct payload
is stored once: digests that occur more than once are deduplicated by a shuffle of their own rows alone, all others are
written where they are read. If there are more repeated digests than may be broadcast, all payloads are deduplicated by
one shuffle; either way a task sends a payload once, however often it holds it. The manifest (digest, shard, offset, length) is a written table; shards of lost task
attempts are never in it. Metadata columns come from a range read of the image's header, 33 bytes; features from a read
of the whole object.

Null texts are empty; an empty text is 64 zero bytes. Texts that differ only by zero bytes at the end may share a
payload and keep their own n_bytes. Repeated rows and null ids stay, extra columns are ignored, payloads of any length
are stored whole (a PNG line holds 2^31 - 1 samples).
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fits, picked, spread_join, work_path, written
from .files import RangeReader, ShardWriter

UNIT = 64
SHARD = 1 << 30
#: Signature and header chunk of a PNG file.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """One line of 8-bit grey samples; lossless."""
    line = chunk(b"IHDR", struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0))
    return SIGNATURE + line + chunk(b"IDAT", zlib.compress(b"\0" + payload, 6)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a PNG file")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    """The samples of an image as ``encode`` makes it, checked."""
    width, height, bits = header(data)
    at, parts = HEADER, []
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum disagrees")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    line = zlib.decompress(b"".join(parts))
    if (height, bits, len(line), line[:1]) != (1, 8, width + 1, b"\0"):
        raise ValueError("not one plain line of 8-bit samples")
    return line[1:]


def feature(payload: bytes) -> str:
    """Samples as rows of 64: which column means exceed their neighbour's, and the shares of 8 ranges of values in 1/255."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    means = rows.sum(axis=0, dtype=np.int64)
    shares = np.bincount(rows.ravel() >> 5, minlength=8) * 255 // rows.size
    return np.packbits(means > np.roll(means, -1)).tobytes().hex() + "-" + shares.astype(np.uint8).tobytes().hex()


def padded(text_bytes: F.Column) -> F.Column:
    n = F.octet_length(text_bytes)
    missing = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(text_bytes, F.repeat(F.lit("\0"), missing.cast("int")).cast("binary"))


def store(payloads: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """Stores each distinct payload of ``payloads`` (digest, payload) once; the manifest: digest, shard, offset, length."""
    again = written(payloads.groupBy("digest").count().filter("count > 1").select("digest"), "repeated-digests")
    first = lambda df: df.groupBy("digest").agg(F.first("payload").alias("payload"))
    if fits(again, 100):
        again = F.broadcast(again)
        once = payloads.join(again, "digest", "left_anti").unionByName(first(payloads.join(again, "digest", "left_semi")))
    else:
        once = first(payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        out = ShardWriter(folder, ".tar", shard)
        for b in batches:
            rows: list[tuple] = []
            for digest, payload in zip(b.column("digest").to_pylist(), b.column("payload").to_pylist()):
                image = encode(payload)
                path, at = out.place()
                entry = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                entry.size = len(image)
                out.write(entry.tobuf(tarfile.USTAR_FORMAT))
                rows.append((digest, path, out.at, len(image)))
                out.write(image + bytes(-len(image) % tarfile.BLOCKSIZE))
            yield dict(zip(("digest", "shard", "offset", "length"), zip(*rows) if rows else ([], [], [], [])))
        out.close(bytes(2 * tarfile.BLOCKSIZE))

    return written(arrow_map(once.select("digest", "payload"), run, "digest string, shard string, offset long, length long"), "manifest")


def filled(manifest: DataFrame, whole: bool = True) -> DataFrame:
    """``manifest`` with metadata columns (width, height, bits) from header-only range reads and, if ``whole``, columns
    computed from the object read back: payload_sha256, payload_bytes, tail_crc32, media_sha256, feature."""
    names = ["digest", "shard", "offset", "length", "width", "height", "bits"] + ["payload_sha256", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        source, opened = None, ""
        for b in batches:
            rows = []
            for digest, shard, at, n in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                if shard != opened:
                    if source:
                        source.close()
                    source, opened = RangeReader(shard), shard
                row = (digest, shard, at, n, *header(source.range(at, HEADER)))
                if whole:
                    image = source.read(at, n)
                    payload = decode(image)
                    row += (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload))
                rows.append(row)
            yield dict(zip(names, zip(*rows) if rows else [[]] * len(names)))
        if source:
            source.close()

    kinds = {"offset": "long", "length": "long", "width": "long", "height": "long", "bits": "int", "payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long"}
    return arrow_map(manifest, run, ", ".join(f"{x} {kinds.get(x, 'string')}" for x in names))


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_bytes, digest, shard, offset, length, metadata and what was computed from the stored bytes."""
    rows = picked(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), padded(F.col("text").cast("binary")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    manifest = store(rows.select("digest", "payload"), folder)
    return spread_join(rows.select("doc_id", "n_bytes", "digest"), filled(manifest), ["digest"], "left")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), work_path(spark, "media"))
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")
