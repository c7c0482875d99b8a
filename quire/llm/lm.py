"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Lots: texts are hashed to words (64 bits) and written as lots of some ``LOT`` tokens, each the distinct words of its texts
and a number for every token. All else reads lots, so texts are read once.

Counting: the distinct words and word pairs of a lot go, as sorted runs with their counts in training texts, to the
segment of the hash space that they fall in; the number of segments follows the bytes of text, so that each is merged in
bounded memory. A count c has level 1 + floor(log2 c), and its n-gram enters the segment's filter once for every level up
to that, so the filter grows with the distinct n-grams. It has no size bound, so it isn't broadcast whole: a segment's
part serves the worker that merged it, which probes it for all n-grams of the runs that it was sent and returns a byte
for each. So probing needs no shuffle of its own and works alike at every size. The segments are a written table.

Scoring: a count is read by probing levels 1, 2, ... until one is missing; level j stands for the middle of its range. A
token's score is that of L min(1, c(h w)/c(h)) + (1 - L) p(w), p being add-half smoothed, with one L for each level of
c(h), fitted by expectation maximisation on a histogram over all training tokens with their own occurrence left out. As
counts are quantised, the sum over all words isn't exactly 1. A filter tells too high a level for some absent n-grams (about
0.4 % of them), never too low a one.

The base score is exact but for collisions of 64-bit hashes: segments return the exact counts of words beside the levels.

Null and empty texts are one end token. Repeated rows count again and each get their row; a null id hashes as ''. Extra
columns are ignored. Without training tokens N and V are 0 and every p(w) is 1. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType
from zstandard import compress, decompress

from .common import arrow_map, bucket, picked, written
from .words import BLANKS, ONE, TWO, mix, slices, sums, tokenize

#: Bits of filter for an entry, and probes for one.
BITS, PROBES = 12, 6
#: Bytes of text for a segment, and tokens of a lot.
SEGMENT, LOT = 8 << 20, 1 << 19
KEY = np.uint64((1 << 48) - 1)
WORDS, PAIRS, FILTER = 0, 1, 2
#: Bytes of a key in a run.
WIDTH = {WORDS: 8, PAIRS: 6}
END = np.uint64(0xE2D)
START = np.uint64(0x57A27)
BINS = 256


def stream(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each text, and the number of tokens of each text."""
    t = tokenize(batch.column("text"), BLANKS)
    size = np.diff(t.bounds) + 1
    word = np.empty(int(size.sum()), np.uint64)
    ends = np.cumsum(size) - 1
    own = np.ones(len(word), bool)
    own[ends] = False
    word[ends] = END
    word[own] = t.hashes()
    return word, size


def paired(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that the tokens end."""
    before = np.roll(word, 1)
    before[bounds[:-1]] = START
    return mix(before * ONE ^ (word + TWO))


def packed(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes, compressed plane by plane of their bytes; so they stay outside the worker that uses them."""
    return compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(decompress(data), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def lots(docs: DataFrame, lot: int) -> DataFrame:
    """The written table of lots of ``docs`` (doc_id, text, held_out): lot, ids, held, sizes, words, tokens, n_train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def flushed(held: list) -> dict[str, list]:
            words, which = np.unique(np.concatenate([w for w, _, _ in held]), return_inverse=True)
            flags = [x for _, _, b in held for x in b.column("held_out").to_pylist()]
            return {
                "ids": [[x for _, _, b in held for x in b.column("doc_id").to_pylist()]], "held": [flags], "sizes": [packed(np.concatenate([n for _, n, _ in held]))],
                "words": [words.tobytes()], "tokens": [packed(which)], "n_train": [len(flags) - sum(flags)],
            }

        held, n = [], 0
        for b in batches:
            for part in slices(b):
                held.append((*stream(part), part))
                n += len(held[-1][0])
                if n >= lot:
                    yield flushed(held)
                    held, n = [], 0
        if held:
            yield flushed(held)

    kinds = [("ids", ArrayType(docs.schema["doc_id"].dataType)), ("held", ArrayType(BooleanType())), ("sizes", BinaryType()), ("words", BinaryType()), ("tokens", BinaryType()), ("n_train", LongType())]
    return written(arrow_map(docs, run, StructType([StructField(*x) for x in kinds])).withColumn("lot", F.monotonically_increasing_id()), "lm-lots")


class Lot:
    """A lot's tokens: ``words`` are its distinct words and ``which`` each token's place among them, ``pairs`` and ``whose``
    the same of pairs; all sorted by hash. Text k has tokens bounds[k]..bounds[k+1]; ``training`` marks tokens."""

    def __init__(self, b: pa.RecordBatch, k: int) -> None:
        self.words = np.frombuffer(b.column("words")[k].as_buffer(), np.uint64)
        self.which = unpacked(b.column("tokens")[k].as_buffer())
        size = unpacked(b.column("sizes")[k].as_buffer()).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.training = ~np.repeat(np.array(b.column("held")[k].as_py(), bool), size)
        self.pairs, self.whose = np.unique(paired(self.words[self.which], self.bounds), return_inverse=True)

    def counted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, hashes and counts in training texts."""
        for kind, keys, at in ((WORDS, self.words, self.which), (PAIRS, self.pairs, self.whose)):
            yield kind, keys, np.bincount(at[self.training], minlength=len(keys))


def segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def runs(table: DataFrame, segments: int) -> DataFrame:
    """lot, seg, kind, keys, counts: what each lot has for each segment; pairs keep 48 bits, which with the segment name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for k in range(b.num_rows):
                rows = []
                for kind, keys, counts in Lot(b, k).counted():
                    seg = segment(keys, segments)
                    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(keys) else []
                    for at, to in zip(first, [*first[1:], len(keys)]):
                        own = keys[at:to]
                        raw = own.tobytes() if kind == WORDS else np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                        rows.append((b.column("lot")[k].as_py(), int(seg[at]), kind, raw, packed(counts[at:to])))
                yield dict(zip(("lot", "seg", "kind", "keys", "counts"), zip(*rows)))

    return arrow_map(table, run, "lot long, seg long, kind int, keys binary, counts binary")


def hashes(raw: bytes, kind: int) -> np.ndarray:
    if kind == WORDS:
        return np.frombuffer(raw, np.uint64)
    whole = np.zeros((len(raw) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return whole.view(np.uint64).ravel()


def merged(rows: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all lots, their counts in training texts (0 for some), and the place among them of each run's keys in turn."""
    rows = rows[rows["kind"] == kind]
    keys, counts = hashes(b"".join(rows["keys"]), kind), np.concatenate([np.zeros(0, np.uint32), *map(unpacked, rows["counts"])])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(first) - 1
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first)) if len(keys) else np.zeros(0, np.int64), at


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(j-1)..2^j-1; 0 for none."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def entry(keys: np.ndarray, kind: int, level: int) -> np.ndarray:
    return mix((keys & KEY) ^ np.uint64((kind << 56) + (level << 48)))


def places(g: np.ndarray, size: np.ndarray | np.uint64, probe: int) -> np.ndarray:
    return ((g & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((g >> np.uint64(32)) | np.uint64(1))) % size


def filled(counted: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """The filter of counted n-grams by kind, as bytes."""
    entries = sum(int(level_of(n).sum()) for _, n in counted.values())
    size = np.uint64(max(64, -(-entries * bits // 64) * 64))
    out = np.zeros(int(size), bool)
    for kind, (keys, counts) in counted.items():
        levels, j = level_of(counts), 1
        while len(keys):
            g = entry(keys, kind, j)
            for i in range(PROBES):
                out[places(g, size, i)] = True
            j += 1
            kept = levels >= j
            keys, levels = keys[kept], levels[kept]
    return np.packbits(out, bitorder="little")


def probed(data: np.ndarray, keys: np.ndarray, kind: int) -> np.ndarray:
    """Levels of ``keys``: the filter is asked for one level after another until one is missing."""
    size, out, live, j = np.uint64(8 * len(data)), np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
    while len(live):
        g = entry(keys[live], kind, j)
        for i in range(PROBES):
            at = places(g, size, i)
            hit = (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            live, g = live[hit], g[hit]
        out[live] = j
        j += 1
    return out


def answered(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """What ``served`` has of a segment. The filter is asked once for each distinct n-gram, however many lots have it, so that
    a run costs little besides its own bytes."""
    found = {kind: merged(rows, kind) for kind in (WORDS, PAIRS)}
    counted = {kind: (keys[n > 0], n[n > 0]) for kind, (keys, n, _) in found.items()}
    data, n = filled(counted, bits), counted[WORDS][1]
    out = [(-1, int(rows["seg"].iloc[0]), FILTER, data.tobytes(), b"", int(n.sum()), len(n))]
    for kind, (keys, n, at) in found.items():
        levels, mine, to = probed(data, keys, kind)[at], rows[rows["kind"] == kind], 0
        for lot, raw in zip(mine["lot"], mine["keys"]):
            run = slice(to, to + len(raw) // WIDTH[kind])
            out.append((lot, out[0][1], kind, compress(levels[run].tobytes(), 3), packed(n[at[run]], 8) if kind == WORDS else b"", 0, 0))
            to = run.stop
    return pd.DataFrame(out, columns=["lot", "seg", "kind", "levels", "counts", "n_tokens", "n_words"])


def served(table: DataFrame, segments: int, bits: int) -> DataFrame:
    """The written table of segments: a row of kind FILTER for each, with its filter as ``levels``, its numbers of training
    tokens and of distinct words; and a row for each run that it was sent (lot, seg, kind) with the levels that probing
    gives and, of words, the exact counts."""

    grouped = runs(table, segments).groupBy("seg").applyInPandas(lambda rows: answered(rows, bits), "lot long, seg long, kind int, levels binary, counts binary, n_tokens long, n_words long")
    return written(grouped, "lm-segments")


class Model:
    """What workers need to score beside the levels: N, V, the number of training texts and the weights by context level."""

    def __init__(self, tokens: int, words: int, n_texts: int) -> None:
        self.tokens, self.words, self.n_texts = tokens, words, n_texts
        self.weights = np.zeros(65)

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def read(self, b: pa.RecordBatch, k: int) -> tuple[Lot, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A lot; of each token the level and count of its context, the count of the pair, the smoothed probability of
        the token alone; and the exact counts of the lot's words."""
        lot, told = Lot(b, k), sorted(b.column("told")[k].as_py(), key=lambda x: (x["kind"], x["seg"]))
        levels = [np.frombuffer(b"".join(decompress(x["levels"]) for x in told if x["kind"] == kind), np.uint8).astype(np.int64) for kind in (WORDS, PAIRS)]
        exact = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x["counts"], 8) for x in told if x["kind"] == WORDS)]).astype(np.int64)
        level, both = levels[WORDS][lot.which], middle(levels[PAIRS])[lot.whose]
        context = np.roll(level, 1)
        context[lot.bounds[:-1]] = level_of(np.array([self.n_texts]))[0]
        alone = (middle(level) + 0.5) / (self.tokens + 0.5 * (self.words + 1))
        return lot, context, middle(context), both, alone, exact


def histogram(table: DataFrame, model: Model) -> np.ndarray:
    """Training tokens by level of the context and by log of the pair's ratio to the token's own probability, without themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total = np.zeros((65, BINS), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                lot, level, context, both, alone, _ = model.read(b, k)
                ratio = np.minimum(1, np.maximum(both - 1, 0) / np.maximum(context - 1, 1)) / alone
                bins = np.where(ratio > 0, 1 + np.clip((np.log(np.maximum(ratio, 1e-30)) + 10) * 8, 0, BINS - 2).astype(int), 0)
                total += np.bincount((level * BINS + bins)[lot.training], minlength=65 * BINS).reshape(65, BINS)
        level, bins = np.nonzero(total)
        yield {"level": level, "bin": bins, "n": total[level, bins]}

    out = np.zeros((65, BINS))
    for level, k, n in arrow_map(table, run, "level int, bin int, n long").groupBy("level", "bin").sum("n").collect():  # at most 65 * BINS rows
        out[level, k] = n
    return out


def fitted(counts: np.ndarray) -> np.ndarray:
    """The weight of pairs for each level of the context, by expectation maximisation."""
    x = np.concatenate([[0], np.exp((np.arange(BINS - 1) + 0.5) / 8 - 10)])
    weight, total = np.full((65, 1), 0.5), np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(200):
        weight = (counts * weight * x / (weight * x + 1 - weight)).sum(axis=1, keepdims=True) / total
        weight = np.clip(weight, 0, 0.999)
    return weight.ravel()


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, lot: int = LOT, segment_bytes: int = SEGMENT) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``bits`` of filter an entry,
    about ``lot`` tokens a lot, ``segment_bytes`` of text a segment."""
    docs = picked(docs, id_col, text_col).withColumn("held_out", bucket(F.col("doc_id"), folds) == held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = lots(docs, lot)
    n_texts = table.agg(F.sum("n_train")).first()[0] or 0
    segments = served(table, max(4, -(-size // segment_bytes)), bits)
    tokens, words = segments.filter(F.col("kind") == FILTER).agg(F.sum("n_tokens"), F.sum("n_words")).first()
    model = Model(tokens or 0, words or 0, n_texts)
    told = segments.filter(F.col("kind") != FILTER).groupBy("lot").agg(F.collect_list(F.struct("kind", "seg", "levels", "counts")).alias("told"))
    table = written(table.join(told, "lot").drop("lot"), "lm-told", instead_of=table)
    model.weights = fitted(histogram(table, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for k in range(b.num_rows):
                lot, level, context, both, alone, exact = model.read(b, k)
                weight = model.weights[level]
                score = np.log10(weight * np.minimum(1, both / np.maximum(context, 1)) + (1 - weight) * alone)
                yield {
                    "doc_id": b.column("ids")[k].values, "held_out": b.column("held")[k].values, "n_tokens": np.diff(lot.bounds), "n_known": sums((exact > 0).astype(np.int64)[lot.which], lot.bounds),
                    "base_score": sums(model.log_base(exact)[lot.which], lot.bounds), "score": sums(score, lot.bounds),
                }

    kinds = [StructField("doc_id", docs.schema["doc_id"].dataType), *docs.sparkSession.createDataFrame([], "held_out boolean, n_tokens long, n_known long, base_score double, score double").schema]
    out = arrow_map(table, run, StructType(kinds))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
