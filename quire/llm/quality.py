"""Document quality: random-indexing word vectors, pooled per document, through a small network with calibrated output.

Every token form falls in one of ``SLOTS`` slots and has a sparse index vector of +1 and -1 from its hash. A slot's word
vector is the sum of the index vectors of all neighbours of its tokens up to ``REACH`` away, over the whole corpus:
tasks add up their own table of fixed size, and tables are summed block by block. A document's vector is the mean
of its tokens' scaled word vectors, with their spread and its length. A network of two layers, in numpy, is fitted on a
bounded sample of ``ROWS`` labelled documents of each label; a quarter of it, left out of the fit, sets the temperature.

Vectors of all documents are a written table, from which both sample and scores are taken. Null and empty texts have the
zero vector and the score that the network gives it. Repeated rows and null ids stay, extra columns are ignored, texts
are read whole. Without labels of both values every score is the share of good labels, 0 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bucket, picked, written
from .labels import sample
from .words import RUNS, Tokens, mix, slices, tokenize

SLOTS, WIDTH, REACH = 1 << 15, 32, 2
BLOCKS = 64
ROWS, HIDDEN = 6000, 24
STEPS, BATCH = 1500, 256


def slots(t: Tokens) -> np.ndarray:
    return (t.hashes() >> np.uint64(49)).astype(np.int64)


def index() -> tuple[np.ndarray, np.ndarray]:
    """The place of the +1 and of the -1 in each slot's index vector."""
    h = mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(1))
    plus = (h % np.uint64(WIDTH)).astype(np.int64)
    return plus, (plus + 1 + ((h >> np.uint64(32)) % np.uint64(WIDTH - 1)).astype(np.int64)) % WIDTH


def neighbours(slot: np.ndarray, bounds: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Sums of index vectors of neighbours, by slot."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    up, down = [], []
    for k in range(1, REACH + 1):
        same = np.flatnonzero(doc[k:] == doc[:-k])
        for a, b in ((slot[same], slot[same + k]), (slot[same + k], slot[same])):
            up.append(a * WIDTH + plus[b])
            down.append(a * WIDTH + minus[b])
    return np.bincount(np.concatenate(up), minlength=SLOTS * WIDTH) - np.bincount(np.concatenate(down), minlength=SLOTS * WIDTH)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Scaled word vectors of all slots, learned from every text of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        (plus, minus), total = index(), np.zeros(SLOTS * WIDTH, np.int64)
        for b in batches:
            for part in slices(b):
                t = tokenize(part.column("text"), RUNS, lower=False)
                total += neighbours(slots(t), t.bounds, plus, minus)
        if total.any():
            yield {"block": [*range(BLOCKS)], "held": [x.tobytes() for x in total.reshape(BLOCKS, -1)]}

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS * WIDTH // BLOCKS, np.int64)
        for x in rows["held"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "held": [total.tobytes()]})

    parts = arrow_map(docs.select("text"), run, "block int, held binary")
    # two rounds, so that no task has to hold what all tasks send for a block
    some = parts.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("block", "lot").applyInPandas(add, "block int, held binary")
    table = np.zeros((BLOCKS, SLOTS * WIDTH // BLOCKS))
    for block, held in some.groupBy("block").applyInPandas(add, "block int, held binary").collect():  # BLOCKS rows of fixed size
        table[block] = np.frombuffer(held, np.int64)
    table = table.reshape(SLOTS, WIDTH)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(t: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the log of its length."""
    n = np.diff(t.bounds)
    out = np.zeros((len(n), 2 * WIDTH + 1), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        rows = vectors[slots(t)]
        at = t.bounds[:-1][some]
        mean = np.add.reduceat(rows, at, axis=0) / n[some, None]
        np.multiply(rows, rows, out=rows)
        square = np.add.reduceat(rows, at, axis=0) / n[some, None]
        out[some, :WIDTH] = mean
        out[some, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -1] = np.log1p(n[some]) / 8
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` divides the log odds."""

    shift: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.shift) / self.scale, np.ones(len(x))]
        return np.c_[np.tanh(z @ self.first), np.ones(len(x))] @ self.second

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.odds(x) / self.temperature))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on three quarters of the rows; the temperature that suits the last quarter best."""
    width = x.shape[1] if x.ndim == 2 else 2 * WIDTH + 1
    if len(set(y.tolist())) < 2:
        p = y.mean() if len(y) else 0.0
        second = np.zeros(HIDDEN + 1)
        second[-1] = np.log(max(p, 1e-9) / max(1 - p, 1e-9)) if len(y) else -40.0
        return Network(np.zeros(width), np.ones(width), np.zeros((width + 1, HIDDEN)), second, 1.0)
    chance = np.random.default_rng(7)
    order = chance.permutation(len(y))
    rest, own = order[: len(y) // 4], order[len(y) // 4 :]
    shift, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    net = Network(shift, scale, chance.normal(0, 1 / np.sqrt(width), (width + 1, HIDDEN)), np.zeros(HIDDEN + 1), 1.0)
    z = np.c_[(x - shift) / scale, np.ones(len(x))]
    held = [[np.zeros_like(w), np.zeros_like(w)] for w in (net.first, net.second)]
    for k in range(1, STEPS + 1):
        take = own[chance.integers(0, len(own), BATCH)]
        h = np.tanh(z[take] @ net.first)
        off = 0.5 * (1 + np.tanh(0.5 * (np.c_[h, np.ones(BATCH)] @ net.second))) - y[take]
        g2 = np.c_[h, np.ones(BATCH)].T @ off / BATCH + 1e-4 * net.second
        g1 = z[take].T @ (off[:, None] * net.second[:-1] * (1 - h * h)) / BATCH + 1e-4 * net.first
        for w, g, m in ((net.first, g1, held[0]), (net.second, g2, held[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            w -= 0.01 * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.999**k)) + 1e-8)
    odds = net.odds(x[rest]) if len(rest) else np.zeros(0)
    loss = lambda c: np.logaddexp(0, -np.where(y[rest] == 1, 1, -1) * odds / c).sum()
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss)) if len(rest) else 1.0
    return net


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    docs = picked(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for part in slices(b):
                x = pooled(tokenize(part.column("text"), RUNS, lower=False), shared.value)
                yield {"doc_id": part.column("doc_id"), "x": [v.tobytes() for v in x]}

    vectors = written(arrow_map(docs, run, "x binary", ("doc_id",)), "document-vectors")
    chosen = vectors.join(F.broadcast(sample(labels, "quality", folds, held, rows)), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in chosen], np.float64)
    net = docs.sparkSession.sparkContext.broadcast(fit(x, np.array([r.y for r in chosen], np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            if b.num_rows:
                p = net.value.scores(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64))
                yield {"doc_id": b.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    out = arrow_map(vectors, score, "score double, predicted int", ("doc_id",))
    return out.select("doc_id", (bucket(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
