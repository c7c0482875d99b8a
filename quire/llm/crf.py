"""Toxic spans by a linear-chain conditional random field over tokens, and document scores from its marginals.

Tokens are runs of letters and digits or of other characters, in lower case; chains end with a sentence or line and hold
``CHAIN`` tokens at most. A token's features are its whole form and its first 4, 6 and 8 bytes, hashed. Labels mark
documents, so tokens for training are labelled from them: in a toxic document, those with a feature that is many
times more frequent in toxic documents than in others. The field is fitted by its exact likelihood (forward-backward,
Adagrad) on a bounded sample: ``ROWS`` documents of each label of at most ``BYTES`` bytes. A logistic model over the
largest marginal, the sum of marginals of a document and its share of the tokens turns them into a probability.

Scoring is narrow and reads whole texts: one pass, forward and backward messages for all chains of a batch at once.

Null and empty texts have no tokens and get the score of a document without a toxic token. Repeated rows get a row
each; extra columns are carried through in one struct where asked for, else ignored. Without labels of both values every
score is the share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bucket
from .labels import sample
from .words import MARK, ONE, RUNS, Tokens, hashed, mix, slices, sums, tokenize

ROWS, BYTES = 1200, 1 << 16
CHAIN, SLOTS = 256, 1 << 21
PREFIXES = (4, 6, 8)
ROUNDS = 30
#: A feature labels tokens if it is in at least this many toxic documents and this share of them, and so many times more
#: frequent there than in others.
SEEN, SHARE, RATIO = 4, 0.015, 25.0


def features(t: Tokens) -> np.ndarray:
    """Slots of the features of every token, a row per kind of feature."""
    kinds = [t.hashes(), *(hashed(t.data, t.start, np.minimum(t.end, t.start + n)) ^ np.uint64(0x9E3779B97F4A7C15 * n & (1 << 64) - 1) for n in PREFIXES)]
    return np.stack([(h >> np.uint64(20)).astype(np.int32) & np.int32(SLOTS - 1) for h in kinds])


def chains(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each chain of tokens."""
    n = len(t.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.cumsum(t.data == 10)
    new = np.ones(n, bool)
    first = t.data[t.start]
    ends = (RUNS[first] == MARK) & ((first == 46) | (first == 33) | (first == 63))
    new[1:] = ends[:-1] | (lines[t.start[1:]] != lines[t.end[:-1] - 1])
    new[t.bounds[:-1][t.bounds[:-1] < n]] = True
    start = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    start = np.flatnonzero(place % CHAIN == 0)
    return start, np.diff(np.append(start, n))


def step(x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log odds after a move, of log odds before it."""
    return np.logaddexp(move[0, 1], move[1, 1] + x) - np.logaddexp(move[0, 0], move[1, 0] + x)


def messages(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the forward message at each token, and of the backward message; all chains advance together."""
    order = np.argsort(-size, kind="stable")
    first, length = start[order], size[order]
    ahead, back = score.copy(), np.zeros_like(score)
    for k in range(1, int(length[0]) if len(length) else 0):
        at = first[: np.searchsorted(-length, -k)] + k
        ahead[at] += step(ahead[at - 1], move)
    last = first + length - 1
    for k in range(1, int(length[0]) if len(length) else 0):
        at = last[: np.searchsorted(-length, -k)] - k
        back[at] = step(score[at + 1] + back[at + 1], move.T)
    return ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    move: np.ndarray
    #: The logistic model: weights of the document's features, and its constant.
    document: np.ndarray

    def marginals(self, t: Tokens) -> np.ndarray:
        """Log odds that a token is toxic."""
        score = self.bias + sum(self.weights[row].astype(np.float64) for row in features(t))
        start, size = chains(t)
        ahead, back = messages(score, start, size, self.move)
        return ahead + back

    def scores(self, odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(document_features(odds, bounds) @ self.document)


def document_features(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log odds of the likeliest token, logs of the expected number of toxic tokens and of their share, and 1."""
    n = len(bounds) - 1
    most = np.full(n, -12.0)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        most[some] = np.maximum.reduceat(odds, bounds[:-1][some])
    expected = sums(np.where(odds > -4, sigmoid(odds), 0.0), bounds)
    return np.stack([np.clip(most, -12, 12), np.log1p(expected), np.log1p(200 * expected / (np.diff(bounds) + 20)), np.ones(n)], axis=1)


def families(t: Tokens, seed: int) -> np.ndarray:
    """A number for each text that near copies mostly share: the place of its least hash of three tokens in a row."""
    h = t.hashes()
    three = mix(mix(h * ONE ^ np.roll(h, 1)) * ONE ^ np.roll(h, 2) ^ np.uint64(seed))
    least = np.arange(len(t.bounds) - 1).astype(np.uint64)
    some = np.flatnonzero(np.diff(t.bounds) >= 3)
    if len(some):
        # the first two tokens of a text would reach into the one before
        three[np.concatenate([t.bounds[:-1][some], t.bounds[:-1][some] + 1])] = np.uint64((1 << 64) - 1)
        least[some] = np.minimum.reduceat(three, t.bounds[:-1][some])
    return np.unique(least, return_inverse=True)[1]


def token_labels(f: np.ndarray, size: int, t: Tokens, y: np.ndarray) -> np.ndarray:
    """``f``: numbers below ``size`` of the features of each token. 1 for each token of a toxic document with a telling feature. Near copies count once, so that what only they share
    doesn't tell."""
    doc = np.repeat(np.arange(len(y)), np.diff(t.bounds))
    bad = y[doc] == 1

    def spread(of: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """For each feature, among how many different values of ``of`` it occurs."""
        total = np.zeros(size)
        for row in f:
            total += np.bincount(np.unique(of[doc[kept]] * size + row[kept]) % size, minlength=size)
        return total

    toxic = np.minimum.reduce([spread(families(t, k), bad) for k in (1, 2, 3)])
    clean = spread(np.arange(len(y)), ~bad)
    telling = (toxic >= max(SEEN, SHARE * y.sum())) & ((toxic + 0.5) / (y.sum() + 1) >= RATIO * (clean + 0.5) / ((1 - y).sum() + 1))
    return (telling[f].any(axis=0) & bad).astype(np.float64)


def fit(texts: list[str], y: np.ndarray) -> Field:
    """The field and the document model for labelled texts."""
    if len(set(y.tolist())) < 2:
        p = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return Field(np.zeros(SLOTS, np.float32), -8.0, np.zeros((2, 2)), np.array([0, 0, 0, np.log(p / (1 - p)) if len(y) else -40.0]))
    t = tokenize(pa.array(texts, pa.large_string()), RUNS)
    start, size = chains(t)
    used, f = np.unique(features(t), return_inverse=True)  # the sample's features alone, so that memory follows the sample
    f, n = f.reshape(1 + len(PREFIXES), -1).astype(np.int32), len(used)
    tag = token_labels(f, n, t, y)
    weights, bias, move = np.zeros(n), -2.0, np.zeros((2, 2))
    seen_w, seen_b, seen_m = np.full(n, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    inner = np.ones(len(tag), bool)
    inner[start] = False
    right = np.flatnonzero(inner)
    left = right - 1
    told = np.array([[((tag[left] == a) & (tag[right] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(ROUNDS):
        score = bias + sum(weights[row] for row in f)
        ahead, back = messages(score, start, size, move)
        off = tag - sigmoid(ahead + back)
        before, into = ahead[left].astype(np.float32), (score + back)[right].astype(np.float32)
        both = [[a * before + b * into + np.float32(move[a, b]) for b in (0, 1)] for a in (0, 1)]
        whole = np.logaddexp(np.logaddexp(both[0][0], both[0][1]), np.logaddexp(both[1][0], both[1][1]))
        g_move = told - np.array([[np.exp(x - whole).sum(dtype=np.float64) for x in row] for row in both])
        del before, into, both, whole
        g = -0.05 * weights
        for row in f:
            g += np.bincount(row, weights=off, minlength=n)
        g_bias = off.sum()
        seen_w += g * g
        seen_b += g_bias * g_bias
        seen_m += g_move * g_move
        weights += 0.7 * g / np.sqrt(seen_w)
        bias += 0.7 * g_bias / np.sqrt(seen_b)
        move += 0.3 * (g_move - 0.1 * move) / np.sqrt(seen_m)
    del f, left, right, seen_w
    table = np.zeros(SLOTS, np.float32)
    table[used] = weights
    field = Field(table, float(bias), move, np.zeros(4))
    x = document_features(field.marginals(t), t.bounds)
    field.document = logistic(x, y)
    return field


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * w), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = ROWS, most: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fits on at most ``rows`` documents of each label, of at most ``most`` bytes, outside the held-out fold."""
    chosen = sample(labels, "toxic", folds, held, rows)
    texts = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) <= most)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return fit([r.text for r in found], np.array([r.y for r in found], np.int64))


def toxic(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: Column | None = None) -> DataFrame:
    """Per document row: doc_id, score, predicted, spans (start, end: code points of tokens likelier toxic than not,
    neighbours joined) and, if given, the column ``carry`` as ``row`` and the text as ``text``, null where it was."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([carry.alias("row")] if carry is not None else []))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id"] + ["row", "text"] * (carry is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for part in slices(b):
                t = tokenize(pc.fill_null(part.column("text"), ""), RUNS)
                odds = shared.value.marginals(t)
                score = shared.value.scores(odds, t.bounds)
                yield {x: part.column(x) for x in names} | {"score": score, "predicted": (score >= threshold).astype(np.int32), "spans": spans(t, odds)}

    return arrow_map(df, run, "score double, predicted int, spans array<struct<start:int,end:int>>", tuple(names))


def spans(t: Tokens, odds: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(t.bounds) - 1)]
    hot = np.flatnonzero(odds > 0)
    if not len(hot):
        return out
    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    doc = np.searchsorted(t.bounds, hot, side="right") - 1
    origin = points[t.offsets[doc]]
    before = None
    for k, d, a, b in zip(hot.tolist(), doc.tolist(), (points[t.start[hot]] - origin).tolist(), (points[t.end[hot]] - origin).tolist()):
        if before == (k - 1, d):
            out[d][-1]["end"] = b
        else:
            out[d].append({"start": a, "end": b})
        before = (k, d)
    return out


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", text.alias("spans"))
