import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import crf
from quire.llm.words import RUNS, tokenize

from .helpers import docs, hard


def test_marginals_equal_enumeration():
    chance = np.random.default_rng(0)
    score, move = chance.normal(size=11), chance.normal(size=(2, 2))
    start, size = np.array([0, 4, 5, 10]), np.array([4, 1, 5, 1])
    ahead, back = crf.messages(score, start, size, move)
    for s, n in zip(start, size):
        weight = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(score[s + k] * t for k, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            for k, t in enumerate(tags):
                weight[k, t] += w
        assert np.allclose((ahead + back)[s : s + n], np.log(weight[:, 1] / weight[:, 0]))


def test_chains_end_at_sentences_lines_texts_and_length():
    t = tokenize(pa.array(["One two. Three\nfour", "", "x " * 600]), RUNS)
    start, size = crf.chains(t)
    words = [[t.data[a:b].tobytes().decode() for a, b in zip(t.start[s : s + n], t.end[s : s + n])] for s, n in zip(start, size)]
    assert words[:3] == [["one", "two", "."], ["three"], ["four"]] and [len(w) for w in words[3:]] == [256, 256, 88]


@pytest.fixture(scope="module")
def labelled(spark):
    chance = np.random.default_rng(4)
    plain = np.array([f"word{k}" for k in range(300)])
    bad = np.array(["idiot", "moron", "trash"])
    texts, toxic = [], []
    for k in range(600):
        words = chance.choice(plain, 60)
        if k % 3 == 0:
            words[chance.integers(0, 60, 3)] = chance.choice(bad, 3)
        texts.append(" ".join(words) + ".")
        toxic.append(int(k % 3 == 0))
    return docs(spark, texts), spark.createDataFrame([*((k, 1, y, 0) for k, y in enumerate(toxic)), (None, 1, 1, 0), (5, None, None, 0), (9999, 0, 1, 0)], "doc_id bigint, quality int, toxic int, text int"), toxic


def test_toxic_documents_and_their_spans_are_found(spark, labelled):
    df, labels, toxic = labelled
    rows = crf.toxic(df, crf.train(df, labels), carry=F.struct("*")).collect()
    assert sum(r.predicted == toxic[r.doc_id] for r in rows) >= 0.98 * len(rows)
    for r in rows:
        assert r.row.text is not None and r.row.key == "b"
        for s in r.spans if r.predicted else ():
            assert r.row.text[s.start : s.end].split()[0].strip(".") in ("idiot", "moron", "trash")


def test_hard_rows(spark, labelled):
    df, labels, _ = labelled
    field = crf.train(df, labels)
    ids, texts = hard()
    got = crf.toxic(docs(spark, texts, ids), field).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)
    score = {t or "": r.score for r, t in zip(sorted(got, key=lambda r: repr(r.doc_id)), [t for _, t in sorted(zip(ids, texts), key=lambda x: repr(x[0]))])}
    assert all(0 <= r.score <= 1 for r in got) and score[""] < 0.3
    assert crf.toxic(docs(spark, []), field).collect() == []


def test_without_labels(spark):
    df = docs(spark, ["a b", None])
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {round(r.score, 6) for r in crf.toxic(df, crf.train(df, empty)).collect()} == {0.0}
    ones = spark.createDataFrame([(k, 1) for k in range(8)], "doc_id bigint, toxic int")
    assert {round(r.score, 6) for r in crf.toxic(df, crf.train(df, ones)).collect()} == {1.0}
