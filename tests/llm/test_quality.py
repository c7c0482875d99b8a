import numpy as np
import pyarrow as pa

from quire.llm import quality as q
from quire.llm.words import RUNS, tokenize

from .helpers import docs, hard


def test_neighbour_sums_equal_brute_force():
    t = tokenize(pa.array(["a b c d a!", "", "b", "c c"]), RUNS, lower=False)
    slot, (plus, minus) = q.slots(t), q.index()
    expected = np.zeros((q.SLOTS, q.WIDTH), int)
    for a, b in zip(t.bounds, t.bounds[1:]):
        for i in range(a, b):
            for j in range(max(a, i - q.REACH), min(b, i + q.REACH + 1)):
                if i != j:
                    expected[slot[i], plus[slot[j]]] += 1
                    expected[slot[i], minus[slot[j]]] -= 1
    assert (q.neighbours(slot, t.bounds, plus, minus).reshape(q.SLOTS, q.WIDTH) == expected).all()


def test_calibration_softens_an_overfit_network():
    chance = np.random.default_rng(0)
    x, y = chance.normal(size=(80, 65)), chance.integers(0, 2, 80)
    assert q.fit(x, y).temperature > 1


def labelled(spark):
    chance = np.random.default_rng(2)
    words = np.array([f"word{k}" for k in range(200)])
    texts = [" ".join(chance.choice(words, 80)) for _ in range(400)]
    texts = [t if k % 2 else t.replace(" ", "### ") for k, t in enumerate(texts)]
    rows = [*((k, k % 2, 0, 1) for k in range(400)), (None, 1, 0, 0), (3, None, None, 0)]
    return docs(spark, texts), spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, x int")


def test_held_out_accuracy(spark):
    df, labels = labelled(spark)
    rows = q.quality(df, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and len(held) > 40
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_hard_rows(spark):
    df, labels = labelled(spark)
    ids, texts = hard()
    both = df.unionByName(docs(spark, texts, [None if i is None else i + 1000 for i in ids]))
    rows = q.quality(both, labels).collect()
    assert len(rows) == 400 + len(ids) and all(0 <= r.score <= 1 for r in rows)
    assert q.quality(docs(spark, []), labels).collect() == []


def test_without_labels(spark):
    df = docs(spark, ["a b", None])
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {round(r.score, 6) for r in q.quality(df, empty).collect()} == {0.0}
