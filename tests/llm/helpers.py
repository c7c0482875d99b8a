"""Small tables with every hard case: nulls, empty and long texts, ties and repeated rows, extra columns with clashing names."""

import random

LONG = " ".join(f"word{k % 977} other{k % 31}" for k in range(6000))
#: Columns whose names the operators use inside.
EXTRA = "text_hash string, key string, hits string, n int, row int, digest string, x int"


def docs(spark, texts, ids=None):
    """doc_id, text and columns with clashing names."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "a", "b", "c", k, k, "d", k) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}")


def hard(seed=1):
    """Ids and texts with nulls, empty, blank and long texts and repeated rows."""
    chance = random.Random(seed)
    words = ["the", "of", "and", "stone", "river", "Ärger", "naïve", "x1", "don't", "3.14", "日本", "a"]
    texts = [" ".join(chance.choices(words, k=chance.randint(1, 40))) for _ in range(30)]
    texts += [None, "", "   ", "\n\t ", LONG, texts[0], texts[1], texts[1], "Word"]
    ids = [*range(len(texts) - 2), None, 0]
    return ids, texts


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
