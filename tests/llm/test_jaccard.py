import random
import re

from quire.llm import jaccard
from quire.llm.jaccard import similar_documents

from .helpers import docs, hard


def brute(ids, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(texts)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(n)]
    low = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [ids[j] for j in seen if ids[j] is not None]
        low.append(min(known) if known else None)
    return sorted(((i, len(s), len(k), c) for i, s, k, c in zip(ids, sets, near, low)), key=repr)


def rows(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_families_of_near_copies(spark):
    chance = random.Random(5)
    texts = []
    shared = [f"shared{k}" for k in range(60)]
    for _ in range(12):
        base = [f"w{chance.randint(0, 400)}" for _ in range(chance.randint(20, 160))]
        for _ in range(chance.randint(1, 12)):
            copy = list(base)
            for _ in range(chance.randint(0, 6)):
                copy[chance.randrange(len(copy))] = f"e{chance.randint(0, 99)}"
            if chance.random() < 0.3:
                copy = copy[: int(len(copy) * chance.choice((0.8, 0.83, 0.9)))]
            if chance.random() < 0.3:
                copy = shared + copy
            texts.append(" ".join(copy).title() if chance.random() < 0.2 else "  ".join(copy))
    texts += [texts[0]] * 5 + [texts[3].upper()]
    ids = [*range(len(texts))]
    chance.shuffle(ids)
    assert rows(similar_documents(docs(spark, texts, ids))) == brute(ids, texts)


def test_exact_threshold(spark):
    # sets of 9 and 9 shingles with 8 in common are at 0.8; of 8 and 8 with 7 below it
    a = [f"a{k}" for k in range(13)]
    texts = [" ".join(a), " ".join([*a[:-1], "z"]), " ".join(a[:12]), " ".join([*a[:11], "y"])]
    assert rows(similar_documents(docs(spark, texts))) == brute([*range(4)], texts)


def test_hard_rows(spark):
    ids, texts = hard()
    assert rows(similar_documents(docs(spark, texts, ids))) == brute(ids, texts)
    assert rows(similar_documents(docs(spark, [None, "", None], [None, None, 3]))) == brute([None, None, 3], [None, "", None])
    assert rows(similar_documents(docs(spark, []))) == []


def test_large_family_meets_few_groups(spark, monkeypatch):
    # near copies with different texts ask large groups, and of two groups only one asks the other
    chance = random.Random(8)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(400):
        copy = list(base)
        for k in chance.sample(range(150), chance.randint(1, 5)):
            copy[k] = f"e{chance.randint(0, 999)}"
        texts.append(" ".join(copy))
    rows_of, write = {}, jaccard.written

    def counted(df, name, **more):
        out = write(df, name, **more)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    ids = [*range(400)]
    expected = brute(ids, texts)
    assert rows(similar_documents(docs(spark, texts, ids))) == expected
    assert rows_of["links"] == sum(r[2] for r in expected) // 2  # each link once
    assert rows_of["met"] * 25 < 400 * 400
