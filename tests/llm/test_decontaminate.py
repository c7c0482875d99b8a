import random
import re

from quire.llm import common, native
from quire.llm.decontaminate import contamination

from .helpers import docs, hard


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(ids, texts, items):
    out = []
    for i, t in zip(ids, texts):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v and item is not None else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def run(spark, ids, texts, items):
    bench = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id bigint, text string, key int, hits string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in contamination(docs(spark, texts, ids), bench).collect()), key=repr)


def test_planted_passages(spark):
    chance = random.Random(11)
    word = lambda: chance.choice(["a", "b", "c", "the", "9", "é", f"w{chance.randint(0, 50)}"])
    items = [(k, " ".join(word() for _ in range(chance.choice((1, 3, 12, 13, 14, 30, 60))))) for k in range(12)] + [(50, "Of the, old"), (51, "of the OLD"), (None, "a b c"), (60, None), (61, "--")]
    texts = []
    for _ in range(60):
        t = [word() for _ in range(chance.randint(0, 60))]
        for _ in range(chance.randint(0, 3)):
            v = split(chance.choice(items)[1])
            a = chance.randint(0, max(0, len(v) - 1))
            at = chance.randint(0, len(t))
            t[at:at] = v[a : a + chance.choice((5, 12, 13, 14, 20, 99))]
        texts.append(chance.choice((" ", "-", ", ")).join(t))
    texts += ["a a a a a a a a a a a a a a a a a a a a", "of the old"]
    items += [(70, "a " * 13), (71, "a " * 15)]
    assert run(spark, [*range(len(texts))], texts, items) == brute([*range(len(texts))], texts, items)


def test_every_shared_window_is_found(spark):
    chance = random.Random(1)
    item = [chance.choice("abc") for _ in range(40)]
    texts = [" ".join([*(chance.choice("abc") for _ in range(20)), *item[k : k + 13], *(chance.choice("abc") for _ in range(20))]) for k in range(28)]
    items = [(1, " ".join(item))]
    assert run(spark, [*range(28)], texts, items) == brute([*range(28)], texts, items)


def test_hard_rows(spark):
    ids, texts = hard()
    items = [(1, texts[4]), (2, " ".join(texts[-5].split()[100:120])), (3, "word")]
    assert run(spark, ids, texts, items) == brute(ids, texts, items)
    assert run(spark, ids, texts, []) == brute(ids, texts, [])
    assert run(spark, [], [], items) == []


def test_without_a_broadcast_and_with_a_full_bitmap_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(native, "BITS", 64)
    test_planted_passages(spark)
