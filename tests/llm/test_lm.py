import collections
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from zstandard import decompress

from quire.llm import lm
from quire.llm.words import BLANKS, tokenize

from .helpers import by_id, docs, hard


def test_words_are_cut_like_bytes_split():
    texts = ["a  b", "", " x", "y ", "é\x0bz\x1c", "Q" * 1000 + " " + "r" * 9, "ab", "\x85 c"]
    t = tokenize(pa.array(texts), BLANKS)
    h = t.hashes()
    words = [w for x in texts for w in x.encode().lower().split()]
    assert [t.data[a:b].tobytes() for a, b in zip(t.start, t.end)] == words
    assert np.diff(t.bounds).tolist() == [len(x.encode().split()) for x in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def expected(ids, texts):
    lines = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in ids]
    c = collections.Counter(w for words, h in zip(lines, held) if not h for w in words)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, h, w in zip(ids, held, lines)), key=repr)


def brute_scores(ids, texts):
    """The model's scores from plain counters: levels of exact counts in place of a filter."""
    lines = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [x for i, x in zip(ids, lines) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    one, two = collections.Counter(w for x in train for w in x), collections.Counter(p for x in train for p in zip(["^", *x], x))
    n, v = sum(one.values()), len(one)
    mid = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    alone = lambda w: (mid(one[w]) + 0.5) / (n + 0.5 * (v + 1))
    level = lambda h: (len(train) if h == "^" else one[h]).bit_length()
    whole = lambda h: mid(len(train) if h == "^" else one[h])
    table = np.zeros((65, lm.BINS))
    for x in train:
        for h, w in zip(["^", *x], x):
            r = min(1, max(mid(two[h, w]) - 1, 0) / max(whole(h) - 1, 1)) / alone(w)
            table[level(h), 1 + int(np.clip((math.log(r) + 10) * 8, 0, lm.BINS - 2)) if r > 0 else 0] += 1
    weight = lm.fitted(table)
    return [sum(math.log10(weight[level(h)] * min(1, mid(two[h, w]) / max(whole(h), 1)) + (1 - weight[level(h)]) * alone(w)) for h, w in zip(["^", *x], x)) for x in lines]


def test_base_and_score_equal_brute_force_in_lots_and_segments_of_any_size(spark):
    ids, texts = hard()
    df, want = docs(spark, texts, ids), sorted(zip(ids, [t or "" for t in texts], brute_scores(ids, texts)), key=lambda x: repr((x[0], x[2])))
    for more in ({}, {"lot": 40, "segment_bytes": 500}):
        rows = by_id(lm.lm_scores(df, bits=64, **more))
        assert sorted(((*r[:5], round(r[5], 6)) for r in rows), key=repr) == expected(ids, texts)
        assert np.allclose(sorted(r[6] for r in rows), sorted(x[2] for x in want))
        got = {r[0]: r[6] for r in rows if r[0] not in (0, None)}
        assert np.allclose([got[i] for i, _, _ in want if i in got], [x for i, _, x in want if i in got])


def test_a_filter_tells_too_much_but_never_too_little():
    chance = np.random.default_rng(3)
    keys = np.unique(chance.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = chance.integers(1, 5000, len(keys))
    data = lm.filled({lm.WORDS: (keys, counts)}, lm.BITS)
    off = lm.probed(data, keys, lm.WORDS).astype(int) - lm.level_of(counts)
    assert off.min() == 0 and (off > 0).mean() < 0.02
    assert (lm.probed(data, keys + np.uint64(1), lm.WORDS) > 0).mean() < 0.02 and not lm.probed(lm.filled({}, lm.BITS), keys, lm.PAIRS).any()


def test_empty_table_and_no_training(spark):
    assert lm.lm_scores(docs(spark, [])).collect() == []
    row = lm.lm_scores(docs(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_copies_of_training_texts_score_higher(spark):
    texts = [f"the {k} stones of river {k} are old and grey {k}" for k in range(200)]
    held = next(i for i in range(1000, 9999) if zlib.crc32(str(i).encode()) % 5 == 1)
    other = next(i for i in range(held + 1, 9999) if zlib.crc32(str(i).encode()) % 5 == 1)
    scrambled = "grey the old of river are stones and 7 7 7"
    got = {r.doc_id: r for r in lm.lm_scores(docs(spark, [*texts, texts[7], scrambled], [*range(200), held, other])).collect()}
    assert got[held].score > got[held].base_score and got[held].score > got[other].score


def test_a_segment_is_probed_once_however_many_lots_it_has(monkeypatch):
    chance, asked, probed = np.random.default_rng(2), [], lm.probed
    monkeypatch.setattr(lm, "probed", lambda data, keys, kind: (asked.append(len(keys)), probed(data, keys, kind))[1])
    rows, total = [], collections.Counter()
    for lot in range(40):
        keys, counts = np.unique(chance.integers(0, 1 << 40, 300) % 700).astype(np.uint64), chance.integers(0, 3, 300)
        counts = counts[: len(keys)]
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        rows.append((lot, 0, lm.WORDS, keys.tobytes(), lm.packed(counts)))
        rows.append((lot, 0, lm.PAIRS, np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), lm.packed(counts)))
    out = lm.answered(pd.DataFrame(rows, columns=["lot", "seg", "kind", "keys", "counts"]), 64)
    assert sum(asked) == 2 * len(total)
    told = {(r.lot, r.kind): r for r in out.itertuples()}
    assert told[-1, lm.FILTER].n_tokens == sum(total.values()) and told[-1, lm.FILTER].n_words == sum(n > 0 for n in total.values())
    data = np.frombuffer(told[-1, lm.FILTER].levels, np.uint8)
    for lot, _, kind, raw, _ in rows:
        keys = lm.hashes(raw, kind)
        assert np.frombuffer(decompress(told[lot, kind].levels), np.uint8).tolist() == probed(data, keys, kind).tolist()
        assert kind == lm.PAIRS or lm.unpacked(told[lot, kind].counts, 8).tolist() == [total[k] for k in keys.tolist()]
    assert len(out) == len(rows) + 1
