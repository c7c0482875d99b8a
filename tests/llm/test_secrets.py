import random
import re

from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.secrets import RULES, Rule, find_secrets, redacted

from .helpers import docs, hard

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, g, n) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[g]) >= n]
    return sorted(found)


def base(rows):
    return sorted(((r.doc_id, [(s.start, s.rank, s.end, s.kind) for s in r.spans if s.rank < 3]) for r in rows), key=repr)


def test_base_spans_equal_brute_force(spark):
    chance = random.Random(6)
    parts = ["token = ", 'API_KEY": "', "secret:", "password=", "Passwd = '", "AKIA", "A" * 18, "abcdef0123456789" * 2, "é日", " ", "x", "0af", "=", "token=token: abcdefgh", "secret=token: abcdefgh", "AKIAAKIA" + "Q" * 14, "\n", '"']
    texts = ["".join(chance.choices(parts, k=chance.randint(1, 14))) for _ in range(300)] + ["deadbeef" * 900, "𝒳 token=abcdef"]
    rows = find_secrets(docs(spark, texts))[0].collect()
    assert base(rows) == sorted(((k, brute(t)) for k, t in enumerate(texts)), key=repr)


def test_hard_rows(spark):
    ids, texts = hard()
    texts[3] = "my token = " + "f" * 30
    rows = find_secrets(docs(spark, texts, ids))[0].collect()
    assert base(rows) == sorted(((i, brute(t)) for i, t in zip(ids, texts)), key=repr)
    assert find_secrets(docs(spark, []))[0].collect() == []


def test_only_unseen_pairs_of_blob_and_rule_are_scanned(spark):
    first = docs(spark, ["token = abcdefgh", "clean"])
    _, ledger = find_secrets(first)
    # a mark in the ledger shows that its spans are taken and not found anew
    marked = ledger.withColumn("spans", F.when(F.size("spans") > 0, F.array(F.struct(F.lit(7).alias("start"), F.lit(0).alias("rank"), F.lit(9).alias("end"), F.lit("assign").alias("kind")))).otherwise(F.col("spans")))
    again, grown = find_secrets(docs(spark, ["token = abcdefgh", "clean", "token = abcdefgh", "secret: 12345678"]), marked)
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in again.collect()} == {0: [(7, 9)], 1: [], 2: [(7, 9)], 3: [(0, 16)]}
    assert grown.count() == 3 and all(len(r.rules) == len(RULES) for r in grown.collect())
    changed = (Rule("assign", RULES[0].pattern, 2, 5), *RULES[1:])
    newer, _ = find_secrets(first, marked, changed)
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in newer.collect()}[0] == [(0, 16)]
    kept = find_secrets(docs(spark, ["clean"]), marked)[1]
    assert kept.count() == 2


def test_redaction(spark):
    row = spark.createDataFrame([("ab token=abcdefgh cd",)], "text string").select(
        redacted(F.col("text"), F.from_json(F.lit('[{"start":3,"end":17},{"start":9,"end":12},{"start":15,"end":18}]'), "array<struct<start:int,end:int>>")).alias("t"), redacted(F.col("text"), F.array().cast("array<struct<start:int,end:int>>")).alias("u")
    )
    assert tuple(row.first()) == ("ab [SECRET]cd", "ab token=abcdefgh cd")


def test_without_a_broadcast_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    test_only_unseen_pairs_of_blob_and_rule_are_scanned(spark)
