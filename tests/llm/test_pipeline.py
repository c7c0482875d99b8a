import numpy as np
import pytest

import corpus_pipeline

from .helpers import docs
from .test_decontaminate import brute as hits
from .test_jaccard import brute as similar

OWN = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    chance = np.random.default_rng(9)
    words, bad = np.array([f"word{k}" for k in range(400)]), np.array(["idiot", "moron", "trash"])
    text = lambda: " ".join(chance.choice(words, 60))
    texts = [text() for _ in range(240)]
    for k in range(0, 240, 3):
        w = texts[k].split()
        for j in chance.integers(0, 60, 4):
            w[j] = str(chance.choice(bad))
        texts[k] = " ".join(w)
    passage = " ".join(f"bench{k}" for k in range(30))
    clean = [texts[k] for k in range(240) if k % 3]
    texts += [clean[0], clean[1] + " more", clean[1], None, "", "", text() + " " + passage, text() + " token = abcdef123456 end", "x"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, OWN).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2), int(k % 3 == 0)) for k in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]

    def run(name, df):
        out = stages[name](spark, df, folder)
        return out, {r[0]: r for r in out.collect()}

    df, rows = run("toxicity", df)
    assert set(rows) == {k for k in before if k >= 240 or k % 3} and df.columns == OWN.replace(" bigint", "").replace(" string", "").split(", ")
    df, kept = run("near_duplicates", df)
    ids = sorted(rows)
    alike = similar(ids, [rows[i].text for i in ids])
    assert set(kept) == {i for i, _, _, c in alike if c == i}
    df, clean = run("decontamination", df)
    told = hits(sorted(kept), [kept[i].text for i in sorted(kept)], [(1, " ".join(f"bench{k}" for k in range(30)))])
    assert set(clean) == {i for i, n, h, _ in told if not (h > 0 and 20 * h >= n)} and len(clean) < len(kept)
    df, safe = run("secrets", df)
    assert set(safe) == set(clean)
    assert [i for i in clean if clean[i].text != safe[i].text] == [247] and safe[247].text.endswith(" [SECRET] end") and safe[247].n_chars == len(safe[247].text)
    _, told = run("sentencepiece", df)
    assert set(told) == set(safe) and all(r.exact for r in told.values())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and 150 < out.count() < 249


def test_hard_rows_and_clashing_columns_pass_every_stage(spark, folder):
    df = docs(spark, [None, "", "a b", "a b", "token = abcdef123", "a b c d e f g", "a b c d e f g"], [None, 1, 2, 2, None, 5, 6])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), df.schema)
    assert sorted((repr(r.doc_id), r.text) for r in df.collect() if r.text is not None) == sorted([("1", ""), ("2", "a b"), ("None", "[SECRET]"), ("5", "a b c d e f g")])
    empty = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_a_passage_in_a_long_document_is_found(spark, folder):
    rest = " ".join(f"own{k}" for k in range(2000))
    passage = " ".join(f"bench{k}" for k in range(13))
    df = docs(spark, [rest, f"{rest} {passage}", f"{passage} {rest}", f"{rest} " + passage.rpartition(" ")[0]])
    assert [r.doc_id for r in corpus_pipeline.remove_contaminated(spark, df, folder).orderBy("doc_id").collect()] == [0, 3]
