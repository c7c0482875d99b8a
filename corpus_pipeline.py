"""A corpus pipeline of five stages: each takes what its predecessor kept, written as Parquet and read again.

Rows are handled whole, in a struct that no operator looks into, so extra and clashing columns stay as they are. Rows with
null ids or texts are kept like others; rows that repeat in id and text collapse where near duplicates are removed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import crf, decontaminate, jaccard, pieces, secrets
from quire.llm.common import bounded, work_path, written


def row() -> F.Column:
    return F.struct("*")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keyed(docs: DataFrame) -> DataFrame:
    """Whole rows as ``row``, the text, and what names a row: its id and a hash of its text as ``key``, the same without nulls as ``k``."""
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return docs.select(row().alias("row"), key.alias("key"), F.col("text").alias("text")).withColumn("k", without_nulls(F.col("key")))


def without_nulls(key: F.Column) -> F.Column:
    return F.struct(F.coalesce(key["i"], F.lit(-1)), key["i"].isNull(), key["h"])


def chosen(told: DataFrame, name: str) -> DataFrame:
    """The names of an operator's rows ``told`` as a written table; broadcast within the bound, else whole rows are shuffled to it."""
    return bounded(written(told.select(without_nulls(F.col("doc_id")).alias("k")).distinct(), name), 60)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field doesn't predict toxic. It is fitted on the labelled documents of ``sf_dir``."""
    field = crf.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = F.struct(F.lit(0), *(F.col(quoted(c)) for c in docs.columns if c != "text"))  # the text goes beside it, once
    kept = crf.toxic(docs, field, carry=rest).filter("predicted = 0")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.{quoted(c)}") for c in docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id; of rows with one id, that with the smallest text hash."""
    rows = keyed(docs)
    groups = jaccard.similar_documents(rows, id_col="key")
    gone = chosen(groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "removed")
    again = chosen(groups.groupBy("doc_id").count().filter("count > 1"), "repeated")
    kept = rows.join(gone, "k", "left_anti")
    single = kept.join(again, "k", "left_anti").select("row")
    return single.unionByName(kept.join(again, "k", "left_semi").groupBy("k").agg(F.first("row").alias("row")).select("row")).select("row.*")


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of an item in common with the benchmark. Of items shorter than a window, which may be common
    words, the passages only count where they make up a twentieth of the words."""
    rows = keyed(docs)
    marked = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    whole = F.exists("spans", lambda s: s["last"] - s["first"] + 1 >= decontaminate.WINDOW)
    gone = chosen(marked.filter(whole | (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), "contaminated")
    return rows.join(gone, "k", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span that the scan finds replaced by a mark; n_chars follows."""
    found, _ = secrets.find_secrets(docs, carry=row())
    some = F.size("spans") > 0
    text = F.when(some, secrets.redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return found.select(F.col("row"), some.alias("some"), text.alias("clean")).select(
        *(F.col("clean").alias("text") if c == "text" else F.when(F.col("some"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"row.{quoted(c)}") for c in docs.columns)
    )


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's best segmentation, its digests and whether decoding gives the text back."""
    return pieces.digest(pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The conditional random field has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
