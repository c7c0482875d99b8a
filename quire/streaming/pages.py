"""Pages of arriving chunks, each kept as its first chunk brought it, and documents merged as they grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, tokens

CHUNK = "doc_id bigint, idx int, md string, arrived timestamp"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks from Parquet files put into ``folder``."""
    return spark.readStream.schema(CHUNK).parquet(folder)


def first_pages(chunks: DataFrame, late: str = "1 hour") -> DataFrame:
    """doc_id, idx, page_no, block, arrived; a page that comes again within ``late`` is dropped, and its state goes after."""
    pages = tokens.page_blocks(chunks.withWatermark("arrived", late), keep=["idx", "arrived"])
    return pages.select("doc_id", "idx", "page_no", "block", "arrived").dropDuplicatesWithinWatermark(["doc_id", "page_no"])


def pages_by_hour(chunks: DataFrame, late: str = "1 hour") -> DataFrame:
    """How many pages arrived in each hour."""
    pages = tokens.page_blocks(chunks.withWatermark("arrived", late), keep=["arrived"])
    return pages.groupBy(F.window("arrived", "1 hour")).agg(F.count("*").alias("n_pages"))


def merged_batches(root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends a batch's chunks and writes anew the documents that it touches. A batch that is run again
    replaces its own files, so the result is the same."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("doc_id", "idx", "md").write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        every = spark.read.parquet(f"{root}/chunks").filter(F.col("batch") <= number)
        touched = every.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        latest = touched.groupBy("doc_id", "idx").agg(F.max_by("md", "batch").alias("md"))
        merge.merge_chunks(latest).write.option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").mode("overwrite").parquet(f"{root}/documents")

    return run
