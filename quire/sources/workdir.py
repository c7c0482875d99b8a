"""A work folder as tables: chunk texts with usage, the manifest, document statistics, table repairs, outputs.

Chunks are written last-wins by document and chunk with the job's own commit, so a chunk is there whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_USAGE = "doc_id bigint, idx int, page_start int, page_end int, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, cost double, elapsed_seconds double"
MANIFEST = "doc_id bigint, pdf_mtime double, pdf_size bigint, total_pages int, pages_per_chunk int, max_pages int, model_id string, num_chunks int"
STATS = "doc_id bigint, doc_name string, pages int, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, cost double, chunks int, elapsed_seconds double"
FIX_STATS = "doc_id bigint, found int, fixed int, input_tokens bigint, output_tokens bigint, cost double, elapsed_seconds double, input_hash string"


def documents(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """Whole text files, in the order of their names: path, name, md. The suffix is told in any case of letters."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), F.col("value").alias("md")).orderBy("name")


def binary(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Files with their bytes, size and time: input of a page extractor."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*" + suffix).load(path)


def extract_pages(files: DataFrame, extractor) -> DataFrame:
    """path, page_no, pdf_text by ``extractor`` (bytes to a list of page texts), in Arrow batches: the edge to a PDF library."""

    def run(batches):
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b["path"], b["content"]) for k, t in enumerate(extractor(c), 1)]
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "page_no", "pdf_text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, pdf_text string")


def page_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Pages ``start`` to ``end`` of each document, as far as there are any."""
    return pages.filter(F.col("page_no").between(max(start, 1), end))


def output_path(source: str, folder: str | None = None) -> str:
    """Where a document's text goes: beside its source, or in ``folder``."""
    where, _, name = source.rpartition("/")
    return f"{folder.rstrip('/') if folder else where or '.'}/{name.rpartition('.')[0] or name}.md"


def _json(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED", multiLine=False)


def write_chunks(chunks: DataFrame, root: str) -> None:
    """doc_id, idx, md, context_tail; a run replaces the documents it has."""
    chunks.select("doc_id", "idx", "md", "context_tail").write.option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").mode("overwrite").parquet(f"{root}/chunks")


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, idx, md, context_tail ('' if there is none)."""
    return spark.read.schema("doc_id bigint, idx int, md string, context_tail string").parquet(f"{root}/chunks").withColumn("context_tail", F.coalesce("context_tail", F.lit("")))


def write_usage(usage: DataFrame, root: str) -> None:
    usage.write.mode("overwrite").json(f"{root}/usage")


def read_usage(spark: SparkSession, root: str) -> DataFrame:
    """Raises on a row that isn't JSON."""
    return _json(spark, f"{root}/usage", CHUNK_USAGE, True)


def write_manifest(manifest: DataFrame, root: str) -> None:
    manifest.write.mode("overwrite").json(f"{root}/manifest")


def read_manifest(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    return _json(spark, f"{root}/manifest", MANIFEST, strict)


def write_stats(stats: DataFrame, root: str) -> None:
    """Without the nested stages, which are written as rows of their own."""
    stats.drop("stages").write.mode("overwrite").json(f"{root}/stats")


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """Rows that aren't JSON are left out."""
    return _json(spark, f"{root}/stats", STATS, False)


def write_fixes(fixes: DataFrame, root: str) -> None:
    """Repaired tables with their text before and after, one row each."""
    fixes.write.mode("overwrite").parquet(f"{root}/table_fixes")


def read_fixes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/table_fixes")


def write_fix_stats(stats: DataFrame, root: str) -> None:
    stats.write.mode("overwrite").json(f"{root}/table_fix_stats")


def read_fix_stats(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, f"{root}/table_fix_stats", FIX_STATS, False)


def combined_stats(stats: DataFrame, fixes: DataFrame) -> DataFrame:
    """``stats`` with the stage of table repairs, for documents of which something was fixed."""
    stage = fixes.filter("fixed > 0").select("doc_id", F.struct(F.lit("table fixes").alias("name"), "input_tokens", "output_tokens", "cost", "elapsed_seconds", F.concat(F.col("fixed").cast("string"), F.lit(" tables")).alias("detail")).alias("stage"))
    return stats.join(stage, "doc_id", "left").withColumn("stages", F.filter(F.array("stage"), lambda s: s.isNotNull())).drop("stage")


def write_documents(docs: DataFrame, root: str, name: str = "output") -> None:
    docs.select("doc_id", "md").write.mode("overwrite").parquet(f"{root}/{name}")


def read_documents(spark: SparkSession, root: str, name: str = "output") -> DataFrame:
    return spark.read.schema("doc_id bigint, md string").parquet(f"{root}/{name}")


def write_images(images: DataFrame, root: str) -> None:
    """name and content of images, by document; a document's old images go."""
    images.select("doc_id", "page_no", "idx", "name", "content").write.option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").mode("overwrite").parquet(f"{root}/images")


def invalidate(spark: SparkSession, root: str) -> None:
    """Removes all of a work folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
