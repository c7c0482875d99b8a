"""Helpers shared by the corpus operators: the shared work folder, written intermediates, arrow row maps."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Largest table, in estimated bytes, that an operator broadcasts; beyond it the same join shuffles.
BROADCAST_BYTES = 64 << 20

#: Tasks over which a shuffled join spreads a hot key, rows from which on a key may be one, and how many such keys there are.
SALTS, HOT, HEAVY = 16, 1 << 14, 1024

#: Spark's switch for removing a query's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of our own if the master
    is local, and an error if it isn't. A path without scheme is one of the cluster's default file system."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        return root
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm.org.apache.hadoop.fs.Path(root)).toString()


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors. What its own run shuffled is
    removed then, as is the written table ``instead_of``, which nothing may read any more."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN)
    try:
        spark.conf.set(CLEAN, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    for folder in {f.rpartition("/")[0] for f in instead_of.inputFiles()} if instead_of is not None else ():
        fs, inner = local_file(folder)
        fs.delete_dir(inner)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether the counted rows of ``df``, of ``row_bytes`` each, may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of ``row_bytes`` fit the bound; else as it is, to be shuffled."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has a row for a key or few: a broadcast within the bound, if ``row_bytes`` are
    given. Else both are shuffled, and each of the keys that most rows of ``left`` have (more than ``HOT``, ``HEAVY`` keys at
    most) is spread over ``SALTS`` tasks by the partition that its rows come from."""
    if row_bytes is not None and fits(right, row_bytes):
        return left.join(F.broadcast(right), on, how)
    hot = left.groupBy(*on).count().filter(F.col("count") > HOT).orderBy(F.desc("count")).limit(HEAVY).select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(written(hot, "hot-keys"))
    one = lambda some, rest: F.when(F.coalesce("_hot", F.lit(False)), some).otherwise(rest)
    left = left.join(hot, on, "left").withColumn("_salt", one(F.pmod(F.spark_partition_id(), F.lit(SALTS)), F.lit(0))).drop("_hot")
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(one(F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[Column] | None = None) -> DataFrame:
    """Id and text (and ``more``) alone, under fixed names, so that extra or clashing columns of the input can't matter; null text is ''."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(more or []))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str | StructType, keep: tuple[str, ...] = (), memory: str = "") -> DataFrame:
    """``mapInArrow`` over a function that yields columns as dictionaries of lists: the columns ``keep`` of ``df``, with their
    types, and those of ``schema``. What a worker remembers for anything but ``memory`` (see ``remembered``) is dropped first."""
    types = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    types = StructType([StructField(c, df.schema[c].dataType) for c in keep] + types.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(memory)
        for out in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, types)


#: What this worker process remembers from task to task: one operator's tables, under the operator's name and their own.
_memory: dict[tuple[str, object], Any] = {}


def forget(but: str = "") -> None:
    """Drops what the worker remembers for any operator but one, and gives the memory back."""
    gone = [k for k in _memory if k[0] != but]
    for k in gone:
        del _memory[k]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def remembered(operator: str, name: object, make: Callable[[], Any]) -> Any:
    """The one thing that a worker process holds for ``operator``, made where it isn't held under this name."""
    key = (operator, name)
    if key not in _memory:
        forget()
        _memory[key] = make()
    return _memory[key]


def local_file(path: str) -> tuple[object, str]:
    """A pyarrow file system and the path inside it, for any URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
