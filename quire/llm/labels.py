"""Labelled samples for classifiers that are fitted on the driver: bounded in rows and in bytes, spread by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket


def sample(labels: DataFrame, label: str, folds: int, held: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids of each label value 0 and 1 outside the held-out fold: doc_id, y. Null ids and labels are left
    out; of contradicting labels of one id the larger counts. Which rows are taken depends on a hash of the id alone."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (bucket(F.col(id_col), folds) != held))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return known.filter("y = 1").orderBy(*order).limit(rows).unionByName(known.filter("y = 0").orderBy(*order).limit(rows))
