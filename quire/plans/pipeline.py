"""Processing steps over documents (doc_id, md): each is a function from DataFrame to DataFrame, and a pipeline is a list of
them. Everything stays lazy; Spark fuses what is narrow."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_descriptions
from ..operators import checks, images, merge, tables


@dataclass(frozen=True)
class Step:
    """A named step, the point of extension: anything that takes and returns documents."""

    key: str
    name: str
    run: Callable[[DataFrame], DataFrame]


JOIN_TABLES = Step("tables", "join continued tables", tables.merge_continued)
STRIP = Step("strip", "strip image descriptions", lambda d: d.withColumn("md", without_descriptions(F.col("md"))))
FORMAT = Step("format", "format", tables.format_documents)


def fix_step(fixer, cache: DataFrame | None = None) -> Step:
    return Step("fix-tables", "repair complex tables", lambda d: tables.fix_tables(d, fixer, cache)[0])


def image_step(files: DataFrame, prefix: str = "images", per_block: int = 1) -> Step:
    return Step("images", "put in image references", lambda d: images.inject(d, files, prefix, per_block))


def steps(fixer=None, image_files: DataFrame | None = None, strip: bool = False, formatted: bool = True) -> list[Step]:
    """The steps for the given options, in the order in which they have to run."""
    out = [JOIN_TABLES]
    if fixer is not None:
        out.append(fix_step(fixer))
    if image_files is not None:
        out.append(image_step(image_files))
    return out + [STRIP] * strip + [FORMAT] * formatted


@dataclass
class Result:
    documents: DataFrame
    issues: DataFrame
    #: Seconds of planning by step; the work itself is done when the result is used.
    timings: dict[str, float] = field(default_factory=dict)


def run(docs: DataFrame, chain: list[Step], source_pages: DataFrame | None = None) -> Result:
    """Runs documents through steps; the issues are those of the last state alone."""
    timings = {}
    for step in chain:
        began = time.monotonic()
        docs = docs.transform(step.run)
        timings[step.key] = time.monotonic() - began
    return Result(docs, checks.validate(docs, source_pages), timings)


def replay(chunks: DataFrame, chain: list[Step] | None = None) -> DataFrame:
    """Documents from chunks that were converted before: merged, then through the steps."""
    docs = merge.merge_chunks(chunks)
    for step in chain if chain is not None else steps(strip=True):
        docs = docs.transform(step.run)
    return docs
