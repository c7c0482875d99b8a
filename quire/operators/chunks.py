"""Chunk plans, their resumption from what was done before, and the converter as an injected function."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import merge


def plan_chunks(docs: DataFrame, per_chunk: Column | int, most: Column | int | None = None) -> DataFrame:
    """doc_id, idx, page_start, page_end, is_first, is_last for documents (doc_id, total_pages): runs of ``per_chunk`` pages
    from 1; a document of no more pages than that, even of none, is one chunk. ``most``: pages to take at the most."""
    per = F.lit(per_chunk).cast("int") if isinstance(per_chunk, int) else per_chunk.cast("int")
    total = F.col("total_pages").cast("int") if most is None else F.least(F.col("total_pages").cast("int"), F.lit(most) if isinstance(most, int) else most)
    starts = F.when(total <= per, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(total, F.lit(1)), per))
    rows = docs.select("doc_id", total.alias("t"), per.alias("per"), F.posexplode(starts).alias("idx", "page_start"))
    end = F.least(F.col("page_start") + F.col("per") - 1, F.col("t"))
    return rows.select("doc_id", "idx", "page_start", end.alias("page_end"), (F.col("idx") == 0).alias("is_first"), (end >= F.col("t")).alias("is_last"))


MANIFEST = ("pdf_mtime", "pdf_size", "total_pages", "pages_per_chunk", "max_pages", "model_id", "num_chunks")


def manifest_changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, changed: whether any field differs, null being a value; documents without an old manifest have changed."""
    same = F.lit(True)
    both = new.alias("n").join(old.alias("o").withColumn("known", F.lit(True)), "doc_id", "left")
    for c in MANIFEST:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return both.select("doc_id", (~(F.coalesce("known", F.lit(False)) & same)).alias("changed"))


def fresh_chunks(plan: DataFrame, cached: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Chunks still to be made: those not among ``cached`` (doc_id, idx), and all of documents that have ``changed``."""
    kept = cached if changed is None else cached.join(changed.filter("changed").select("doc_id"), "doc_id", "left_anti")
    return plan.join(kept.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def missing_chunks(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no (from 1) of chunks that a manifest (doc_id, num_chunks) promises and ``chunks`` lacks."""
    wanted = manifests.filter("num_chunks > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("num_chunks").cast("int") - 1)).alias("idx"))
    return wanted.join(chunks.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").select("doc_id", (F.col("idx") + 1).alias("chunk_no"))


def stale(runs: DataFrame) -> DataFrame:
    """doc_id, stale for runs (doc_id, force, has_output, old_model, model): forced, without output, or made by another
    model; without a manifest (null old_model) not stale."""
    return runs.select("doc_id", (F.col("force") | ~F.col("has_output") | F.coalesce(F.col("old_model") != F.col("model"), F.lit(False))).alias("stale"))


def pages_per_chunk(requested: Column, in_manifest: Column, force: Column) -> Column:
    return F.when(force, requested).otherwise(F.coalesce(in_manifest, requested))


def context_note(is_first: Column, is_last: Column) -> Column:
    """Which note a chunk's prompt carries; the first beats the last."""
    return F.when(is_first, "first").when(is_last, "last").otherwise("middle")


def prompt(page_start: Column, page_end: Column, total: Column, previous: Column) -> Column:
    """The request for a chunk, with the end of the chunk before as context."""
    ask = F.format_string("Convert pages %d-%d of %d to marked text.", page_start, page_end, total)
    return F.when(previous == "", ask).otherwise(F.concat(ask, F.lit("\n\nThe text before ends so:\n"), previous))


CONVERTED = "idx int, page_start int, page_end int, md string, context_tail string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, elapsed_seconds double, status string, error string"


def convert(plan: DataFrame, pages: DataFrame, client: Callable[..., dict], most_pages: int = 100, attempts: int = 10, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends every planned chunk to ``client`` (pages, page_start, page_end, context to a dict with md and token counts),
    in order within a document, as each needs the end of the one before; documents run side by side. A failure is the
    document's alone: its row has status failed and the error. ``pages``: doc_id, page_no, pdf_text."""
    kind = plan.schema["doc_id"].dataType.simpleString()
    text = pages.select("doc_id", "page_no", "pdf_text")
    rows = plan.select("doc_id", "idx", "page_start", "page_end").join(text, "doc_id", "left").filter("page_no IS NULL OR page_no BETWEEN page_start AND page_end")
    chunks = rows.groupBy("doc_id", "idx", "page_start", "page_end").agg(F.array_sort(F.collect_list(F.struct("page_no", "pdf_text"))).alias("pages"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, context = [], ""
        for r in pdf.sort_values("idx").itertuples():
            began = time.monotonic()
            row = {"doc_id": key[0], "idx": r.idx, "page_start": r.page_start, "page_end": r.page_end, "status": "failed"}
            try:
                if r.page_end - r.page_start + 1 > most_pages:
                    raise ValueError(f"{r.page_end - r.page_start + 1} pages in a request, {most_pages} at most")
                told = _asked(client, [p["pdf_text"] for p in r.pages], r.page_start, r.page_end, context, attempts, wait)
                if told.get("stop_reason") == "max_tokens":
                    raise ValueError("the answer was cut off")
                context = told["context_tail"] = _tail(told["md"])
                row |= told | {"status": "converted", "elapsed_seconds": time.monotonic() - began}
            except Exception as e:
                out.append(row | {"error": str(e)})
                break
            out.append(row)
        names = ["doc_id", *(c.split()[0] for c in CONVERTED.split(", "))]
        return pd.DataFrame({c: pd.Series([x.get(c) for x in out], dtype=object) for c in names})

    done = chunks.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, {CONVERTED}")
    return done.withColumn("md", merge.renumbered(F.col("md"), F.col("page_start"))).withColumn("context_tail", merge.context_tail(F.col("md")))


class Retryable(Exception):
    """A failure after which the same request may succeed."""


def _asked(client, pages: list, start: int, end: int, context: str, attempts: int, wait) -> dict:
    for attempt in range(1, attempts + 1):
        try:
            return dict(client(pages, start, end, context))
        except Retryable:
            if attempt == attempts:
                raise
            wait(min(2.0 ** (attempt - 1), 30.0))
    raise AssertionError


def _tail(md: str, least: int = 200) -> str:
    return "\n".join(md.split("\n")[-least:])
