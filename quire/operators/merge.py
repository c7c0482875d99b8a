"""Chunks put together: pages by first writer, documents in page order; marks numbered anew; tails carried on as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markers as m
from ..functions.text import java, let, matches, newlines, stripped
from . import tokens


def page_claims(chunks: DataFrame) -> DataFrame:
    """Every page of every chunk once: doc_id, idx, page_no, block, first (the chunk that keeps it). ``chunks``: doc_id, idx, md."""
    pages = tokens.page_blocks(chunks, keep=["idx"]).groupBy("doc_id", "idx", "page_no").agg(F.min_by("block", "ord").alias("block"))
    owner = Window.partitionBy("doc_id", "page_no").orderBy("idx")
    return pages.withColumn("first", F.row_number().over(owner) == 1)


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """doc_id, idx, n_pages, n_new: pages of each chunk, and those that no chunk before had."""
    return page_claims(chunks).groupBy("doc_id", "idx").agg(F.count("*").alias("n_pages"), F.count_if("first").alias("n_new"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, md. One chunk stays as it is; without any page the parts that aren't blank are joined; else the pages are,
    in order, each as its first chunk has it. Pages are deduplicated within a document's row: one shuffle, on doc_id."""
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "md"))).alias("parts"))
    rx = java(m.PAGE_BLOCK)
    part = lambda t, g: F.regexp_extract_all(t, F.lit(rx), F.lit(g))
    of = lambda p: F.arrays_zip(F.transform(part(p["md"], 1), lambda n: n.cast("int")).alias("page"), part(p["md"], 0).alias("block"))
    pages = F.flatten(F.transform("parts", of))

    def ordered(all_pages: Column) -> Column:
        ranked = F.array_sort(F.transform(all_pages, lambda x, i: F.struct(x["page"].alias("page"), i.alias("i"), x["block"].alias("block"))))
        kept = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["page"] != x["page"])))
        return F.array_join(F.transform(kept, lambda x: x["block"]), "\n\n")

    loose = F.array_join(F.filter(F.transform("parts", lambda p: stripped(p["md"])), lambda s: s != ""), "\n\n")
    md = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["md"]).otherwise(let(pages, lambda x: F.when(F.size(x) == 0, loose).otherwise(ordered(x))))
    return parts.select("doc_id", md.alias("md"))


def renumbered(md: Column, page_start: Column) -> Column:
    """``md`` with page_start - 1 added to all page marks if the first that begins a page is lower than ``page_start``."""

    def shifted(text: Column, marker: m.Marker) -> Column:
        gaps = F.split(text, java(marker.pattern), -1)
        part = lambda g: F.regexp_extract_all(text, F.lit(java(marker.around)), F.lit(g))
        moved = F.zip_with(F.zip_with(part(1), part(2), lambda a, n: F.concat(a, (n.cast("bigint") + page_start - 1).cast("string"))), part(3), lambda a, b: F.concat(a, b))
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), moved.alias("m")), lambda x: F.concat(x["g"], F.coalesce(x["m"], F.lit("")))), "")

    first = F.nullif(F.regexp_extract(md, java(m.PAGE_BEGIN.pattern), 1), F.lit("")).cast("bigint")
    return F.when(first < page_start, let(shifted(md, m.PAGE_BEGIN), lambda t: shifted(t, m.PAGE_END))).otherwise(md)


def context_tail(md: Column, least_pages: int = 3, least_lines: int = 200) -> Column:
    """The shortest run of whole last pages, at least ``least_pages``, with ``least_lines`` newlines; all pages if none has
    them; without pages the last ``least_lines`` lines."""
    lines = F.split(md, "\n", -1)
    no_pages = F.array_join(F.slice(lines, F.greatest(F.size(lines) - least_lines + 1, F.lit(1)), F.lit(least_lines)), "\n")

    def of(marks: Column) -> Column:
        n = F.size(marks)
        tail = lambda k: F.substring(md, F.get(marks, n - k)["start"] + 1, F.length(md))
        fits = F.filter(F.sequence(F.least(F.lit(least_pages), n), n), lambda k: (k == n) | (newlines(tail(k)) >= least_lines))
        return F.when(n == 0, no_pages).otherwise(tail(F.get(fits, F.lit(0))))

    return let(matches(md, m.PAGE_BEGIN.pattern), of)


def with_context(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the tail of the chunk before: previous_context, '' for the first."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    return chunks.withColumn("context_tail", context_tail(F.col("md"))).withColumn("previous_context", F.coalesce(F.lag("context_tail").over(order), F.lit("")))
