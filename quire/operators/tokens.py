"""Documents as relations: marks, pages, headings, tables, rows, cells. Each is one narrow pass over (doc_id, md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m
from ..functions.text import java, last_before, let, matches


def pages_of(md: Column) -> Column:
    """Array of (start, end, page) of all marks that begin a page."""
    return F.transform(matches(md, m.PAGE_BEGIN.pattern), lambda x: F.struct(x["start"], x["end"], x["value"].cast("int"))).cast("array<struct<start:int,end:int,page:int>>")


def page_at(marks: Column, place: Column) -> Column:
    """The page on which a place lies; null before the first mark."""
    return last_before(marks, place, "page")


def found(docs: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """A row per match: doc_id, ord, start, end, text, value, page_no."""
    rows = docs.select("doc_id", pages_of(F.col("md")).alias("marks"), F.posexplode(matches(F.col("md"), pattern, group)).alias("ord", "x"))
    return rows.select("doc_id", "ord", "x.*", page_at(F.col("marks"), F.col("x.start")).alias("page_no"))


def page_marks(docs: DataFrame, end: bool = False) -> DataFrame:
    """doc_id, ord, start, page_no of the marks that begin (or end) pages."""
    rows = docs.select("doc_id", F.posexplode(matches(F.col("md"), (m.PAGE_END if end else m.PAGE_BEGIN).pattern)).alias("ord", "x"))
    return rows.select("doc_id", "ord", F.col("x.start").alias("start"), F.col("x.value").cast("int").alias("page_no"))


def page_blocks(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ord, page_no, block (with its marks), body, skipped; the end mark's number needn't agree. ``keep``: more columns."""
    rx = java(m.PAGE_BLOCK)
    part = lambda g: F.regexp_extract_all(F.col("md"), F.lit(rx), F.lit(g))
    rows = docs.select("doc_id", *(keep or []), F.posexplode(F.arrays_zip(part(0).alias("block"), part(1).alias("page"), part(2).alias("body"))).alias("ord", "x"))
    return rows.select("doc_id", *(keep or []), "ord", F.col("x.page").cast("int").alias("page_no"), F.col("x.block").alias("block"), F.col("x.body").alias("body"), F.col("x.body").rlike(java(m.PAGE_SKIP.pattern)).alias("skipped"))


def page_contents(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, body: of blocks with one number the last."""
    return page_blocks(docs).groupBy("doc_id", "page_no").agg(F.max_by("body", "ord").alias("body"))


def headings(docs: DataFrame) -> DataFrame:
    """Numbered headings: doc_id, ord, start, section, page_no."""
    return found(docs, m.HEADING).select("doc_id", "ord", "start", F.col("value").alias("section"), "page_no")


def title_before(md: Column, start: Column) -> Column:
    """``Table N`` from the last caption within 200 code points before ``start``; null if there is none."""
    begin = F.greatest(start - 200, F.lit(0))
    numbers = F.regexp_extract_all(F.substring(md, begin + 1, start - begin), F.lit(java(m.definition("Table"))), F.lit(1))
    return F.when(F.size(numbers) > 0, F.concat(F.lit("Table "), F.get(numbers, F.size(numbers) - 1)))


def tables(docs: DataFrame) -> DataFrame:
    """doc_id, tbl_no, start, end, label (null without caption), page_no, pages (from first to last), html."""
    rows = docs.select("doc_id", "md", pages_of(F.col("md")).alias("marks"), F.posexplode(matches(F.col("md"), m.TABLE, 0)).alias("tbl_no", "x"))
    first, last = page_at(F.col("marks"), F.col("x.start")), page_at(F.col("marks"), F.col("x.end") - 1)
    pages = F.when(first.isNull(), F.array().cast("array<int>")).when(last > first, F.sequence(first, last)).when(last < first, F.array().cast("array<int>")).otherwise(F.array(first))
    return rows.select("doc_id", "tbl_no", F.col("x.start").alias("start"), F.col("x.end").alias("end"), title_before(F.col("md"), F.col("x.start")).alias("label"), first.alias("page_no"), pages.alias("pages"), F.col("x.text").alias("html"))


def complex_tables(docs: DataFrame) -> DataFrame:
    """Tables with a column or row span."""
    return tables(docs).filter(F.col("html").rlike(m.SPAN))


def cells_of(html: Column) -> Column:
    """Rows of a piece of table as arrays of (colspan, rowspan)."""
    span = lambda a, rx: F.when(a == "", 1).otherwise(F.coalesce(F.regexp_extract(a, rx, 1).try_cast("int"), F.lit(1)))
    row = lambda r: F.transform(F.regexp_extract_all(r, F.lit(java(m.CELL)), F.lit(1)), lambda a: F.struct(span(a, m.COLSPAN).alias("colspan"), span(a, m.ROWSPAN).alias("rowspan")))
    return F.transform(F.regexp_extract_all(html, F.lit(java(m.ROW)), F.lit(1)), row).cast("array<array<struct<colspan:int,rowspan:int>>>")


def sections_of(html: Column) -> Column:
    """Array of (section, rows): the first head and the first body, or the whole table where neither has rows."""
    head, body, whole = cells_of(F.regexp_extract(html, java(m.HEAD), 0)), cells_of(F.regexp_extract(html, java(m.BODY), 0)), cells_of(html)
    either = lambda h, b: F.when((F.size(h) == 0) & (F.size(b) == 0), F.array(F.struct(F.lit("table").alias("section"), whole.alias("rows")))).otherwise(
        F.filter(F.array(F.struct(F.lit("head").alias("section"), h.alias("rows")), F.struct(F.lit("body").alias("section"), b.alias("rows"))), lambda s: F.size(s["rows"]) > 0)
    )
    return let(head, lambda h: let(body, lambda b: either(h, b))).cast("array<struct<section:string,rows:array<array<struct<colspan:int,rowspan:int>>>>>")


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tbl_no, section, row_idx, cell_idx, colspan, rowspan; rows count from 0 in their section."""
    rows = tables(docs).select("doc_id", "tbl_no", F.explode(sections_of(F.col("html"))).alias("s"))
    rows = rows.select("doc_id", "tbl_no", "s.section", F.posexplode("s.rows").alias("row_idx", "row"))
    return rows.select("doc_id", "tbl_no", "section", "row_idx", F.posexplode("row").alias("cell_idx", "c")).select("doc_id", "tbl_no", "section", "row_idx", "cell_idx", "c.colspan", "c.rowspan")
