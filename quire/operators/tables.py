"""Table geometry and rewriting: column counts by row, continued tables, pretty printing, replacement by places."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import markers as m
from ..functions.text import java, let, spaced
from . import tokens


def carried(rows: Column) -> Column:
    """Cells that reach rows below their own, as (row, w, h)."""
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(F.filter(r, lambda c: c["rowspan"] > 1), lambda c: F.struct(i.alias("row"), c["colspan"].alias("w"), c["rowspan"].alias("h")))))
    return cells.cast("array<struct<row:int,w:int,h:int>>")


def reaches(c: Column, i: Column) -> Column:
    return (c["row"] < i) & (i - c["row"] < c["h"])


def covered(rows: Column) -> Column:
    """Width of every row: column spans of its own cells and of those that reach it. Exact where no column span lies over a
    slot that a row span holds."""

    def width(cs: Column) -> Column:
        above = lambda i: F.aggregate(F.filter(cs, lambda c: reaches(c, i)), F.lit(0), lambda a, c: a + c["w"])
        return F.transform(rows, lambda r, i: F.aggregate(r, above(i), lambda a, c: a + c["colspan"]))

    return let(carried(rows), width)


def overlaid(rows: Column) -> Column:
    """Width of every row where column spans lie over held slots: row by row and cell by cell, with the number of rows for
    which each column is still held."""
    state = "struct<held:array<int>,at:int,width:int>"

    def cell(a: Column, c: Column) -> Column:
        free = F.array_position(F.transform(F.slice(a["held"], a["at"] + 1, F.size(a["held"])), lambda h: h > 0), False).cast("int")

        def placed(at: Column) -> Column:
            end = at + c["colspan"]
            slots = F.concat(a["held"], F.array_repeat(F.lit(0), F.greatest(end - F.size(a["held"]), F.lit(0))))
            held = F.transform(slots, lambda h, i: F.when((i >= a["at"]) & (i < at), h - 1).when((i >= at) & (i < end) & (c["rowspan"] > 1), c["rowspan"] - 1).otherwise(h))
            return F.struct(held.alias("held"), end.alias("at"), (a["width"] + end - a["at"]).alias("width")).cast(state)

        return let(F.when(free > 0, a["at"] + free - 1).otherwise(F.greatest(F.size(a["held"]), a["at"])), placed)

    def row(acc: Column, r: Column) -> Column:
        begin = F.struct(acc["held"].alias("held"), F.lit(0).alias("at"), F.lit(0).alias("width")).cast(state)

        def done(a: Column) -> Column:
            rest = F.size(F.filter(a["held"], lambda h, i: (i >= a["at"]) & (h > 0)))
            held = F.transform(a["held"], lambda h, i: F.when((i >= a["at"]) & (h > 0), h - 1).otherwise(h))
            return F.struct(held.alias("held"), F.array_append(acc["widths"], a["width"] + rest).alias("widths"))

        return let(F.aggregate(r, begin, cell), done).cast("struct<held:array<int>,widths:array<int>>")

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("held"), none.alias("widths")).cast("struct<held:array<int>,widths:array<int>>")
    return F.aggregate(rows, start, row, lambda acc: acc["widths"])


def widths(rows: Column) -> Column:
    """Width of every row: by the closed form, or cell by cell where a row with a column span is reached from above."""

    def of(rs: Column) -> Column:
        may = lambda cs: F.exists(F.transform(rs, lambda r, i: F.exists(cs, lambda c: reaches(c, i)) & F.exists(r, lambda c: c["colspan"] > 1)), lambda x: x)
        return F.when(let(carried(rs), may), overlaid(rs)).otherwise(covered(rs))

    return let(rows, of)


@F.pandas_udf(ArrayType(IntegerType()))
def folded(rows: pd.Series) -> pd.Series:
    """Width of every row (of rows as JSON) by keeping, column after column, for how many rows it is still held: ``overlaid``
    as a plain loop, for comparison. No plan uses it."""

    def one(table: str) -> list[int]:
        held: dict[int, int] = {}
        widths = []
        for row in json.loads(table):
            at = width = 0
            for cell in row:
                while held.get(at, 0) > 0:
                    held[at] -= 1
                    at, width = at + 1, width + 1
                across, down = cell["colspan"], cell["rowspan"]
                for c in range(at, at + across):
                    held[c] = down - 1 if down > 1 else held.get(c, 0)
                at, width = at + across, width + across
            rest = [c for c, n in held.items() if c >= at and n > 0]
            for c in rest:
                held[c] -= 1
            widths.append(width + len(rest))
        return widths

    return rows.map(one)


def row_widths(docs: DataFrame) -> DataFrame:
    """doc_id, tbl_no, start, label, page_no, section, row_idx, width."""
    keep = ["doc_id", "tbl_no", "start", "label", "page_no"]
    parts = tokens.tables(docs).select(*keep, F.explode(tokens.sections_of(F.col("html"))).alias("s")).select(*keep, "s.section", "s.rows")
    return parts.select(*keep, "section", F.posexplode(widths(F.col("rows"))).alias("row_idx", "width"))


def most_frequent(value: str, n: str) -> Column:
    """The value with the largest count ``n``, of equal ones the largest."""
    return F.max_by(value, F.struct(n, value))


def width_modes(docs: DataFrame) -> DataFrame:
    """doc_id, tbl_no, section, mode: the most frequent width of a section's rows."""
    counts = row_widths(docs).groupBy("doc_id", "tbl_no", "section", "width").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id", "tbl_no", "section").agg(most_frequent("width", "n").alias("mode"))


class _Printer(HTMLParser):
    """Puts each part of a table on a line of its own, indented by depth, and each cell on one line."""

    BLOCKS = frozenset("table thead tbody tfoot tr th td caption colgroup col".split())
    EMPTY = frozenset("br col img hr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.done: list[str] = []
        self.line, self.depth, self.cell = "", 0, False

    def end_line(self, more: str | None = None) -> None:
        if self.line.rstrip():
            self.done.append(self.line.rstrip())
        self.line = ""
        if more is not None:
            self.done.append("  " * self.depth + more)

    @staticmethod
    def tag(name: str, attrs: list, end: str = ">") -> str:
        return "<" + " ".join([name, *(k if v is None else f'{k}="{v}"' for k, v in attrs)]) + end

    def handle_starttag(self, name: str, attrs: list) -> None:
        is_cell = name in ("td", "th")
        if name not in self.BLOCKS or (self.cell and not is_cell):
            self.line += self.tag(name, attrs)
            return
        if is_cell:
            self.end_line()
            self.line, self.cell = "  " * self.depth + self.tag(name, attrs), True
        else:
            self.end_line(self.tag(name, attrs))
        self.depth += name not in self.EMPTY

    def handle_endtag(self, name: str) -> None:
        is_cell = name in ("td", "th")
        if name not in self.BLOCKS or (self.cell and not is_cell):
            self.line += f"</{name}>"
            return
        self.depth = max(0, self.depth - 1)
        if is_cell:
            self.line += f"</{name}>"
            self.end_line()
            self.cell = False
        else:
            self.end_line(f"</{name}>")

    def handle_startendtag(self, name: str, attrs: list) -> None:
        if name in self.BLOCKS:
            self.end_line(self.tag(name, attrs, " />"))
        else:
            self.line += self.tag(name, attrs, " />")

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.line += data.replace("\n", " ")
        elif data.strip():
            self.end_line()
            self.line = "  " * self.depth + data.strip()

    def handle_comment(self, data: str) -> None:
        if self.cell:
            self.line += f"<!--{data}-->"
        else:
            self.end_line(f"<!--{data}-->")

    def handle_entityref(self, name: str) -> None:
        self.line += f"&{name};"

    def handle_charref(self, name: str) -> None:
        self.line += f"&#{name};"


def pretty(html: str) -> str:
    printer = _Printer()
    printer.feed(html)
    printer.end_line()
    return "\n".join(printer.done)


#: Tables that begin a line and are written in lower case are printed anew.
LINE_TABLE = re.compile(r"^<table\b[^>]*>.*?</table>", re.MULTILINE | re.DOTALL)


#: Characters of text that a Python worker rewrites before it hands them on.
PIECE = 1 << 20


def rewritten(docs: DataFrame, change: Callable[[str], str], tag: str) -> DataFrame:
    """``docs`` with ``change`` made to each ``md`` that holds ``tag``. A worker holds the Arrow batch that came in and about
    ``PIECE`` characters besides, or one text if that is longer, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("md")
            field, begin, size, done = batch.schema.field(at), 0, 0, []
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                done.append(change(text) if text is not None and tag in text else text)
                size += len(text or "")
                if size >= PIECE or i + 1 == batch.num_rows:
                    yield batch.slice(begin, len(done)).set_column(at, field, pa.array(done, field.type))
                    begin, size, done = i + 1, 0, []

    return docs.mapInArrow(run, docs.schema)


def prettified(md: str) -> str:
    """``md`` with every table printed anew: an event parser that Catalyst can't express."""
    return LINE_TABLE.sub(lambda x: pretty(x[0]), md)


def format_documents(docs: DataFrame) -> DataFrame:
    """``md`` with pretty tables and tidy blanks; doing it again changes nothing."""
    return rewritten(docs, prettified, "<table").withColumn("md", spaced(F.col("md")))


def _page_marks(text: str) -> str:
    found = (x.strip() for x in text.splitlines())
    marks = re.compile(f"{m.PAGE_BEGIN.pattern}|{m.PAGE_END.pattern}")
    return "\n\n".join(x for x in found if marks.match(x))


def join_continued(md: str) -> str:
    """Rows of tables that continue others move into the body before, from the last mark to the first. Page marks between
    the two stay, other text between them goes. A mark inside an open table is taken out; one without a table before or
    after it, or without bodies, stays."""
    table, body = re.compile(m.TABLE), re.compile(m.BODY)
    for mark in reversed([*re.finditer(m.TABLE_CONTINUE.pattern, md)]):
        before = md[: mark.start()]
        if len(re.findall(r"(?i)<table\b", before)) > len(re.findall("(?i)</table>", before)):
            md = before + md[mark.end() :]
            continue
        end = md.rfind("</table>", 0, mark.start())
        at = md.rfind("</tbody>", 0, end) if end >= 0 else -1
        after = table.search(md, mark.end()) if at >= 0 else None
        rows = body.search(after[0]) if after else None
        if rows is None:
            continue
        close = end + len("</table>")
        between = _page_marks(md[close : after.start()])
        moved = "\n\n".join([between, rows[1].strip()] if between else [rows[1].strip()])
        md = f"{md[:at]}\n{moved}\n{md[at:close]}{md[after.end() :]}"
    return md


def merge_continued(docs: DataFrame) -> DataFrame:
    """Documents with continued tables joined: each splice depends on the one after it, so it is a fold and not a relation."""
    return rewritten(docs, join_continued, m.TABLE_CONTINUE.tag)


def islands(docs: DataFrame) -> DataFrame:
    """Tables with the number of the head table that they continue: doc_id, tbl_no, head_no, n_rows, continues. A table
    continues the one before if a mark outside tables lies between them."""
    rows = tokens.tables(docs).select("doc_id", "tbl_no", "start", "end", F.regexp_count("html", F.lit(java(m.ROW))).alias("n_rows"))
    marks = tokens.found(docs, m.TABLE_CONTINUE.pattern, 0).groupBy("doc_id").agg(F.collect_list("start").alias("marks"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("tbl_no")
    before = F.lag("end").over(order)
    rows = rows.join(marks, "doc_id", "left").withColumn("before", before)
    inside = F.exists(F.coalesce("marks", F.array().cast("array<int>")), lambda p: (p >= F.col("before")) & (p < F.col("start")))
    rows = rows.withColumn("continues", F.coalesce(inside, F.lit(False)))
    head = F.max(F.when(~F.col("continues"), F.col("tbl_no"))).over(order)
    return rows.select("doc_id", "tbl_no", head.alias("head_no"), "n_rows", "continues")


def context_lines(md: Column, place: Column, n: int, before: bool) -> Column:
    """The ``n`` lines nearest to a place that aren't blank, as they stand, in order."""
    all_lines = F.split(md, "\n", -1)
    at = F.length(F.substring(md, F.lit(1), place)) - F.length(F.replace(F.substring(md, F.lit(1), place), F.lit("\n"), F.lit("")))
    some = lambda x: F.filter(x, lambda s: s.rlike(r"(?U)\S"))
    if before:
        kept = some(F.slice(all_lines, F.lit(1), at))
        return F.array_join(let(kept, lambda k: F.slice(k, F.greatest(F.size(k) - n + 1, F.lit(1)), F.lit(n))), "\n")
    return F.array_join(let(all_lines, lambda a: F.slice(some(F.slice(a, at + 2, F.size(a))), F.lit(1), F.lit(n))), "\n")


def replace_tables(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``md`` with tables replaced by ``html`` of ``new`` (doc_id, tbl_no, html); other tables stay. One shuffle on doc_id."""
    by_no = new.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tbl_no", "html"))).alias("new"))
    rows = docs.join(by_no, "doc_id", "left")
    gaps, old = F.split("md", java(m.TABLE), -1), F.regexp_extract_all("md", F.lit(java(m.TABLE)), F.lit(0))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    chosen = F.transform(old, lambda t, i: F.coalesce(F.try_element_at(F.coalesce("new", none), i), t))
    text = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), chosen.alias("t")), lambda x: F.concat(x["g"], F.coalesce(x["t"], F.lit("")))), "")
    return rows.withColumn("md", F.when(F.col("new").isNull(), F.col("md")).otherwise(text)).drop("new")


def fix_tables(docs: DataFrame, fixer, cache: DataFrame | None = None, context: int = 5) -> tuple[DataFrame, DataFrame]:
    """Complex tables sent to ``fixer`` (a function of html, label, pages, before, after to html or None, run in Arrow
    batches), unless ``cache`` (input_hash, tbl_no, html) has the document's content; (documents, results)."""
    hashed = docs.withColumn("input_hash", F.sha2("md", 256))
    wanted = tokens.complex_tables(docs).join(hashed.select("doc_id", "md", "input_hash"), "doc_id")
    wanted = wanted.select("doc_id", "input_hash", "tbl_no", "html", F.coalesce("label", F.lit("HTML table")).alias("label"), "pages", context_lines(F.col("md"), F.col("start"), context, True).alias("before"), context_lines(F.col("md"), F.col("end"), context, False).alias("after"))

    def run(batches):
        for b in batches:
            b["fixed"] = [fixer(*x) for x in zip(b["html"], b["label"], b["pages"], b["before"], b["after"])]
            yield b[["doc_id", "input_hash", "tbl_no", "fixed"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    fresh = wanted if cache is None else wanted.join(cache.select("input_hash", "tbl_no"), ["input_hash", "tbl_no"], "left_anti")
    results = fresh.mapInPandas(run, f"doc_id {kind}, input_hash string, tbl_no int, fixed string")
    if cache is not None:
        results = results.unionByName(wanted.select("doc_id", "input_hash", "tbl_no").join(cache.select("input_hash", "tbl_no", F.col("html").alias("fixed")), ["input_hash", "tbl_no"]))
    done = results.filter(F.col("fixed").isNotNull()).select("doc_id", "tbl_no", F.col("fixed").alias("html"))
    return replace_tables(docs, done), results
