"""Image regions: blocks and rectangles from text, matched with rasters by common area, named and put back as references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markers as m
from ..functions.text import java, let, lines, stripped
from .joins import overlapping

PADDING, LEAST_AREA, DPI = 0.01, 0.02, 600
VARIANTS = ("auto", "snap", "bbox")


def line_events(md: Column) -> Column:
    """Lines with the page in force (null before the first mark) and the number of the block that they are in (0 outside);
    a block runs from its begin to its end or to the next begin; ``closes`` is the line that ends one."""
    begin, end = java(m.IMAGE_BEGIN.pattern), java(m.IMAGE_END.pattern)
    row = "array<struct<line:string,page:int,block:int,opens:boolean,closes:boolean>>"
    start = F.struct(F.lit(None).cast("int").alias("page"), F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast(row).alias("rows"))

    def step(acc: Column, s: Column) -> Column:
        page = F.coalesce(F.nullif(F.regexp_extract(s, java(m.PAGE_BEGIN.pattern), 1), F.lit("")).cast("int"), acc["page"])
        opens = s.rlike(begin)
        closes = acc["open"] & ~opens & s.rlike(end)
        n = acc["n"] + opens.cast("int")
        one = F.struct(s.alias("line"), page.alias("page"), F.when(acc["open"] | opens, n).otherwise(0).alias("block"), opens.alias("opens"), closes.alias("closes"))
        return F.struct(page.alias("page"), n.alias("n"), ((acc["open"] | opens) & ~closes).alias("open"), F.array_append(acc["rows"], one).alias("rows"))

    return F.aggregate(lines(md), start, step, lambda acc: acc["rows"])


def _block(rows: Column) -> Column:
    """What a block's inner lines hold: the last rectangle, the first bold line that isn't empty."""
    inner = F.filter(rows, lambda r: ~r["opens"] & ~r["closes"])
    rects = F.filter(F.transform(inner, lambda r: F.regexp_extract_all(r["line"], F.lit(java(m.IMAGE_RECT.pattern)), F.lit(0))), lambda x: F.size(x) > 0)
    bold = F.filter(F.transform(inner, lambda r: F.regexp_extract(stripped(r["line"]), java(m.BOLD_LINE), 1)), lambda s: s != "")
    return F.struct(F.get(F.get(rects, F.size(rects) - 1), F.lit(0)).alias("rect"), F.coalesce(F.get(bold, F.lit(0)), F.lit("")).alias("caption"))


def image_rects(docs: DataFrame) -> DataFrame:
    """doc_id, ord, page_no, x0, y0, x1, y1, caption of closed blocks with a rectangle on a known page. A coordinate that
    isn't a number (``1.2.3``) is null."""

    def blocks(rows: Column) -> Column:
        ends = F.filter(rows, lambda r: r["closes"])
        return F.transform(ends, lambda e: F.struct(e["page"].alias("page"), _block(F.filter(rows, lambda r: r["block"] == e["block"])).alias("b")))

    found = docs.select("doc_id", F.posexplode(F.filter(let(line_events(F.col("md")), blocks), lambda x: x["b"]["rect"].isNotNull() & x["page"].isNotNull())).alias("ord", "x"))
    side = lambda k: F.regexp_extract(F.col("x.b.rect"), java(m.IMAGE_RECT.pattern), k).try_cast("double")
    return found.select("doc_id", "ord", F.col("x.page").alias("page_no"), side(1).alias("x0"), side(2).alias("y0"), side(3).alias("x1"), side(4).alias("y1"), F.col("x.b.caption").alias("caption"))


def clips(rects: DataFrame, dims: DataFrame) -> DataFrame:
    """Rectangles padded, kept within the page and scaled to its size, with their number on the page. ``dims``: doc_id, page_no, width, height."""
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = rects.join(dims, ["doc_id", "page_no"])
    scaled = {c: within(F.col(c) + (PADDING if c[1] == "1" else -PADDING)) * F.col("width" if c[0] == "x" else "height") for c in ("x0", "y0", "x1", "y1")}
    number = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("ord"))
    return rows.select("doc_id", "page_no", "ord", number.alias("idx"), "caption", *(v.alias(c) for c, v in scaled.items()))


def large_rasters(rasters: DataFrame, dims: DataFrame, least: float = LEAST_AREA) -> DataFrame:
    """Placed rasters (rx0..ry1) of at least ``least`` of the page's area; empty ones are left out."""
    w, h = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    area = F.col("width_pt") * F.col("height_pt")
    known = rasters.join(dims.select("doc_id", "page_no", F.col("width").alias("width_pt"), F.col("height").alias("height_pt")), ["doc_id", "page_no"])
    return known.filter((w > 0) & (h > 0) & (area > 0) & (w * h / area >= least)).drop("width_pt", "height_pt")


def matched(clipped: DataFrame, rasters: DataFrame) -> DataFrame:
    """Clips with each raster that overlaps them, or with nulls."""
    return overlapping(clipped, rasters, ["doc_id", "page_no"])


def decisions(clipped: DataFrame, rasters: DataFrame, mode: str = "auto", dpi: int | None = None) -> DataFrame:
    """How each clip is made: doc_id, page_no, idx, how (bbox, native, snap, union), n_matched, x0..y1 of what is rendered, dpi, name."""
    rows = matched(clipped, rasters).groupBy("doc_id", "page_no", "idx", "x0", "y0", "x1", "y1").agg(
        F.count("rx0").alias("n_matched"), F.min("rx0").alias("u0"), F.min("ry0").alias("u1"), F.max("rx1").alias("u2"), F.max("ry1").alias("u3"),
    )
    n = F.col("n_matched")
    how = F.when((F.lit(mode) == "bbox") | (n == 0), "bbox").when(n == 1, "native" if mode == "auto" else "snap").when((F.col("u2") > F.col("u0")) & (F.col("u3") > F.col("u1")), "union").otherwise("bbox")
    rows = rows.withColumn("how", how)
    pick = lambda own, theirs: F.when(F.col("how") == "bbox", F.col(own)).otherwise(F.col(theirs)).alias(own)
    name = F.format_string(m.IMAGE_NAME, "page_no", "idx", F.lit("png"))
    return rows.select("doc_id", "page_no", "idx", "how", "n_matched", pick("x0", "u0"), pick("y0", "u1"), pick("x1", "u2"), pick("y1", "u3"), F.lit(dpi or DPI).alias("dpi"), name.alias("name"))


def variants(clipped: DataFrame) -> DataFrame:
    """A row for each way in which a clip can be made, for comparison."""
    return clipped.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))


def file_names(decided: DataFrame) -> DataFrame:
    """doc_id, files: map of page to names in order."""
    pages = decided.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names"))
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "names"))).alias("files"))


def comparison(names: Column, prefix: Column, info: Column) -> Column:
    """An HTML table of variants: mode (the part before the suffix), image, what is known of it."""
    row = lambda f: F.concat(F.lit("<tr><td>"), F.when(F.size(F.split(f, "[.]")) >= 3, F.get(F.split(f, "[.]"), F.lit(1))).otherwise("?"), F.lit('</td><td><img src="'), prefix, F.lit("/"), f, F.lit('"></td><td><small>'), F.coalesce(F.try_element_at(info, f), F.lit("")), F.lit("</small></td></tr>"))
    return F.array_join(F.concat(F.array(F.lit("<table>"), F.lit("<tr><th>Mode</th><th>Image</th><th>Info</th></tr>")), F.transform(names, row), F.array(F.lit("</table>"))), "\n")


def inject(docs: DataFrame, files: DataFrame, prefix: str = "images", per_block: int = 1) -> DataFrame:
    """``md`` with a reference after the first bold line of each closed block that has none, while its page has names left.
    Names are used up in order by blocks that have a bold line. ``files``: doc_id, files."""

    def rebuilt(rows: Column, names: Column) -> Column:
        ends = F.transform(F.filter(rows, lambda r: r["closes"]), lambda r: F.struct(r["block"].alias("block"), r["page"].alias("page")))

        def use(acc: Column, e: Column) -> Column:
            own = F.filter(rows, lambda r: r["block"] == e["block"])
            bold = F.filter(own, lambda r: stripped(r["line"]).rlike(java(m.BOLD_LINE)))
            used = F.size(F.filter(acc, lambda x: x["page"] == e["page"])) * per_block
            free = F.coalesce(F.size(F.try_element_at(names, e["page"])), F.lit(0)) >= used + per_block
            ok = e["page"].isNotNull() & free & (F.size(bold) > 0) & ~F.exists(own, lambda r: r["line"].rlike(java(m.IMAGE_REFERENCE)))
            return F.when(ok, F.array_append(acc, F.struct(e["block"].alias("block"), e["page"].alias("page"), used.alias("at")))).otherwise(acc)

        uses = F.aggregate(ends, F.array().cast("array<struct<block:int,page:int,at:int>>"), use)

        def line(r: Column, i: Column, all_uses: Column) -> Column:
            own = F.get(F.filter(all_uses, lambda u: u["block"] == r["block"]), F.lit(0))
            is_bold = stripped(r["line"]).rlike(java(m.BOLD_LINE))
            first = ~F.exists(F.slice(rows, F.lit(1), i), lambda x: (x["block"] == r["block"]) & stripped(x["line"]).rlike(java(m.BOLD_LINE)))
            caption = F.regexp_extract(stripped(r["line"]), java(m.BOLD_LINE), 1)
            name = F.get(F.try_element_at(names, own["page"]), own["at"])
            return F.when(own.isNotNull() & is_bold & first, F.concat(r["line"], F.lit("\n\n!["), caption, F.lit(f"]({prefix}/"), name, F.lit(")"))).otherwise(r["line"])

        return let(uses, lambda u: F.array_join(F.transform(rows, lambda r, i: line(r, i, u)), "\n"))

    rows = docs.join(files, "doc_id", "left")
    text = let(line_events(F.col("md")), lambda r: rebuilt(r, F.col("files")))
    return rows.withColumn("md", F.when(F.col("files").isNull(), F.col("md")).otherwise(text)).drop("files")
