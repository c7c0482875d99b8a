"""Quality checks. Each maps a document's parts (text, page marks, headings, tables) to an array of issues (severity,
category, kind, page_no, message) in the order of emission, inside the row: no shuffle. The parts are found once a row."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m
from ..functions.text import java, last_before, let, matches, section_key, significant_words
from . import tables, tokens

ISSUE = "array<struct<severity:string,category:string,kind:string,page_no:int,message:string>>"
ERROR, WARNING, INFO = "error", "warning", "info"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def none() -> Column:
    return F.array().cast(ISSUE)


def issue(severity: str, category: str, kind: str, page: Column | None, *message: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in message]
    page = F.lit(None).cast("int") if page is None else page.cast("int")
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(kind).alias("kind"), page.alias("page_no"), F.concat(*parts).alias("message"))


def only(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one)).otherwise(none())


def at_page(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")), F.lit(""))


class Parts(NamedTuple):
    md: Column
    marks: Column
    headings: Column
    tables: Column


def pairs(rows: Column, wanted: Callable[[Column, Column], Column]) -> Column:
    """(now, before) of each row but the first, with the row before, of which ``wanted`` of both holds."""
    places = F.filter(F.transform(rows, lambda x, i: i), lambda i: (i > 0) & F.coalesce(wanted(F.get(rows, i), F.get(rows, i - 1)), F.lit(False)))
    return F.transform(places, lambda i: F.struct(F.get(rows, i).alias("now"), F.get(rows, i - 1).alias("before")))


def steps(rows: Column, wanted: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """``made(row, row before)`` for each row but the first of which ``wanted`` of both holds."""
    return F.coalesce(F.transform(pairs(rows, wanted), lambda p: made(p["now"], p["before"])), none())


def on_page(marks: Column, place: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of the page on which a place lies."""
    return let(last_before(marks, place, "page"), made)


def page_marks(doc: Parts) -> Column:
    name = "Page markers"
    skipped = F.regexp_count(doc.md, F.lit(java(m.PAGE_SKIP.pattern)))

    def of(p: Column) -> Column:
        size = F.size(p)
        told = issue(INFO, name, "found", None, "Page markers found: ", size, " markers, range ", F.array_min(p), "-", F.array_max(p), F.when(skipped > 0, F.concat(F.lit(" ("), skipped.cast("string"), F.lit(" skipped)"))).otherwise(""))
        back = steps(p, lambda x, y: x < y, lambda x, y: issue(ERROR, name, "non_monotonic", x, "Page markers not monotonic: page ", x, " follows page ", y))
        gaps = steps(p, lambda x, y: x - y > 1, lambda x, y: issue(ERROR, name, "gap", x, "Missing page marker(s): page ", y, " jumps to page ", x, " (missing ", x - y - 1, " page(s))"))
        return F.when(size == 0, F.array(issue(ERROR, name, "none", None, "No page markers found in output"))).otherwise(F.concat(F.array(told), back, gaps))

    return let(F.transform(doc.marks, lambda x: x["page"]), of)


def page_ends(doc: Parts) -> Column:
    name = "Page markers"
    begins = F.transform(doc.marks, lambda x: x["page"])
    ends = F.regexp_extract_all(doc.md, F.lit(java(m.PAGE_END.pattern)), F.lit(1)).cast("array<int>")

    def of(b: Column, e: Column) -> Column:
        told = issue(INFO, name, "ends_found", None, "Page end markers found: ", F.size(e), " markers, range ", F.array_min(e), "-", F.array_max(e))
        loose = F.transform(F.array_sort(F.array_except(e, b)), lambda p: issue(ERROR, name, "unmatched_end", p, "PDF_PAGE_END ", p, " has no matching PDF_PAGE_BEGIN"))
        open_ = F.transform(F.array_sort(F.array_except(b, e)), lambda p: issue(ERROR, name, "missing_end", p, "PDF_PAGE_BEGIN ", p, " has no matching PDF_PAGE_END"))
        no_end = only(F.size(b) > 0, issue(ERROR, name, "no_end", None, "No PDF_PAGE_END markers found (PDF_PAGE_BEGIN markers present)"))
        return F.when(F.size(e) == 0, no_end).otherwise(F.concat(F.array(told), loose, open_))

    return let(begins, lambda b: let(F.coalesce(ends, F.array().cast("array<int>")), lambda e: of(b, e)))


def image_blocks(doc: Parts) -> Column:
    name = "Image block pairing"
    begin, end = (java(x.pattern) for x in (m.IMAGE_BEGIN, m.IMAGE_END))
    page = F.lit(None).cast("int")
    events = F.transform(
        F.filter(F.split(doc.md, LINE_END, -1), lambda s: s.contains("<!--")),
        lambda s: F.struct(F.nullif(F.regexp_extract(s, java(m.PAGE_BEGIN.pattern), 1), F.lit("")).cast("int").alias("page"), s.rlike(begin).alias("begins"), s.rlike(end).alias("ends")),
    )
    events = F.filter(events, lambda e: e["page"].isNotNull() | e["begins"] | e["ends"])
    start = F.struct(page.alias("page"), F.lit(False).alias("open"), page.alias("since"), F.lit(0).alias("begins"), F.lit(0).alias("ends"), none().alias("issues"))

    def step(acc: Column, e: Column) -> Column:
        now = F.coalesce(e["page"], acc["page"])
        shown = F.coalesce(now.cast("string"), F.lit("None"))
        since = F.coalesce(F.concat(F.lit(" (page "), F.nullif(acc["since"], F.lit(0)).cast("string"), F.lit(")")), F.lit(""))
        nested = only(e["begins"] & acc["open"], issue(ERROR, name, "nested", acc["since"], "Nested IMAGE_BEGIN on page ", shown, " — previous block opened", since, " was not closed"))
        orphan = only(e["ends"] & ~(acc["open"] | e["begins"]), issue(ERROR, name, "orphan_end", now, "IMAGE_END without matching IMAGE_BEGIN on page ", shown))
        is_open = (acc["open"] | e["begins"]) & ~e["ends"]
        return F.struct(
            now.alias("page"), is_open.alias("open"), F.when(e["ends"], page).when(e["begins"], now).otherwise(acc["since"]).alias("since"),
            (acc["begins"] + e["begins"].cast("int")).alias("begins"), (acc["ends"] + e["ends"].cast("int")).alias("ends"), F.concat(acc["issues"], nested, orphan).alias("issues"),
        )

    def finish(acc: Column) -> Column:
        since = F.coalesce(F.concat(F.lit(" on page "), F.nullif(acc["since"], F.lit(0)).cast("string")), F.lit(""))
        unclosed = only(acc["open"], issue(ERROR, name, "unclosed", acc["since"], "IMAGE_BEGIN", since, " was never closed with IMAGE_END"))
        told = only(acc["begins"] + acc["ends"] > 0, issue(INFO, name, "counts", None, "Image blocks: ", acc["begins"], " IMAGE_BEGIN, ", acc["ends"], " IMAGE_END"))
        return F.concat(acc["issues"], unclosed, told)

    return F.aggregate(events, start, step, finish)


def _headings(md: Column) -> Column:
    return F.transform(matches(md, m.HEADING), lambda h: F.struct(h["start"].alias("start"), h["value"].alias("section"), F.regexp_extract(h["value"], r"^(.*)\.[^.]*$", 1).alias("parent"), F.regexp_extract(h["value"], r"([^.]*)$", 1).try_cast("bigint").alias("number")))


def section_gaps(doc: Parts) -> Column:
    name = "Section gap"
    named = lambda parent, n: F.concat(F.when(parent == "", "").otherwise(F.concat(parent, F.lit("."))), n.cast("string"))

    def of(h: Column, marks: Column) -> Column:
        """Of each parent, in order of its first heading, the numbers in order; a number's page is that of its first heading."""
        ranked = F.array_sort(F.transform(h, lambda x: F.struct(x["parent"].alias("parent"), x["number"].alias("number"), x["start"].alias("start"))))
        firsts = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["parent"] != x["parent"]) | (F.get(r, i - 1)["number"] != x["number"])))
        gaps = let(firsts, lambda f: pairs(f, lambda x, y: (x["parent"] == y["parent"]) & (x["number"] - y["number"] > 1)))
        parents = F.array_distinct(F.transform(h, lambda x: x["parent"]))
        ordered = let(parents, lambda ps: F.array_sort(F.transform(gaps, lambda g: F.struct(F.array_position(ps, g["now"]["parent"]).alias("rank"), g["now"].alias("now"), g["before"].alias("before")))))

        def made(n: Column, before: Column) -> Column:
            return on_page(marks, n["start"], lambda page: issue(WARNING, name, "gap", page, "Section gap: section ", named(n["parent"], before["number"]), " jumps to section ", named(n["parent"], n["number"]), " (missing ", n["number"] - before["number"] - 1, " section(s))", at_page(page)))

        return F.transform(ordered, lambda g: made(g["now"], g["before"]))

    numbered = F.filter(doc.headings, lambda x: x["number"].isNotNull())
    return F.when(F.size(doc.headings) < 2, none()).otherwise(let(numbered, lambda h: let(doc.marks, lambda marks: of(h, marks))))


def duplicate_headings(doc: Parts) -> Column:
    name = "Duplicate headings"
    rx = r"(?m)^#{1,6}[^\S\n]+((?:[A-Z]|\d+)(?:\.(?:[A-Z]|\d+))*)[^\S\n]+[^\n]*"

    def of(h: Column, marks: Column) -> Column:
        """``h`` by section and place: what is of one section stands together."""
        firsts = F.filter(F.transform(h, lambda x, i: i), lambda i: (i == 0) | (F.get(h, i - 1)["value"] != F.get(h, i)["value"]))
        runs = let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(i.alias("at"), (F.coalesce(F.get(f, k + 1), F.size(h)) - i).alias("n"))))
        section = lambda r: F.get(h, r["at"])["value"]
        ordered = F.array_sort(F.transform(F.filter(runs, lambda r: r["n"] > 1), lambda r: F.struct(section_key(section(r)).alias("key"), section(r).alias("s"), r["at"].alias("at"), r["n"].alias("n"))))

        def one(r: Column) -> Column:
            pages = F.transform(F.slice(h, r["at"] + 1, r["n"]), lambda x: F.concat(F.lit("p"), F.coalesce(last_before(marks, x["start"], "page"), F.lit(0)).cast("string")))
            return issue(WARNING, name, "section", None, "  Section ", r["s"], " appears ", r["n"], " times (pages: ", F.array_join(pages, ", "), ")")

        def told(rs: Column) -> Column:
            total = issue(WARNING, name, "total", None, "Duplicate section headings: ", F.size(rs), " sections appear more than once")
            return F.when(F.size(rs) == 0, none()).otherwise(F.concat(F.array(total), F.transform(rs, one)))

        return let(ordered, told)

    found = F.filter(matches(doc.md, rx), lambda x: ~x["text"].rlike(java(m.PAGE_BEGIN.pattern)))
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"))))
    return let(ranked, lambda h: let(doc.marks, lambda marks: of(h, marks)))


def section_order(doc: Parts) -> Column:
    def of(h: Column, marks: Column) -> Column:
        def made(x: Column, y: Column) -> Column:
            return on_page(marks, x["start"], lambda page: issue(WARNING, "Section ordering", "backward", page, "Section ordering: ", x["section"], " follows ", y["section"], " (backward jump)", at_page(page)))

        return steps(h, lambda x, y: x["key"] < y["key"], made)

    keyed = F.transform(doc.headings, lambda x: F.struct(x["start"].alias("start"), x["section"].alias("section"), section_key(x["section"]).alias("key")))
    return let(keyed, lambda h: let(doc.marks, lambda marks: of(h, marks)))


def missing(doc: Parts, kind: str) -> Column:
    """Numbers of tables (or figures) that are mentioned but have no caption."""
    defined = F.regexp_extract_all(doc.md, F.lit(java(m.definition(kind))), F.lit(1))

    def of(refs: Column, marks: Column) -> Column:
        numbers = F.array_except(F.array_distinct(F.transform(refs, lambda x: x["value"])), defined)

        def one(n: Column) -> Column:
            own = F.filter(refs, lambda x: x["value"] == n)
            pages = F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda x: last_before(marks, x["start"], "page")), lambda p: p.isNotNull())))

            def told(ps: Column) -> Column:
                where = F.when(F.size(ps) > 0, F.concat(F.lit(" (referenced on page "), F.array_join(ps.cast("array<string>"), ", "), F.lit(")"))).otherwise("")
                return issue(WARNING, "Missing table/figure reference", kind.lower(), F.get(ps, F.lit(0)), f"{kind} ", n, " is referenced in text but not defined in output", where)

            return let(pages, told)

        ordered = F.transform(F.array_sort(F.transform(numbers, lambda n: F.struct(n.cast("bigint").alias("v"), n.alias("n")))), lambda x: x["n"])
        return F.transform(ordered, one)

    refs = F.filter(matches(doc.md, m.reference(kind)), lambda x: x["value"].rlike("^[0-9]+$"))
    return let(refs, lambda r: let(doc.marks, lambda marks: of(r, marks)))


def with_place(doc: Parts, marks: Column, t: Column, made: Callable[[Column, Column], Column]) -> Column:
    """``made(page, where)`` of a table: its page, and its title and page as words."""
    named = lambda page: F.concat(F.coalesce(tokens.title_before(doc.md, t["start"]), F.lit("HTML table")), at_page(page))
    return on_page(marks, t["start"], lambda page: let(named(page), lambda where: made(page, where)))


def binary_sequences(doc: Parts) -> Column:
    name = "Binary sequence"

    def of(found: Column, marks: Column) -> Column:
        def of_table(t: Column) -> Column:
            bits = F.regexp_extract_all(t["text"], F.lit(java(m.BINARY)), F.lit(1))
            values = F.transform(bits, lambda b: F.struct(b.alias("bits"), F.conv(b, 2, 10).cast("int").alias("v")))

            def made(x: Column, y: Column, page: Column, where: Column) -> Column:
                same = issue(WARNING, name, "duplicate", page, "Duplicate binary value in ", where, ": ", x["bits"], "b appears twice consecutively")
                back = issue(WARNING, name, "backward", page, "Binary sequence not monotonic in ", where, ": ", x["bits"], "b follows ", y["bits"], "b")
                return F.when(x["v"] == y["v"], same).otherwise(back)

            def told(ps: Column) -> Column:
                return F.when(F.size(ps) == 0, none()).otherwise(with_place(doc, marks, t, lambda page, where: F.transform(ps, lambda p: made(p["now"], p["before"], page, where))))

            return let(let(values, lambda v: pairs(v, lambda x, y: x["v"] <= y["v"])), told)

        return F.flatten(F.transform(found, of_table))

    return let(doc.tables, lambda t: let(doc.marks, lambda marks: of(t, marks)))


def column_counts(doc: Parts) -> Column:
    """Rows whose width isn't the table's most frequent one, three a table and the number of others; heads and bodies with
    different usual widths."""
    name = "Table column consistency"
    of_section = lambda rows, s: F.transform(F.filter(rows, lambda r: r["section"] == s), lambda r: r["width"])
    mode = lambda x: F.array_max(F.transform(F.array_distinct(x), lambda w: F.struct(F.size(F.filter(x, lambda y: y == w)).alias("n"), w.alias("w"))))["w"]
    span = lambda x: F.when(F.array_min(x) == F.array_max(x), F.array_min(x).cast("string")).otherwise(F.concat_ws("-", F.array_min(x).cast("string"), F.array_max(x).cast("string")))

    def issues_of(rows: Column, head: Column, body: Column, expected: Column, page: Column, where: Column) -> Column:
        differ = only(
            (F.size(head) > 0) & (F.size(body) > 0) & F.coalesce(mode(head) != mode(body), F.lit(False)),
            issue(WARNING, name, "header_vs_body", page, where, ": header rows define ", span(head), " columns but body rows have ", span(body), " columns (expected ", expected, ")"),
        )

        def odd(o: Column) -> Column:
            listed = F.transform(F.slice(o, 1, 3), lambda r: issue(WARNING, name, "row", page, where, ": row ", r["at"], " has ", r["width"], " columns, expected ", expected))
            more = only(F.size(o) > 3, issue(WARNING, name, "more", page, where, ": ... and ", F.size(o) - 3, " more row(s) with column count != ", expected))
            return F.concat(differ, listed, more)

        return let(F.filter(rows, lambda r: r["width"] != expected), odd)

    def of(found: Column, marks: Column) -> Column:
        def of_table(t: Column) -> Column:
            rows = F.flatten(F.transform(tokens.sections_of(t["text"]), lambda s: F.transform(tables.widths(s["rows"]), lambda w: F.struct(s["section"].alias("section"), w.alias("width")))))
            rows = F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["section"].alias("section"), r["width"].alias("width")))

            def told(rs: Column, all_: Column) -> Column:
                uneven = lambda page, where: let(of_section(rs, "head"), lambda h: let(of_section(rs, "body"), lambda b: let(mode(all_), lambda e: issues_of(rs, h, b, e, page, where))))
                return F.when(F.size(F.array_distinct(all_)) < 2, none()).otherwise(with_place(doc, marks, t, uneven))

            return let(rows, lambda rs: let(F.transform(rs, lambda r: r["width"]), lambda all_: told(rs, all_)))

        return F.flatten(F.transform(found, of_table))

    return let(doc.tables, lambda t: let(doc.marks, lambda marks: of(t, marks)))


def tables_checked(doc: Parts) -> Column:
    n = F.size(doc.tables)
    return only(n > 0, issue(INFO, "Table column consistency", "checked", None, "Tables checked: ", n, F.when(n == 1, " table").otherwise(" tables")))


def suspect_text(doc: Parts) -> Column:
    def of(marks: Column) -> Column:
        def one(name: str, pattern: str) -> Column:
            place = F.length(F.get(F.split(doc.md, java(pattern), 2), F.lit(0)))
            text = F.substring(F.regexp_extract(doc.md, java(pattern), 0), 1, 100)
            told = on_page(marks, place, lambda page: issue(ERROR, "Fabrication detection", name, page, f"Possible fabricated {name}", at_page(page), ': "', text, '"'))
            return only(doc.md.rlike(java(pattern)), told)

        return F.concat(*(one(*x) for x in m.SUSPECT))

    return let(doc.marks, of)


#: Checks inside a row, by their place in the order of emission.
CHECKS = {
    1: page_marks, 2: page_ends, 3: image_blocks, 4: section_gaps, 5: duplicate_headings, 6: section_order,
    7: lambda doc: missing(doc, "Table"), 8: lambda doc: missing(doc, "Figure"), 9: binary_sequences, 10: column_counts, 11: tables_checked, 12: suspect_text,
}
COLUMNS = ("doc_id", "check_ord", "ord", "severity", "category", "kind", "page_no", "message")


def with_parts(docs: DataFrame) -> tuple[DataFrame, Parts]:
    """Documents with what several checks look for, and the columns that hold it."""
    md = F.col("md")
    rows = docs.select("doc_id", "md", tokens.pages_of(md).alias("marks"), _headings(md).alias("headings"), matches(md, m.TABLE, 0).alias("tables"))
    return rows, Parts(*(F.col(c) for c in Parts._fields))


def issues(docs: DataFrame, which: int) -> DataFrame:
    """The issues of one check."""
    rows, doc = with_parts(docs)
    rows = rows.select("doc_id", F.posexplode(CHECKS[which](doc)).alias("ord", "x"))
    return rows.select("doc_id", F.lit(which).alias("check_ord"), "ord", "x.*")


def table_columns(docs: DataFrame) -> DataFrame:
    return issues(docs, 10)


def overlap(docs: DataFrame, source_pages: DataFrame, least: int = 20, least_source: int = 5) -> DataFrame:
    """Pages against the text they come from: doc_id, page_no, n_words, n_common, ratio. ``source_pages``: doc_id, page_no, pdf_text."""
    own = tokens.page_contents(docs).filter(~F.col("body").rlike(java(m.PAGE_SKIP.pattern))).select("doc_id", "page_no", significant_words(F.col("body")).alias("words")).filter(F.size("words") >= least)
    theirs = source_pages.select("doc_id", "page_no", significant_words(F.coalesce("pdf_text", F.lit(""))).alias("source")).filter(F.size("source") >= least_source)
    both = own.join(theirs, ["doc_id", "page_no"])
    n, common = F.size("words"), F.size(F.array_intersect("words", "source"))
    return both.select("doc_id", "page_no", n.alias("n_words"), common.alias("n_common"), (common / n).alias("ratio"))


def fidelity(docs: DataFrame, source_pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pages of which less than ``threshold`` of the words are in their source."""
    name = "Page fidelity"
    low = overlap(docs, source_pages).filter(F.col("ratio") < threshold)
    pages = low.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "ratio"))).alias("pages"))
    total = issue(WARNING, name, "total", None, "Page fidelity: ", F.size("pages"), " page(s) have low text overlap with PDF source")
    percent = lambda r: F.format_string("%.0f%%", F.bround(r * 100, 0))
    each = F.transform("pages", lambda p: issue(WARNING, name, "page", p["page_no"], "  Page ", p["page_no"], ": ", percent(p["ratio"]), " of markdown words found in PDF text (threshold: ", percent(F.lit(threshold)), ")"))
    return pages.select("doc_id", F.lit(13).alias("check_ord"), F.posexplode(F.concat(F.array(total), each)).alias("ord", "x")).select("doc_id", "check_ord", "ord", "x.*")


def validate(docs: DataFrame, source_pages: DataFrame | None = None) -> DataFrame:
    """All issues of all documents (doc_id, md): one scan."""
    rows, doc = with_parts(docs)
    found = F.concat(*(numbered(check(doc), k) for k, check in CHECKS.items()))
    out = rows.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    return out if source_pages is None else out.unionByName(fidelity(docs, source_pages))


def numbered(found: Column, check: int) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.lit(check).alias("check_ord"), i.alias("ord"), *(x[c].alias(c) for c in COLUMNS[3:])))


def summary(found: DataFrame) -> DataFrame:
    """Issues by category and document, with totals by category and over all: category, doc_id, n_errors, n_warnings."""
    counted = found.filter(F.col("severity") != INFO)
    n = lambda s: F.count_if(F.col("severity") == s)
    return counted.rollup("category", "doc_id").agg(n(ERROR).alias("n_errors"), n(WARNING).alias("n_warnings"), F.grouping_id().alias("level"))


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, ok (no error), n_errors, n_warnings of every document."""
    n = lambda s: F.count_if(F.col("severity") == s)
    by = found.groupBy("doc_id").agg(n(ERROR).alias("e"), n(WARNING).alias("w"))
    return docs.select("doc_id").join(by, "doc_id", "left").select("doc_id", (F.coalesce("e", F.lit(0)) == 0).alias("ok"), F.coalesce("e", F.lit(0)).alias("n_errors"), F.coalesce("w", F.lit(0)).alias("n_warnings"))
