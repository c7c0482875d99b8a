import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import merge, tables
from quire.plans import pipeline

from .test_checks import page


def merged(spark, *parts):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)], "doc_id bigint, idx int, md string")
    return merge.merge_chunks(df).first().md


def column(spark, md, make):
    return spark.createDataFrame([(md,)], "md string").select(make(F.col("md"))).first()[0]


def test_chunks(spark):
    assert merged(spark, "as it is") == "as it is"
    assert merged(spark, " a \n", "  ", "b") == "a\n\nb"
    assert merged(spark, page(1, "a") + page(2, "b"), page(2, "other") + "loose" + page(3, "c")) == "\n\n".join((page(1, "a"), page(2, "b"), page(3, "c")))
    assert merged(spark, page(3, "c"), page(1, "a")) == page(1, "a") + "\n\n" + page(3, "c")


def test_marks_are_renumbered_from_the_first(spark):
    re = lambda md, n: column(spark, md, lambda c: merge.renumbered(c, F.lit(n)))
    assert re(page(1, "x") + "<!--PDF_PAGE_BEGIN  2-->", 11) == page(11, "x") + "<!--PDF_PAGE_BEGIN  12-->"
    for md, n in ((page(11, "x"), 11), (page(12, "x"), 11), ("none", 5), (page(1, "x"), 1)):
        assert re(md, n) == md


def test_context_tails(spark):
    pages = [page(n, "l\n" * 5) for n in range(1, 7)]
    md = "\n".join(pages)
    tail = lambda text, p, n: column(spark, text, lambda c: merge.context_tail(c, p, n))
    assert tail(md, 3, 1) == "\n".join(pages[3:])
    assert tail(md, 1, 20) == "\n".join(pages[3:])
    assert tail(md, 2, 999) == md
    assert tail("a\nb\nc", 3, 2) == "b\nc" and tail("a", 3, 2) == "a"


def table(*rows, head=False):
    return "<table>" + "<thead><tr><th>h</th></tr></thead>" * head + "<tbody>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</tbody></table>"


def test_continued_tables():
    mark = "<!-- TABLE_CONTINUE -->"
    md = f"{table('a', head=True)}\n<!-- PDF_PAGE_END 1 -->\n<!-- PDF_PAGE_BEGIN 2 -->\n{mark}\n**(continued)**\n{table('b', head=True)}\nafter"
    assert tables.join_continued(md) == "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>a</td></tr>\n<!-- PDF_PAGE_END 1 -->\n\n<!-- PDF_PAGE_BEGIN 2 -->\n\n<tr><td>b</td></tr>\n</tbody></table>\nafter"
    three = f"{table('a')}{mark}{table('b')}{mark}{table('c')}"
    assert tables.join_continued(three).count("<table>") == 1 and [x in tables.join_continued(three) for x in "abc"] == [True] * 3
    assert tables.join_continued(f"{mark}{table('a')}") == f"{mark}{table('a')}"
    assert tables.join_continued(f"<table><tbody>{mark}<tr></tr></tbody></table>") == "<table><tbody><tr></tr></tbody></table>"
    assert tables.join_continued(f"<table><tr></tr></table>{mark}{table('a')}") == f"<table><tr></tr></table>{mark}{table('a')}"


def test_pretty_tables():
    html = '<table class="x"><tr><td>a<br>b &amp; c</td><th>d\ne</th></tr><!-- note --></table>'
    expected = '<table class="x">\n  <tr>\n    <td>a<br>b &amp; c</td>\n    <th>d e</th>\n  </tr>\n  <!-- note -->\n</table>'
    assert tables.pretty(html) == expected and tables.pretty(expected) == expected


def test_replaced_tables_and_cache(spark):
    span = '<table><tr><td colspan="2">x</td></tr></table>'
    md = f"one\n{table('plain')}\ntwo\n{span}\nthree\n"
    docs = spark.createDataFrame([(1, md), (2, "none"), (3, None)], "doc_id bigint, md string")
    calls = lambda html, label, pages, before, after: f"<table>{label}|{before}|{after}</table>"
    fixed, results = tables.fix_tables(docs, calls, context=1)
    got = {r.doc_id: r.md for r in fixed.collect()}
    assert got == {1: md.replace(span, "<table>HTML table|two|three</table>"), 2: "none", 3: None}
    cache = results.select("input_hash", "tbl_no", F.lit("<table>kept</table>").alias("html"))
    again, _ = tables.fix_tables(docs, lambda *a: None, spark.createDataFrame(cache.collect(), cache.schema))
    assert again.filter("doc_id = 1").first().md == md.replace(span, "<table>kept</table>")


def test_steps_run_in_order_and_formatting_is_stable(spark):
    docs = spark.createDataFrame([(1, f"a  \n\n\n\n{table('x')}\n<!-- TABLE_CONTINUE -->\n{table('y')}\n"), (2, None)], "doc_id bigint, md string")
    chain = pipeline.steps(strip=True)
    assert [s.key for s in chain] == ["tables", "strip", "format"]
    result = pipeline.run(docs, chain)
    once = {r.doc_id: r.md for r in result.documents.collect()}
    assert once[2] is None and "TABLE_CONTINUE" not in once[1] and "  <tbody>" in once[1]
    twice = pipeline.FORMAT.run(spark.createDataFrame([(1, once[1])], "doc_id bigint, md string")).first().md
    assert twice == once[1] and set(result.timings) == {"tables", "strip", "format"}


def test_texts_are_rewritten_a_piece_at_a_time(monkeypatch):
    class Docs:
        schema = None

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(tables, "PIECE", 10)
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4, 5], "md": ["abc", None, "bcd", "a" * 30, "c"], "more": list("vwxyz")})
    out = list(tables.rewritten(Docs(), str.upper, "a")(iter([batch])))
    assert [b.num_rows for b in out] == [4, 1] and out[0].schema == batch.schema
    assert pa.Table.from_batches(out).to_pydict() == {"doc_id": [1, 2, 3, 4, 5], "md": ["ABC", None, "bcd", "A" * 30, "c"], "more": list("vwxyz")}


def test_rewriting_keeps_no_column_of_texts_in_python(spark):
    docs = spark.createDataFrame([(1, f"{table('a')}<!-- TABLE_CONTINUE -->{table('b')}", "x"), (2, None, "y")], "doc_id bigint, md string, more string")
    for made in (tables.merge_continued(docs), tables.format_documents(docs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
        assert {(r.doc_id, r.more, r.md is None) for r in made.collect()} == {(1, "x", False), (2, "y", True)}
