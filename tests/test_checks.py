import random

from pyspark.sql import functions as F

from quire.operators import checks, tables, tokens


def page(n, content):
    return f"<!-- PDF_PAGE_BEGIN {n} -->\n{content}\n<!-- PDF_PAGE_END {n} -->"


def told(spark, md, which=None, severity=None):
    df = spark.createDataFrame([(1, md)], "doc_id bigint, md string")
    rows = (checks.table_columns(df) if which == 10 else checks.issues(df, which) if which else checks.validate(df)).orderBy("check_ord", "ord").collect()
    return [r.message for r in rows if (severity is None or r.severity == severity) and r.severity != "info"]


def test_page_marks(spark):
    assert told(spark, "no marks", 1) == ["No page markers found in output"]
    assert told(spark, "\n".join(page(n, "x") for n in (1, 2, 5, 4)), 1) == ["Page markers not monotonic: page 4 follows page 5", "Missing page marker(s): page 2 jumps to page 5 (missing 2 page(s))"]
    assert told(spark, "<!-- PDF_PAGE_BEGIN 1 -->", 2) == ["No PDF_PAGE_END markers found (PDF_PAGE_BEGIN markers present)"]
    assert told(spark, page(1, "x").replace("END 1", "END 2"), 2) == ["PDF_PAGE_END 2 has no matching PDF_PAGE_BEGIN", "PDF_PAGE_BEGIN 1 has no matching PDF_PAGE_END"]


def test_image_blocks(spark):
    b, e = "<!-- IMAGE_BEGIN -->", "<!-- IMAGE_END -->"
    assert told(spark, page(1, f"{b}\n{e}"), 3) == []
    assert told(spark, page(1, f"{b}\n{b}\n{e}\n{e}"), 3) == ["Nested IMAGE_BEGIN on page 1 — previous block opened (page 1) was not closed", "IMAGE_END without matching IMAGE_BEGIN on page 1"]
    assert told(spark, page(2, b), 3) == ["IMAGE_BEGIN on page 2 was never closed with IMAGE_END"]
    assert told(spark, e, 3) == ["IMAGE_END without matching IMAGE_BEGIN on page None"]
    assert told(spark, f"{b}{e}", 3) == []


def test_sections(spark):
    md = page(1, "# 1 a\n## 3.1 b\n## 3.3 c") + page(2, "# 3 d\n# A x\n# A.1 y\n# A.3 z\n# 1 again")
    assert told(spark, md, 4) == ["Section gap: section 1 jumps to section 3 (missing 1 section(s)) (page 2)", "Section gap: section 3.1 jumps to section 3.3 (missing 1 section(s)) (page 1)", "Section gap: section A.1 jumps to section A.3 (missing 1 section(s)) (page 2)"]
    assert told(spark, md, 5) == ["Duplicate section headings: 1 sections appear more than once", "  Section 1 appears 2 times (pages: p1, p2)"]
    assert told(spark, md, 6) == ["Section ordering: 3 follows 3.3 (backward jump) (page 2)", "Section ordering: 1 follows A.3 (backward jump) (page 2)"]


def test_references(spark):
    md = page(1, "see Table 2 and Table 10, Table A.1, Figure 3") + page(2, "Table 2\n**Table 10 – there**\n**Figure 3: no dash**")
    assert told(spark, md, 7) == ["Table 2 is referenced in text but not defined in output (referenced on page 1, 2)"]
    assert told(spark, md, 8) == ["Figure 3 is referenced in text but not defined in output (referenced on page 1, 2)"]


def test_binary_cells_and_widths(spark):
    cells = lambda *x: "<table>" + "".join(f"<tr><td>{v}</td></tr>" for v in x) + "</table>"
    assert told(spark, page(1, "**Table 3 – t**\n" + cells("0001b", "0001b", "0000b", "0011b")), 9) == ["Duplicate binary value in Table 3 (page 1): 0001b appears twice consecutively", "Binary sequence not monotonic in Table 3 (page 1): 0000b follows 0001b"]
    assert told(spark, cells("0001b") + cells("0000b"), 9) == []
    rows = "<tr><th>a</th><th>b</th><th>c</th></tr>"
    body = "".join(f"<tr>{'<td>x</td>' * n}</tr>" for n in (4, 4, 4, 3, 5, 2, 1))
    found = told(spark, f"<table><thead>{rows}</thead><tbody>{body}</tbody></table>", 10)
    assert found == ["HTML table: header rows define 3 columns but body rows have 1-5 columns (expected 4)", "HTML table: row 0 has 3 columns, expected 4", "HTML table: row 4 has 3 columns, expected 4", "HTML table: row 5 has 5 columns, expected 4", "HTML table: ... and 2 more row(s) with column count != 4"]
    assert told(spark, '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>', 10) == []


def test_suspect_text(spark):
    assert told(spark, page(4, "the data has been omitted"), 12) == ['Possible fabricated omission note (page 4): "data has been omitted"']
    assert told(spark, "Due to the complexity of it, please refer to X", 12) == ['Possible fabricated complexity excuse: "Due to the complexity of it, please refer to"']


def test_folded_and_closed_widths_agree_without_overlap(spark):
    chance = random.Random(3)
    grids = [[[{"colspan": chance.choice((1, 1, 2)) if k % 2 else 1, "rowspan": chance.choice((1, 1, 2, 3)) if not k % 2 else 1} for _ in range(chance.randint(1, 4))] for _ in range(chance.randint(1, 6))] for k in range(80)]
    df = spark.createDataFrame([(g,) for g in grids], "rows array<array<struct<colspan:int,rowspan:int>>>")
    for r in df.select(tables.covered(F.col("rows")).alias("a"), tables.folded(F.to_json("rows")).alias("b")).collect():
        assert r.a == r.b
    # a column span laid over a held slot holds it one row longer
    overlap = [[{"colspan": 1, "rowspan": 1}, {"colspan": 1, "rowspan": 3}], [{"colspan": 2, "rowspan": 1}], [{"colspan": 1, "rowspan": 1}], [{"colspan": 1, "rowspan": 1}]]
    assert spark.createDataFrame([(overlap,)], df.schema).select(tables.folded(F.to_json("rows"))).first()[0] == [2, 2, 2, 2]


def test_fidelity_and_summary(spark):
    words = [f"letters{chr(97 + k)}" for k in range(25)]
    md = page(1, " ".join(words)) + page(2, " ".join(words)) + page(3, "<!-- PDF_PAGE_SKIP -->") + page(4, "few words")
    docs = spark.createDataFrame([(1, md)], "doc_id bigint, md string")
    source = spark.createDataFrame([(1, 1, " ".join(words)), (1, 2, " ".join(words[:10])), (1, 3, "x"), (1, 4, None)], "doc_id bigint, page_no int, pdf_text string")
    assert [r.message for r in checks.fidelity(docs, source).orderBy("ord").collect()] == ["Page fidelity: 1 page(s) have low text overlap with PDF source", "  Page 2: 40% of markdown words found in PDF text (threshold: 50%)"]
    found = checks.validate(docs, source)
    assert [tuple(r) for r in checks.verdicts(docs, found).collect()] == [(1, True, 0, 2)]
    assert checks.summary(found).filter("level = 3").first().n_warnings == 2


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, md string")
    assert {r.doc_id for r in checks.validate(docs).filter("severity = 'error'").collect()} == {1}
    assert checks.validate(docs.limit(0)).collect() == []
    assert tokens.page_blocks(docs).collect() == []


def test_widths_with_overlap_equal_the_plain_fold(spark):
    chance = random.Random(5)
    grids = [[[{"colspan": chance.choice((0, 1, 1, 2, 3)), "rowspan": chance.choice((0, 1, 1, 2, 3, 9))} for _ in range(chance.randint(0, 4))] for _ in range(chance.randint(1, 6))] for _ in range(150)]
    df = spark.createDataFrame([(g,) for g in grids], "rows array<array<struct<colspan:int,rowspan:int>>>")
    for r in df.select("rows", tables.widths(F.col("rows")).alias("a"), tables.folded(F.to_json("rows")).alias("b")).collect():
        assert r.a == r.b, r.rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_checks_are_one_scan_without_python_or_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, page(1, "x"))], "doc_id bigint, md string").write.parquet(str(tmp_path / "docs"))
    found = plan(checks.validate(spark.read.parquet(str(tmp_path / "docs"))))
    assert found.count("Relation [") == 1 and not any(x in found for x in ("ArrowEvalPython", "Window", "Aggregate [", "Union"))


def test_places_of_suspect_text_are_found_once_and_not_for_each_mark(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("md"))
    assert plan(checks.issues(docs, 12)).count("complexity.*?(?:these are|they are|see|refer to), 2)") == 1


def test_pages_by_counting_and_by_halving(spark):
    n = 300
    md = "# 9 first\n" + "\n".join(page(k, f"# {k} a\n# {k}.1 b\n# {k}.4 c") for k in range(1, n))
    assert told(spark, md, 4) == [f"Section gap: section {k}.1 jumps to section {k}.4 (missing 2 section(s)) (page {k})" for k in range(1, n)]
    assert told(spark, md, 5) == ["Duplicate section headings: 1 sections appear more than once", "  Section 9 appears 2 times (pages: p0, p9)"]
