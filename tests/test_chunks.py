import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, cost, images, joins, rules
from quire.sources import workdir

from .test_checks import page


def test_plans(spark):
    docs = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, 20), (5, 11)], "doc_id bigint, total_pages int")
    got = {}
    for r in chunks.plan_chunks(docs, 10).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.page_start, r.page_end, r.is_first, r.is_last))
    assert got == {1: [(1, 10, True, False), (11, 20, False, False), (21, 25, False, True)], 2: [(1, 10, True, True)], 3: [(1, 0, True, True)], 4: [(1, 10, True, False), (11, 20, False, True)], 5: [(1, 10, True, False), (11, 11, False, True)]}
    assert chunks.plan_chunks(docs, 10, most=12).filter("doc_id = 1").agg(F.max("page_end")).first()[0] == 12


def test_resuming(spark):
    plan = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id bigint, idx int")
    cached = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, idx int")
    changed = spark.createDataFrame([(2, True)], "doc_id bigint, changed boolean")
    assert sorted(map(tuple, chunks.fresh_chunks(plan, cached, changed).collect())) == [(1, 1), (2, 0)]
    manifests = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "doc_id bigint, num_chunks int")
    assert sorted(map(tuple, chunks.missing_chunks(manifests, cached).collect())) == [(1, 2), (1, 3)]
    runs = spark.createDataFrame([(1, False, True, "a", "a"), (2, True, True, "a", "a"), (3, False, False, "a", "a"), (4, False, True, "b", "a"), (5, False, True, None, "a")], "doc_id bigint, force boolean, has_output boolean, old_model string, model string")
    assert {r.doc_id: r.stale for r in chunks.stale(runs).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_conversion_is_ordered_retried_and_isolated(spark):
    plan = chunks.plan_chunks(spark.createDataFrame([(1, 5), (2, 3)], "doc_id bigint, total_pages int"), 2)
    pages = spark.createDataFrame([(d, p, f"text {d}.{p}") for d, n in ((1, 5), (2, 3)) for p in range(1, n + 1)], "doc_id bigint, page_no int, pdf_text string")

    def client(texts, start, end, context):
        if texts[0].startswith("text 2.3"):
            raise ValueError("no")
        return {"md": "\n".join(page(k, t) for k, t in enumerate(texts, 1)) + f"\nafter:{context[-12:]}", "input_tokens": 1, "output_tokens": 2, "cache_creation_tokens": 0, "cache_read_tokens": 0}

    rows = chunks.convert(plan, pages, client).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.idx, r.status) for r in rows] == [(1, 0, "converted"), (1, 1, "converted"), (1, 2, "converted"), (2, 0, "converted"), (2, 1, "failed")]
    assert "PDF_PAGE_BEGIN 3" in rows[1].md and rows[4].error == "no" and rows[4].md is None
    tries = []
    assert chunks._asked(lambda *a: tries.append(1) or (_ for _ in ()).throw(chunks.Retryable()) if len(tries) < 3 else {"md": "x"}, [], 1, 1, "", 5, lambda s: None) == {"md": "x"}
    with pytest.raises(chunks.Retryable):
        chunks._asked(lambda *a: (_ for _ in ()).throw(chunks.Retryable()), [], 1, 1, "", 2, lambda s: None)


def test_costs(spark):
    usage = spark.createDataFrame([(1, "opus", 200_000, 1000, 0, 0), (1, "opus", 200_001, 1000, 0, 0), (2, "haiku", 300_000, 0, 1000, 10_000), (3, "none", 1, 1, 0, 0)], "doc_id bigint, model string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint")
    got = [r.cost for r in cost.with_cost(usage).orderBy("doc_id", "input_tokens").collect()]
    assert got[:3] == pytest.approx([1.025, 2.03751, 0.303]) and got[3] is None
    totals = cost.document_totals(cost.with_cost(usage))
    stages = spark.createDataFrame([(1, "table fixes", 2000, 1500, 0.15, 20.0)], "doc_id bigint, name string, input_tokens bigint, output_tokens bigint, cost double, elapsed_seconds double")
    row = cost.with_stages(totals, stages).filter("doc_id = 1").first()
    assert (row.total_all_input_tokens, row.total_all_output_tokens) == (402_001, 3500) and row.total_cost == pytest.approx(3.21251)
    new = stages.withColumn("fixed", F.lit(0)).drop("name")
    assert cost.replaced_stage(stages, "table fixes", new).count() == 0 and cost.replaced_stage(stages, "table fixes", None).count() == 1


def test_image_regions(spark):
    block = "<!-- IMAGE_BEGIN -->\n<!-- IMAGE_RECT 0.1,0.1,0.2,0.2 -->\n<!-- IMAGE_RECT 0.5,0.5,0.6,0.6 -->\n**cap**\n**other**\n<!-- IMAGE_END -->"
    docs = spark.createDataFrame([(1, block + "\n" + page(2, block + "\n" + block)), (2, None)], "doc_id bigint, md string")
    rects = images.image_rects(docs)
    assert [(r.page_no, r.x0, r.y1, r.caption) for r in rects.orderBy("ord").collect()] == [(2, 0.5, 0.6, "cap")] * 2
    dims = spark.createDataFrame([(1, 2, 100.0, 100.0)], "doc_id bigint, page_no int, width double, height double")
    clips = images.clips(rects, dims)
    rasters = spark.createDataFrame([(1, 2, 40.0, 40.0, 55.0, 55.0), (1, 2, 58.0, 58.0, 90.0, 90.0), (1, 2, 0.0, 0.0, 1.0, 1.0)], "doc_id bigint, page_no int, rx0 double, ry0 double, rx1 double, ry1 double")
    row = images.decisions(clips, images.large_rasters(rasters, dims)).orderBy("idx").first()
    assert (row.how, row.n_matched, row.x0, row.x1, row.name) == ("union", 2, 40.0, 90.0, "img_p002_01.png")
    assert {r.how for r in images.decisions(clips, rasters.limit(0)).collect()} == {"bbox"}
    named = clips.withColumn("name", F.format_string("img_p%03d_%02d.png", "page_no", "idx"))
    text = images.inject(docs, images.file_names(named)).filter("doc_id = 1").first().md
    assert text.count("**cap**\n\n![cap](images/img_p002_01.png)\n") == 1 and text.count("img_p002_02.png") == 1 and text.startswith(block)
    table = spark.range(1).select(images.comparison(F.array(F.lit("a.snap.png"), F.lit("b.png")), F.lit("i"), F.create_map(F.lit("b.png"), F.lit("info")))).first()[0]
    assert table.split("\n")[2:4] == ['<tr><td>snap</td><td><img src="i/a.snap.png"></td><td><small></small></td></tr>', '<tr><td>?</td><td><img src="i/b.png"></td><td><small>info</small></td></tr>']


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (1, 3), (2, 9)], "g int, at int")
    right = spark.createDataFrame([(1, 3, 10), (1, 5, 20)], "g int, at int, v int")
    assert sorted(map(tuple, joins.asof(left, right, ["g"], "at", "v").collect()), key=repr) == sorted([(1, 5, 20), (1, 0, None), (1, 3, 10), (2, 9, None)], key=repr)


def test_rules(spark):
    text = "junk\n@replace tables\n; c\n\n# kept\n\n@append tables\nmore\n@add after nothing\nx\n@add name\ny\n@add\n\n@add  after figures\nlost\n@replace tables\nz\n@append\nq"
    files = spark.createDataFrame([("f", text)], "file string, text string")
    parsed = rules.sections(files)
    assert parsed.orderBy("ord").first().rule == "# kept"
    assert [tuple(r)[1:] for r in rules.problems(parsed).orderBy("line_no").collect()] == [(7, "already replaced"), (9, "unknown name"), (11, "name not accepted"), (13, "no rule text"), (17, "duplicate"), (19, "name missing")]
    good = rules.sections(spark.createDataFrame([("f", "@replace preamble\nP\n@append headings\nH2\n@add after preamble\nfirst\n@add after headings\nsecond\n@add\nlast")], "file string, text string"))
    prompt = rules.system_prompts(good).first().prompt.split("\n\n")
    assert prompt[0] == "P" and prompt[1] == "1. first" and prompt[2].endswith("\nH2") and prompt[3] == "3. second" and prompt[-1].endswith(". last")
    assert "@replace tables" in rules.template()


def test_work_folder(spark, tmp_path):
    root = str(tmp_path / "w")
    made = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "t")], "doc_id bigint, idx int, md string, context_tail string")
    workdir.write_chunks(made, root)
    workdir.write_chunks(spark.createDataFrame([(2, 0, "c", "")], made.schema), root)
    assert sorted(tuple(r) for r in workdir.read_chunks(spark, root).select("doc_id", "idx", "md", "context_tail").collect()) == [(1, 0, "a", ""), (1, 1, "b", "t"), (2, 0, "c", "")]
    manifest = spark.createDataFrame([(1, 1.0, 5, 3, 10, None, "m", 1)], workdir.MANIFEST)
    workdir.write_manifest(manifest, root)
    again = workdir.read_manifest(spark, root)
    assert not chunks.manifest_changed(again, manifest).first().changed
    (tmp_path / "w" / "usage").mkdir()
    (tmp_path / "w" / "usage" / "x.json").write_text("{broken")
    with pytest.raises(Exception):
        workdir.read_usage(spark, root).collect()
    (tmp_path / "w" / "stats").mkdir()
    (tmp_path / "w" / "stats" / "x.json").write_text('{broken\n{"doc_id": 1, "pages": 3}\n')
    assert workdir.read_stats(spark, root).count() == 1
    (tmp_path / "d").mkdir()
    for name in ("b.md", "a.MD", "c.txt"):
        (tmp_path / "d" / name).write_text(name)
    assert [(r.name, r.md) for r in workdir.documents(spark, str(tmp_path / "d")).collect()] == [("a", "a.MD"), ("b", "b.md")]
    assert workdir.output_path("/x/y.pdf") == "/x/y.md" and workdir.output_path("/x/y.pdf", "/o/") == "/o/y.md"
    workdir.invalidate(spark, root)
    assert not (tmp_path / "w").exists()
