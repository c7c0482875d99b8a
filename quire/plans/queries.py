"""The registered queries. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as m
from ..functions import text as t
from ..operators import checks, chunks, cost, images, joins, merge, rules, tables, tokens
from . import corpus
from .pipeline import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def over(name: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the marked documents."""
    QUERIES[name] = lambda spark, d: plan(corpus.documents(spark, d))


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


over("page_markers_scan", lambda d: long(tokens.page_marks(d), "ord", "start", "page_no"))
over("page_content", lambda d: long(tokens.page_contents(d), "page_no").withColumn("body", F.sha2("body", 256)))
over("page_counts", lambda d: d.select("doc_id", F.transform(tokens.pages_of(F.col("md")), lambda x: x["page"]).alias("p"), F.regexp_count("md", F.lit(t.java(m.PAGE_SKIP.pattern))).cast("bigint").alias("n_skipped")).select("doc_id", "n_skipped", F.size("p").cast("bigint").alias("n_pages"), F.array_min("p").cast("bigint").alias("first_page"), F.array_max("p").cast("bigint").alias("last_page")))
for _name, _check in (("page_sequence", 1), ("page_end_mismatch", 2), ("image_block_pairing", 3), ("heading_gaps", 4), ("duplicate_headings", 5), ("section_backward", 6), ("missing_tables", 7), ("missing_figures", 8), ("binary_sequence", 9), ("tables_checked", 11), ("fabrication_hits", 12)):
    over(_name, lambda d, k=_check: long(checks.issues(d, k), "ord", "page_no").select("doc_id", "ord", "severity", "kind", "page_no", "message"))
over("table_width_issues", lambda d: long(checks.table_columns(d), "ord", "page_no").select("doc_id", "ord", "severity", "kind", "page_no", "message"))
over("table_titles", lambda d: long(tokens.tables(d), "tbl_no", "start", "end").select("doc_id", "tbl_no", "start", "end", "label"))
over("complex_tables", lambda d: long(tokens.complex_tables(d), "tbl_no").select("doc_id", "tbl_no", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.when(F.size("pages") > 0, t.table_file_prefix(F.col("pages"), F.coalesce("label", F.lit("HTML table")))).alias("prefix")))
over("table_row_widths", lambda d: long(tables.row_widths(d), "tbl_no", "row_idx", "width").select("doc_id", "tbl_no", "section", "row_idx", "width"))
over("table_width_mode", lambda d: long(tables.width_modes(d), "tbl_no", "mode"))
over("continued_tables", lambda d: long(tables.islands(d), "tbl_no", "head_no", "n_rows"))
over("significant_words", lambda d: d.select("doc_id", F.array_join(F.array_sort(t.significant_words(F.col("md"))), " ").alias("w")).select("doc_id", F.sha2("w", 256).alias("words_sha256"), F.length("w").cast("bigint").alias("n")))
over("image_rects", lambda d: long(images.image_rects(d), "ord", "page_no"))
over("format_spacing", lambda d: d.select("doc_id", F.sha2(t.spaced(F.col("md")), 256).alias("md")))
over("strip_blocks", lambda d: d.select("doc_id", F.sha2(t.without_descriptions(F.col("md")), 256).alias("md")))
over("prettify_tables", lambda d: tables.format_documents(d).select("doc_id", F.sha2("md", 256).alias("md")))
over("merge_tables_rewrite", lambda d: tables.merge_continued(d).select("doc_id", F.sha2("md", 256).alias("md")))
over("table_context_lines", lambda d: tokens.tables(d).join(d, "doc_id").select("doc_id", F.col("tbl_no").cast("bigint").alias("tbl_no"), tables.context_lines(F.col("md"), F.col("start"), 3, True).alias("before"), tables.context_lines(F.col("md"), F.col("end"), 3, False).alias("after")))
over("validate", lambda d: long(checks.validate(d), "check_ord", "ord", "page_no"))
over("document_verdicts", lambda d: checks.verdicts(d, checks.validate(d)))


@query
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings by category and document, with totals."""
    return long(checks.summary(checks.validate(corpus.documents(spark, d))), "n_errors", "n_warnings", "level")


@query
def page_of_reference(spark: SparkSession, d: str) -> DataFrame:
    """The page of every mention of a table, by an as-of join."""
    docs = corpus.documents(spark, d)
    refs = docs.select("doc_id", F.explode(t.matches(F.col("md"), m.reference("Table"))).alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.value").alias("number"))
    return long(joins.asof(refs, tokens.page_marks(docs), ["doc_id"], "start", "page_no"), "start", "page_no")


@query
def merge_first_writer(spark: SparkSession, d: str) -> DataFrame:
    return long(merge.chunk_pages(corpus.chunks(spark, d)), "idx", "n_pages", "n_new")


@query
def merge_document(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_chunks(corpus.chunks(spark, d)).select("doc_id", F.sha2("md", 256).alias("md"))


@query
def remap_markers(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its pages numbered from its own start, where they aren't yet."""
    rows = corpus.chunks(spark, d)
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.sha2(merge.renumbered(F.col("md"), F.col("page_start") + 3), 256).alias("md"))


@query
def context_tail(spark: SparkSession, d: str) -> DataFrame:
    """The end of each chunk that the next one is given: two pages and 40 lines at least."""
    rows = corpus.chunks(spark, d)
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.sha2(merge.context_tail(F.col("md"), 2, 40), 256).alias("tail"))


@query
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).alias("total_pages"))
    return long(chunks.plan_chunks(docs, 10), "idx", "page_start", "page_end")


@query
def resume_fresh_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunks that aren't cached; those of documents whose manifest changed aren't either."""
    docs = corpus.table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).alias("total_pages"))
    plan = chunks.plan_chunks(docs, 10)
    cached = plan.filter((F.col("doc_id") + F.col("idx")) % 3 != 0).select("doc_id", "idx")
    return long(chunks.fresh_chunks(plan, cached, manifest_changes(spark, d)), "idx", "page_start", "page_end").select("doc_id", "idx", "page_start", "page_end")


@query
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.table(spark, d, "documents")
    new = docs.select("doc_id", F.lit(1.5).alias("pdf_mtime"), F.col("n_chars").alias("pdf_size"), F.ceil(F.col("n_chars") / 500).cast("int").alias("total_pages"), F.lit(10).alias("pages_per_chunk"), F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("int")).otherwise(50).alias("max_pages"), F.lit("m").alias("model_id"), F.lit(1).alias("num_chunks"))
    old = new.filter("doc_id % 11 <> 0").withColumn("max_pages", F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("max_pages")))
    return chunks.manifest_changed(new, old)


@query
def request_cost(spark: SparkSession, d: str) -> DataFrame:
    return cost.with_cost(corpus.usage(spark, d)).select("doc_id", "model", F.round("cost", 8).alias("cost"))


@query
def document_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = cost.with_cost(corpus.usage(spark, d))
    stages = usage.filter("doc_id % 4 = 0").select("doc_id", F.lit("table fixes").alias("name"), F.lit(2000).cast("bigint").alias("input_tokens"), F.lit(1500).cast("bigint").alias("output_tokens"), F.lit(0.15).alias("cost"), F.lit(20.0).alias("elapsed_seconds"))
    out = cost.with_stages(cost.document_totals(usage), stages)
    return out.select("doc_id", "chunks", "total_input_tokens", "total_all_input_tokens", "total_all_output_tokens", F.round("total_cost", 8).alias("total_cost"))


@query
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return long(cost.rollup(cost.with_cost(corpus.usage(spark, d))), "level").withColumn("cost", F.round("cost", 8))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = corpus.table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 3 == 0, "cached").otherwise("converted").alias("status"))
    return cost.status_counts(runs)


@query
def fidelity_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the marked documents against plain pages; every third plain page has lost its longer words."""
    pages = corpus.pages(spark, d)
    source = pages.groupBy(F.col("d").alias("doc_id"), F.col("n").cast("int").alias("page_no")).agg(F.max_by("body", "p").alias("pdf_text"))
    source = source.withColumn("pdf_text", F.when((F.col("doc_id") + F.col("page_no")) % 3 == 0, F.regexp_replace("pdf_text", "[a-z]{7,}", "x")).otherwise(F.col("pdf_text")))
    return long(checks.overlap(corpus.documents(spark, d), source), "page_no", "n_words", "n_common").withColumn("ratio", F.round("ratio", 6))


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return tokens.page_marks(corpus.documents(spark, d)).select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@query
def rect_decisions(spark: SparkSession, d: str) -> DataFrame:
    """How each image region is made, from the rasters on its page."""
    dims = _dims(spark, d)
    clipped = images.clips(images.image_rects(corpus.documents(spark, d)), dims)
    rasters = dims.select("doc_id", "page_no", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("k"))
    x, y = F.col("k") * 150.0, (F.col("page_no") % 3) * 200.0
    rasters = rasters.select("doc_id", "page_no", x.alias("rx0"), y.alias("ry0"), (x + 200.0).alias("rx1"), (y + F.when(F.col("k") == 2, 10.0).otherwise(150.0)).alias("ry1"))
    out = images.decisions(clipped, images.large_rasters(rasters, dims))
    return long(out, "page_no", "idx", "n_matched", "dpi").select("doc_id", "page_no", "idx", "how", "n_matched", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "dpi", "name")


@query
def inject_references(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.documents(spark, d)
    named = images.clips(images.image_rects(docs), _dims(spark, d)).withColumn("name", F.format_string(m.IMAGE_NAME, "page_no", "idx", F.lit("png")))
    return images.inject(docs, images.file_names(named)).select("doc_id", F.sha2("md", 256).alias("md"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    files = corpus.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("content"))).alias("f"))
    return files.select("conv_id", t.content_hash(F.col("f")).alias("hash"))


@query
def rules_sections(spark: SparkSession, d: str) -> DataFrame:
    return long(rules.sections(_rule_files(spark, d)), "ord", "line_no")


@query
def rules_problems(spark: SparkSession, d: str) -> DataFrame:
    return long(rules.problems(rules.sections(_rule_files(spark, d))), "line_no")


@query
def rules_prompts(spark: SparkSession, d: str) -> DataFrame:
    return rules.system_prompts(rules.sections(_rule_files(spark, d)))


def _rule_files(spark: SparkSession, d: str) -> DataFrame:
    lines = ("'; a comment'", "'@replace tables'", "''", "'text ' || CAST(p_partkey AS STRING)", "'; gone'", "''", "'@add after figures'", "'more'", "CASE WHEN p_partkey % 3 = 0 THEN '@add' ELSE '@append headings' END", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '  last' END")
    return corpus.table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS file", " || chr(10) || ".join(lines) + " AS text")


@query
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "events").select("event_id", (F.col("event_id") % 10 + 1).cast("int").alias("attempt"))
    return rows.select("event_id", t.backoff(F.col("attempt")).alias("seconds"))


@query
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "orders")
    return rows.select("o_orderkey", t.duration((F.col("o_orderkey") % 9000) - 20.0 + 0.5).alias("duration"))


@query
def replay_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks merged, tables joined, references put in, texts formatted: the end of every document's path, without a converter."""
    return replay(corpus.chunks(spark, d)).select("doc_id", F.sha2("md", 256).alias("md"), F.length("md").cast("bigint").alias("n"))
