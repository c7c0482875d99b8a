"""Command line: validate documents, convert or merge chunks, show the prompt, write a rule file."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, chunks, merge, rules
from .plans import pipeline
from .sources import workdir


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire")
    todo = out.add_subparsers(dest="command", required=True)
    p = todo.add_parser("validate", help="check documents; exit 1 if one has an error")
    p.add_argument("path", help="folder or glob of .md files")
    p.add_argument("--pages", help="Parquet of source pages: name, page_no, pdf_text")
    p = todo.add_parser("convert", help="convert pages by a client, or merge what was converted before")
    p.add_argument("root", help="work folder")
    p.add_argument("--pages", help="Parquet of pages: doc_id, page_no, pdf_text")
    p.add_argument("--client", help="module:function that converts a chunk")
    p.add_argument("--from", dest="start", choices=["merge"], help="begin with the chunks in the work folder")
    p.add_argument("--force", action="store_true", help="convert again what is there")
    p.add_argument("--pages-per-chunk", type=int, default=10)
    p.add_argument("--max-pages", type=int)
    p.add_argument("--strip-descriptions", action="store_true")
    p.add_argument("--no-format", action="store_true")
    p = todo.add_parser("show-prompt", help="print the prompt, with a rule file if given")
    p.add_argument("--rules")
    p = todo.add_parser("init-rules", help="write a rule file with everything commented out")
    p.add_argument("path")
    return out


def validate(spark: SparkSession, path: str, pages: str | None) -> int:
    docs = workdir.documents(spark, path).select(F.col("name").alias("doc_id"), "md")
    source = spark.read.parquet(pages).select(F.col("name").alias("doc_id"), "page_no", "pdf_text") if pages else None
    found = checks.summary(checks.validate(docs, source)).orderBy(F.desc("level"), "category", "doc_id").collect()
    for r in found:
        where = "all" if r.level == 3 else r.category + (f", {r.doc_id}" if r.level == 0 else "")
        print(f"{where}: {r.n_errors} errors, {r.n_warnings} warnings")
    return int(any(r.level == 3 and r.n_errors for r in found))


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.start and a.force:
        print("--from and --force don't go together", file=sys.stderr)
        return 2
    failed = 0
    if not a.start:
        if not (a.pages and a.client):
            print("--pages and --client are needed", file=sys.stderr)
            return 2
        module, _, name = a.client.partition(":")
        pages = spark.read.parquet(a.pages)
        totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))
        plan = chunks.plan_chunks(totals, a.pages_per_chunk, a.max_pages)
        if not a.force and _there(spark, f"{a.root}/chunks"):
            # a chunk needs the end of the one before, so a document is converted whole or not at all
            fresh = chunks.fresh_chunks(plan, workdir.read_chunks(spark, a.root)).select("doc_id").distinct()
            plan = plan.join(fresh, "doc_id", "left_semi")
        path = f"{a.root}/converted"
        chunks.convert(plan, pages, getattr(importlib.import_module(module), name)).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        bad: DataFrame = done.filter("status = 'failed'").select("doc_id").distinct()
        failed = bad.count()
        workdir.write_chunks(done.join(bad, "doc_id", "left_anti"), a.root)
    docs = merge.merge_chunks(workdir.read_chunks(spark, a.root))
    result = pipeline.run(docs, pipeline.steps(strip=a.strip_descriptions, formatted=not a.no_format))
    workdir.write_documents(result.documents, a.root)
    print(f"{docs.count()} documents written, {failed} failed")
    return int(failed > 0)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def prompt(spark: SparkSession, path: str | None) -> str:
    if path:
        return rules.system_prompts(rules.parse(spark, path)).first().prompt
    return rules.PREAMBLE_TEXT + "\n\n" + "\n\n".join(f"{k}. {t}" for k, (_, t) in enumerate(rules.REGISTRY, 1))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "init-rules":
        with open(a.path, "w", encoding="utf-8") as f:
            f.write(rules.template())
        return 0
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    if a.command == "validate":
        return validate(spark, a.path, a.pages)
    if a.command == "convert":
        return convert(spark, a)
    print(prompt(spark, a.rules))
    return 0


if __name__ == "__main__":
    sys.exit(main())
