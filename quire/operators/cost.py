"""Token prices and totals: by request, chunk, stage, document and over all. Money is DOUBLE and summed from requests, as a
price tier is chosen for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration

#: alias, model_id, name, rates for input and output per million tokens, the same beyond the threshold, threshold
PRICES = (
    ("opus", "claude-opus-4-6", "Claude Opus 4.6", 5.0, 25.0, 10.0, 37.5, 200_000),
    ("sonnet", "claude-sonnet-4-5", "Claude Sonnet 4.5", 3.0, 15.0, 6.0, 22.5, 200_000),
    ("haiku", "claude-haiku-4-5", "Claude Haiku 4.5", 1.0, 5.0, 1.0, 5.0, 200_000),
)
LIMITS = {"opus": (64_000, 1_000_000, 100, True, True), "sonnet": (64_000, 1_000_000, 100, True, False), "haiku": (64_000, 200_000, 100, False, False)}
WRITE, READ = 2.0, 0.1
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def models(spark: SparkSession) -> DataFrame:
    """The dimension of models: a handful of rows."""
    rows = [(*p, *LIMITS[p[0]]) for p in PRICES]
    return spark.createDataFrame(rows, "model string, model_id string, name string, input_rate double, output_rate double, long_input_rate double, long_output_rate double, threshold long, max_output_tokens long, max_context_tokens long, max_pdf_pages int, long_context boolean, adaptive_thinking boolean")


def thinking(adaptive: Column, budget: int = 10_000) -> Column:
    """The thinking mode of a table repair: adaptive where the model has it, else with a budget."""
    return F.when(adaptive, F.struct(F.lit("adaptive").alias("type"), F.lit(None).cast("int").alias("budget_tokens"))).otherwise(F.struct(F.lit("enabled").alias("type"), F.lit(budget).alias("budget_tokens")))


def with_cost(usage: DataFrame) -> DataFrame:
    """``usage`` (model, token counts) with the cost of each request. Above the threshold, strictly, of all input tokens the
    dearer rates hold for every token; cache writes cost twice and reads a tenth of the input rate."""
    priced = usage.join(F.broadcast(models(usage.sparkSession).select("model", "input_rate", "output_rate", "long_input_rate", "long_output_rate", "threshold")), "model", "left")
    dear = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens") > F.col("threshold")
    rate = F.when(dear, F.col("long_input_rate")).otherwise(F.col("input_rate"))
    out = F.when(dear, F.col("long_output_rate")).otherwise(F.col("output_rate"))
    cost = (F.col("input_tokens") * rate + F.col("cache_creation_tokens") * rate * WRITE + F.col("cache_read_tokens") * rate * READ + F.col("output_tokens") * out) / 1_000_000
    return priced.select(*usage.columns, cost.alias("cost"))


def document_totals(usage: DataFrame) -> DataFrame:
    """Sums by document of chunks' usage with cost."""
    return usage.groupBy("doc_id").agg(F.count("*").alias("chunks"), *(F.sum(c).alias(c) for c in TOKENS), F.sum("cost").alias("cost"))


def with_stages(totals: DataFrame, stages: DataFrame) -> DataFrame:
    """Document totals with those of further stages (doc_id, name, input_tokens, output_tokens, cost, elapsed_seconds) and
    both together. Input of all counts cache tokens."""
    by = stages.groupBy("doc_id").agg(F.sum("input_tokens").alias("stage_input"), F.sum("output_tokens").alias("stage_output"), F.sum("cost").alias("stage_cost"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return totals.join(by, "doc_id", "left").select(
        *totals.columns, whole.alias("total_input_tokens"), (whole + zero(F.col("stage_input"))).alias("total_all_input_tokens"),
        (F.col("output_tokens") + zero(F.col("stage_output"))).alias("total_all_output_tokens"), (F.col("cost") + F.coalesce("stage_cost", F.lit(0.0))).alias("total_cost"),
    )


def rollup(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost by model and document, by model, and over all."""
    return usage.rollup("model", "doc_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in TOKENS), F.sum("cost").alias("cost"), F.grouping_id().alias("level"))


def replaced_stage(stages: DataFrame, name: str, new: DataFrame | None) -> DataFrame:
    """Stages after a step ran again: with results (doc_id, ..., fixed) the old stage of the step goes, and a new one comes where
    something was fixed; without results (None) the old one stays."""
    if new is None:
        return stages
    ran = stages.join(new.select("doc_id").withColumn("name", F.lit(name)), ["doc_id", "name"], "left_anti")
    added = new.filter("fixed > 0").withColumn("name", F.lit(name))
    return ran.select(stages.columns).unionByName(added.select(stages.columns))


def fix_totals(fixes: DataFrame) -> DataFrame:
    """Sums over repaired tables: found, fixed, tokens with cache tokens as input, cost, seconds."""
    return fixes.groupBy("doc_id").agg(
        F.count("*").alias("found"), F.count_if(F.col("after_chars").isNotNull()).alias("fixed"), F.sum(F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")).alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.sum("elapsed_seconds").alias("elapsed_seconds"),
    )


def eta(chunks: DataFrame) -> DataFrame:
    """Seconds left before each chunk: the mean of the chunks before times those to come; null for the first."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("idx")
    before = F.avg("elapsed_seconds").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.count("*").over(Window.partitionBy("doc_id")) - F.row_number().over(order) + 1
    return chunks.select("doc_id", "idx", (before * left).alias("eta_seconds"))


def status_counts(runs: DataFrame) -> DataFrame:
    """converted, cached, failed: how many documents ended so."""
    return runs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("converted", "cached", "failed")))


def summary_lines(totals: DataFrame, wide: bool = True) -> DataFrame:
    """A line of text by document, in columns as wide as their figures need: doc_id, line."""
    name = F.rpad(F.col("doc_id").cast("string"), 30 if wide else 35, " ")
    figures = ["total_all_input_tokens", *(["cache_creation_tokens", "cache_read_tokens"] if wide else []), "total_all_output_tokens"]
    width = 9 if wide else 10
    return totals.select("doc_id", F.concat_ws(" ", name, F.format_string("%5d", "pages"), *(F.format_string(f"%,{width}d", c) for c in figures), F.lpad(duration(F.col("elapsed_seconds").cast("double")), 8 if wide else 10, " "), F.format_string("$%6.2f" if wide else "$%7.2f", "total_cost")).alias("line"))
