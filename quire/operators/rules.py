"""Rule files: text with directives that replace, extend or add to a registry of named rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

PREAMBLE = "preamble"
#: The registry of this engine: name and text, in order.
REGISTRY = (
    ("headings", "Keep numbered headings as they are."), ("page_markers", "Mark where each page begins and ends."), ("tables", "Write tables as HTML with head and body."),
    ("continued_tables", "Mark tables that go on from the page before."), ("figures", "Put each figure in an image block."), ("formulas", "Write formulas in LaTeX."),
    ("skipped_pages", "Mark pages without content as skipped."), ("fidelity", "Leave nothing out and add nothing."),
)
PREAMBLE_TEXT = "Turn the pages into marked text."
NAMES = frozenset({PREAMBLE, *(n for n, _ in REGISTRY)})
DIRECTIVE = r"^@(replace|append|add(?:\s+after)?)\s*(\S+)?\s*$"


def rule_text(rows: Column) -> Column:
    """Lines without comments (``;``), and without blank lines at either end."""
    kept = F.filter(rows, lambda s: ~s.rlike(r"^\s*;"))
    places = lambda k: F.filter(F.transform(k, lambda s, i: F.when(s.rlike(r"(?U)\S"), i)), lambda i: i.isNotNull())
    return let(kept, lambda k: let(places(k), lambda p: F.when(F.size(p) == 0, "").otherwise(F.array_join(F.slice(k, F.array_min(p) + 1, F.array_max(p) - F.array_min(p) + 1), "\n"))))


def sections(files: DataFrame) -> DataFrame:
    """A row per directive of each file (file, text): file, ord, directive, name, line_no (from 1), rule."""
    rows = files.select("file", F.posexplode(F.split("text", r"\r\n|[\n\r]", -1)).alias("i", "line"))
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    is_directive = trimmed.rlike(DIRECTIVE)
    order = Window.partitionBy("file").orderBy("i")
    rows = rows.withColumns({"starts": is_directive, "ord": F.sum(is_directive.cast("int")).over(order), "directive": F.when(is_directive, F.regexp_extract(trimmed, DIRECTIVE, 1)), "name": F.when(is_directive, F.nullif(F.regexp_extract(trimmed, DIRECTIVE, 2), F.lit("")))})
    parts = rows.filter("ord > 0").groupBy("file", "ord").agg(
        F.max("directive").alias("directive"), F.max("name").alias("name"), (F.min("i") + 1).alias("line_no"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("i", "line")))), lambda x: x["line"]).alias("lines"),
    )
    return parts.select("file", "ord", "directive", "name", "line_no", rule_text(F.col("lines")).alias("rule"))


def problems(parsed: DataFrame, names: frozenset[str] = NAMES) -> DataFrame:
    """file, line_no, problem of directives that can't be used. ``@add  after`` with more than one blank matches no branch
    and has none: such a rule is dropped in silence."""
    named, d, n = F.col("directive").isin("replace", "append", "add after"), F.col("directive"), F.col("name")
    own = Window.partitionBy("file", "directive", "name").orderBy("ord")
    before = Window.partitionBy("file", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda what: F.coalesce(F.max((d == what).cast("int")).over(before), F.lit(0)) == 1
    kind = (
        F.when(named & n.isNull(), "name missing").when(named & ~n.isin(*names), "unknown name")
        .when(d.isin("replace", "append") & (F.row_number().over(own) > 1), "duplicate")
        .when((d == "replace") & had("append"), "already appended").when((d == "append") & had("replace"), "already replaced")
        .when((d == "add") & n.isNotNull(), "name not accepted").when(F.col("rule") == "", "no rule text")
    )
    return parsed.select("file", "line_no", kind.alias("problem")).filter("problem IS NOT NULL")


def system_prompts(parsed: DataFrame) -> DataFrame:
    """file, prompt: the registry with a file's replacements, extensions, insertions and additions, numbered from 1. Rules
    inserted after different names share one shift, as each insertion moves what follows it by one more."""
    spark = parsed.sparkSession
    ask = lambda directive: parsed.filter(F.col("directive") == directive)
    base = spark.createDataFrame([(-1, PREAMBLE, PREAMBLE_TEXT), *((k, n, t) for k, (n, t) in enumerate(REGISTRY))], "k int, name string, text string")
    files = parsed.select("file").distinct()
    rules = files.crossJoin(F.broadcast(base))  # the registry has nine rows
    rules = rules.join(ask("replace").select("file", "name", F.col("rule").alias("new")), ["file", "name"], "left").join(ask("append").select("file", "name", F.col("rule").alias("more")), ["file", "name"], "left")
    rules = rules.select("file", "k", F.concat(F.coalesce("new", "text"), F.coalesce(F.concat(F.lit("\n"), "more"), F.lit(""))).alias("text"))
    inserted = ask("add after").join(F.broadcast(base.select("name", "k")), "name").select("file", "k", "ord", "rule")
    every = rules.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("rules"))
    put = inserted.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "k", "rule"))).alias("put"))
    extra = ask("add").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "rule"))).alias("extra"))

    def build(r, p, x) -> str:
        preamble, order = r[0]["text"], [(q["k"], q["text"]) for q in r[1:]]
        own, others = [q for q in p or [] if q["k"] < 0], [q for q in p or [] if q["k"] >= 0]
        order = [(None, q["rule"]) for q in own] + order
        for shift, q in enumerate(others):
            at = next(i for i, (k, _) in enumerate(order) if k == q["k"])
            order.insert(at + 1 + shift, (None, q["rule"]))
        texts = [t for _, t in order] + [q["rule"] for q in x or []]
        return preamble + "\n\n" + "\n\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1))

    prompt = F.udf(build, "string")  # one call a rule file, which is metadata
    return every.join(put, "file", "left").join(extra, "file", "left").select("file", prompt("rules", "put", "extra").alias("prompt"))


def template() -> str:
    """A rule file with every rule commented out."""
    out = ["; Rules: @replace NAME, @append NAME, @add, @add after NAME", "; Names: " + ", ".join(sorted(NAMES)), "; Lines that begin with ; are comments.", ""]
    for name, text in ((PREAMBLE, PREAMBLE_TEXT), *REGISTRY):
        out += [f"; @replace {name}", *(f"; {x}" if x else ";" for x in text.split("\n")), ""]
    return "\n".join([*out, "; @add", "; A rule of your own.", ""])


def parse(spark: SparkSession, path: str) -> DataFrame:
    """The sections of the rule files at ``path``; raises on the first that can't be used."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    parsed = sections(files)
    wrong = problems(parsed).orderBy("file", "line_no").head()
    if wrong:
        raise ValueError(f"{wrong.problem} (line {wrong.line_no} of {wrong.file})")
    return parsed
