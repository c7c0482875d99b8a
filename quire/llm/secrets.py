"""Secret scans with an incremental ledger of blobs, in DataFrame expressions only.

Each text is a blob named by its SHA-256. The ledger holds, for every (blob, rule version) pair that was ever scanned,
the spans found. A run takes the distinct blobs of all given versions and paths, scans each only by the rules whose
version the ledger lacks for it, and joins findings back to all rows that hold the blob. Rules carry a version made of
their pattern, so a changed rule is scanned again and the others aren't.

Matches are leftmost and non-overlapping per rule; those whose checked group is too short are dropped after matching.
Places are code points, end exclusive. Null texts count as ''; empty texts have no spans; equal texts (a third of all
rows, say) are scanned once, as partial aggregation leaves one row per blob and task before any shuffle. Repeated rows
and null ids stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, bucket, fits, picked, written
from .native import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``sign`` is a string that every match holds, if there is one; the match stays if the text of
    ``group`` has at least ``least`` code points. Patterns keep to what Java and RE2 read alike."""

    kind: str
    pattern: str
    group: int
    least: int
    sign: str = ""

    @cached_property
    def version(self) -> str:
        return self.kind + "@" + hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The order of kinds in a list of spans. The first three are the base; the rest is what this method adds.
RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),  # runs are taken whole, so shorter ones may as well never match
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    Rule("hosted", "(?:gh[pousr]_|glpat-|xox[abps]-)[A-Za-z0-9_-]+", 0, 20, ""),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule. A text split at its matches gives the lengths between them, whose running sum is the places."""
    parts = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda s: F.length(s))
    checked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda s: F.length(s))
    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    rows = F.filter(F.arrays_zip(parts.alias("p"), lengths.alias("m"), checked.alias("g")), lambda x: x["m"].isNotNull())
    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]
    may = text.contains(rule.sign) if rule.sign else text.rlike(rule.pattern)
    return F.when(may, found).otherwise(none)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after scanning the blobs of ``docs`` (blob, text): one row per blob with its rules (array of versions)
    and spans. ``ledger``: one of earlier runs; its other blobs are kept, spans of versions no longer in use go.

    The ledger is asked with the blobs' names alone. Texts of unseen blobs are then fetched by a broadcast of those names
    within a counted bound; beyond it all distinct texts are shuffled once, and the seen ones dropped where they meet."""
    none, now = F.array().cast(SPAN), F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        new = docs.groupBy("blob").agg(F.first("text").alias("text")).withColumns({"seen": F.array().cast("array<string>"), "old": none})
    else:
        done = ledger.filter(F.size(F.array_except(now, "rules")) == 0).select("blob")
        unseen = written(docs.select("blob").distinct().join(done, "blob", "left_anti"), "unseen-blobs")
        if fits(unseen, 100):
            texts = docs.join(F.broadcast(unseen), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        else:
            texts = docs.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob", "left_semi")
        new = texts.join(ledger.select("blob", F.col("rules").alias("seen"), F.col("spans").alias("old")), "blob", "left")
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    fresh = F.flatten(F.array(*(F.when(~F.array_contains(seen, r.version), scan(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules))))
    kept = lambda old, of: F.filter(F.coalesce(old, none), lambda s: F.exists(of, lambda v: v.startswith(F.concat(s["kind"], F.lit("@"))) & v.isin([r.version for r in rules])))
    told = new.select("blob", now.alias("rules"), F.array_sort(F.concat(kept("old", seen), fresh)).alias("spans"))
    if ledger is None:
        return told
    return told.unionByName(ledger.join(unseen, "blob", "left_anti").select("blob", "rules", F.array_sort(kept("spans", F.col("rules"))).alias("spans")))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(Every document row with doc_id, blob and sorted spans, and ``carry`` as ``row`` if given; the new ledger, written in
    the shared folder)."""
    own = [] if carry is None else [carry.alias("row")]
    named = picked(docs, id_col, text_col, own).withColumn("blob", F.sha2("text", 256))
    told = written(scan_blobs(named.select("blob", "text"), ledger, rules), "ledger")
    found = bounded(told.filter(F.size("spans") > 0).select("blob", "spans"), 1000)
    out = named.drop("text").join(found, "blob", "left")
    return out.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), *["row"] * (carry is not None)), told


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries, by their id: the first fills the ledger; of all versions, the second run scans
    those alone whose blobs the ledger lacks, and findings of both are joined to every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, ledger = find_secrets(docs.filter(bucket(F.col("doc_id"), 2) == 0))
    found, _ = find_secrets(docs, ledger)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        rx = quote(r.pattern)
        parts.append(
            f"SELECT r, {k} AS rank, {quote(r.kind)} AS kind, {r.least} AS least, regexp_split_to_array(t, {rx}) AS p, regexp_extract_all(t, {rx}) AS m,"
            f" regexp_extract_all(t, {rx}, {r.group}) AS g FROM d WHERE regexp_matches(t, {rx})"
        )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
each AS (SELECT r, rank, kind, least, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (SELECT r, rank, kind, length(m[i]) AS n, length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM each WHERE length(g[i]) >= least),
named AS (SELECT r, rank, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM placed),
by_doc AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_doc USING (r)
"""


OP10_SQL = _sql()
