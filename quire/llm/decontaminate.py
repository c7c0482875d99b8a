"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Every run of ``k`` words is hashed, and of each ``w`` consecutive hashes the smallest are kept (all equal ones). A span
of ``k + w - 1`` words that a document shares with an item has the same ``w`` hashes on both sides, so its smallest is
kept on both: no such span is missed. Fingerprints of documents join those of items; each hit is checked word by word
and extended up to ``w - 1`` words either way, which covers every shared window that holds the hit. With k = w = 7 that
is 13 words. An item of n < 13 words is one window: k = n and w = 1.

Texts are read once and never move. A bitmap of the items' hashes, of fixed size, tells which of a document's hashes can
meet any; those that the winnowing keeps are written with their words and up to ``w - 1`` neighbours either way, which is
all that checking and extending needs. What follows joins these short rows: with the items' fingerprints (broadcast
within a counted bound; beyond it shuffled, common fingerprints spread over tasks), and the spans with the documents'
numbers of words. A larger benchmark only fills the bitmap: then more of the rows are written, a quarter of all at most.

Nulls and empty texts have no words and are never hit; items with a null id or no word never occur. Repeated document
rows each get their row; items with equal texts all count. Extra columns are ignored. Texts of any length are read
whole. Fingerprints are 64-bit hashes; a collision costs a check but can't add a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, picked, spread_join, written
from .native import bitmap, in_bitmap, let, upto

WINDOW, GRAM = 13, 7
#: What isn't part of a word, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def fingerprints(ws: Column, k: int, w: int, reach: int, bits: Column | None = None) -> Column:
    """Array of (at, hash, k, before, gram, after): 1-based places whose k-gram hash is the smallest of some ``w``
    consecutive ones (and in ``bits``, if given), with the gram's words and ``reach`` neighbours either way."""
    grams = F.transform(upto(F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))

    def kept(h: Column, i: Column) -> Column:
        if w == 1:
            return F.lit(True)
        windows = F.sequence(F.greatest(F.lit(1), i - (w - 1)), F.least(i, F.size(h) - (w - 1)))
        return F.exists(windows, lambda j: F.array_min(F.slice(h, j, w)) == F.get(h, i - 1))

    def places(h: Column) -> Column:
        some = upto(F.size(h)) if bits is None else F.filter(upto(F.size(h)), lambda i: in_bitmap(bits, F.get(h, i - 1)))
        return F.transform(F.filter(F.when(F.size(h) >= w, some).otherwise(upto(F.lit(0))), lambda i: kept(h, i)), lambda i: told(h, i))

    def told(h: Column, i: Column) -> Column:
        start = F.greatest(F.lit(1), i - reach)
        return F.struct(
            i.alias("at"), F.get(h, i - 1).alias("hash"), F.lit(k).alias("k"), F.slice(ws, start, i - start).alias("before"), F.slice(ws, i, k).alias("gram"),
            F.slice(ws, i + k, F.lit(reach)).alias("after"),
        )

    return let(grams, places)


def matching(theirs: Column, ours: Column) -> Column:
    """How many leading words two arrays have in common."""
    first_off = F.array_position(F.transform(theirs, lambda x, i: F.coalesce(F.get(ours, i) == x, F.lit(False))), False)
    return F.when(first_off == 0, F.size(theirs)).otherwise(first_off.cast("int") - 1)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (ids of occurring items as sorted strings), spans of hit words
    (first, last, item_id), over whole texts."""
    items = picked(benchmark, "item_id").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws"))
    items = written(items.filter(F.size("ws") > 0), "items")
    short = sorted(r[0] for r in items.filter(F.size("ws") < window).select(F.size("ws")).distinct().collect())  # at most window - 1 values
    sizes, reach = [(gram, window - gram + 1), *((n, 1) for n in short)], window - gram

    known = None
    for k, w in sizes:
        mine = items.filter(F.size("ws") >= window if w > 1 else F.size("ws") == k)
        found = mine.select("item_id", F.lit(window if w > 1 else k).alias("need"), F.explode(let(F.col("ws"), lambda x: fingerprints(x, k, w, reach))).alias("f"))  # noqa: B023
        known = found if known is None else known.unionByName(found)
    context = [F.col(f"f.{c}").alias(f"its_{c}") for c in ("before", "gram", "after")]
    known = known.select("item_id", "need", "f.hash", "f.k", *context).groupBy("hash", "k", "need", "its_before", "its_gram", "its_after").agg(F.collect_set("item_id").alias("item_ids"))
    known = written(known, "item-fingerprints")
    bits = bitmap(known, "hash")

    none = F.array().cast("array<struct<first:int,last:int,item_id:string>>")
    texts = picked(docs, id_col, text_col)
    if bits is None:
        return texts.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), none.alias("spans"))

    all_prints = lambda x: F.struct(F.size(x).cast("long").alias("n_words"), F.concat(*(fingerprints(x, k, w, reach, bits) for k, w in sizes)).alias("prints"))
    told = texts.select("doc_id", let(words(F.col("text")), all_prints).alias("r")).select("doc_id", "r.*")
    told = written(told.withColumn("row", F.monotonically_increasing_id()), "document-fingerprints")

    met = spread_join(told.select("row", F.explode("prints").alias("f")).select("row", "f.*"), known, ["hash", "k"], "inner", 600)
    left, right = matching(F.reverse("its_before"), F.reverse("before")), matching(F.col("its_after"), F.col("after"))
    first, last = F.col("at") - left, F.col("at") + F.col("k") - 1 + right
    spans = met.filter(F.col("gram") == F.col("its_gram")).select("row", first.alias("first"), last.alias("last"), "need", "item_ids").filter("last - first + 1 >= need")
    spans = spans.select("row", "first", "last", F.explode("item_ids").alias("item_id")).groupBy("row").agg(F.collect_set(F.struct("first", "last", "item_id")).alias("spans"))
    out = told.select("row", "doc_id", "n_words").join(spans, "row", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    return out.select("doc_id", "n_words", F.when(F.size("spans") > 0, hit_words).otherwise(0).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("items"), "spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return r.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p, ws FROM i WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM iw),
lengths AS (SELECT DISTINCT n FROM item_windows),
dw AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lengths WHERE len(ws) >= n),
doc_windows AS (SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS s FROM dw),
hits AS (SELECT r, n, p, item_id FROM doc_windows JOIN item_windows USING (n, s)),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""
