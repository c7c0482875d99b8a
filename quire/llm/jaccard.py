"""Exact n-gram Jaccard self-join by a token-group matrix, in DataFrame expressions only.

1. Every text becomes the set of its hashed word 5-grams. Rows with equal sets form one class; only classes go on.
2. Tokens get a global order, frequent ones last. A class's first n - ceil(0.8 n) + l tokens are its prefix, with
   l = 1 + n // 20; two sets of Jaccard similarity 0.8 or more share the smaller of their l prefix tokens at least.
   Frequent tokens are told by a bitmap of fixed size, filled from a sample of texts. Any order gives the same result:
   the sample bears on speed alone.
3. Classes that share their least common prefix token and are about as large are partitioned into groups of some
   ``GROUP`` members, up to ``MOST`` where many share it, fewer if their texts are long; larger ones are split by hash.
   Each group stores the union of its members' tokens, one member as its base, and of each member what differs from that.
4. A query meets those groups whose members' prefixes hold that many of its prefix tokens; of two groups, only one asks
   the other. Overlap with the union bounds the overlap with every member, so the group is opened only if that reaches
   0.8 of the query; then the exact overlap with each member is told from what differs from the base in both.
5. Links between classes are closed to components by label propagation with pointer jumping, each round a written table.

Copies are counted through their class and never paired. Documents without words have empty sets and link with
nothing. A null text is empty; rows with null ids are documents as others, and a component's id is the smallest id that
isn't null. Repeated rows are separate documents with one id. Extra columns are ignored; texts of any length are read
whole. Tokens are named by 64-bit hashes, texts and classes by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, picked, written
from .native import bitmap, in_bitmap, let, upto

WORDS, GROUP = 5, 16
#: The most members of a group of classes that share their least token and size; between, 4 times the root of their number.
MOST = 256
#: Tokens in a group beyond which it is split, so that one of long texts has fewer members.
TOKENS = 1 << 21
#: Classes with a token beyond which its rows are spread over ``SALTS`` tasks.
HOT, SALTS = 4096, 16
#: The share of texts that fills the bitmap of frequent tokens, and how often a token must be seen in those.
SHARE, SEEN = 32, 4
#: The most tokens that fill it; with fewer bits set than not, it still tells frequent from rare.
FREQUENT = 1 << 18


def shingles(text: Column) -> Column:
    """The sorted set of hashes of 5-word runs; of fewer words, the hash of all."""

    def of(ws: Column) -> Column:
        runs = F.when(F.size(ws) >= WORDS, F.transform(upto(F.size(ws) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(ws, i, WORDS))))
        return F.coalesce(runs, F.when(F.size(ws) > 0, F.array(F.xxhash64(ws))), F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(let(F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), ""), of)))


def needed(n: Column) -> Column:
    """ceil(0.8 n): the tokens that a set must share with any set similar to it."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def alike(n: Column) -> Column:
    """How many prefix tokens a set has in common with any similar set that has no smaller such number."""
    return F.floor(n / 20).cast("int") + 1


def frequent_tokens(texts: DataFrame) -> Column | None:
    """The bitmap of frequent tokens as a constant array of longs; None if there are none."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"))
    often = some.select(F.explode(shingles(F.col("text"))).alias("t")).groupBy("t").count().filter(F.col("count") >= SEEN).orderBy(F.desc("count"), "t").limit(FREQUENT)
    return bitmap(often, "t")


def prefix(tokens: Column, bits: Column | None) -> Column:
    def take(s: Column, cold: Column) -> Column:
        n = F.size(s) - needed(F.size(s)) + alike(F.size(s))
        return F.slice(F.when(F.size(cold) >= n, cold).otherwise(F.concat(cold, F.array_except(s, cold))), 1, n)

    if bits is None:
        return let(tokens, lambda s: F.when(F.size(s) > 0, take(s, s)).otherwise(s))
    return let(tokens, lambda s: F.when(F.size(s) > 0, let(F.filter(s, lambda t: ~in_bitmap(bits, t)), lambda cold: take(s, cold))).otherwise(s))


def links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (q, m) of similar classes, q < m. ``classes``: cid, n, a, b, text_hash (128 bits), prefix; ``texts``: text_hash, text."""
    posted = classes.select("cid", "n", F.explode("prefix").alias("t"))
    twice = posted.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").select("t", (F.col("c") > HOT).alias("hot"))
    shared = written(posted.join(twice, "t"), "shared-tokens")

    # the partition: least shared token and size, split by hash where that has more than a group's classes
    least = shared.groupBy("cid").agg(F.min("t").alias("g"), F.first("n").alias("n")).withColumn("s", F.floor(F.log(F.col("n")) / F.log(F.lit(1.1))).cast("int"))
    members = F.least(F.greatest(F.lit(GROUP), 4 * F.sqrt(F.count("*"))), F.lit(MOST))
    parts = least.groupBy("g", "s").agg(F.ceil(F.greatest(F.count("*") / members, F.sum("n") / TOKENS)).alias("parts"))
    placed = least.join(parts, ["g", "s"]).select("cid", "n", F.xxhash64("g", "s", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("gid"))
    placed = written(placed, "groups")
    posts = written(shared.join(placed.select("cid", "gid"), "cid"), "posts", instead_of=shared)

    ranges = placed.groupBy("gid").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("cid").alias("last"))
    group_posts = posts.select("t", "hot", "gid").distinct().join(ranges, "gid")
    salt = lambda hot: F.explode(F.when(F.col("hot"), hot).otherwise(F.array(F.lit(0)))).alias("salt")
    asked = posts.select("t", F.col("cid").alias("q"), F.col("n").alias("nq"), F.col("gid").alias("own"), salt(F.array(F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))))
    met = asked.join(group_posts.select("t", "gid", "low", "high", "last", salt(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["t", "salt"])
    # of two groups, the classes of one ask the other; the lowest bits of their names choose which, so that both ask as often
    first = (F.col("own") < F.col("gid")) == (F.col("own").bitwiseXOR(F.col("gid")).bitwiseAND(F.lit(1)) == 0)
    met = met.filter(F.when(F.col("own") == F.col("gid"), F.col("last") > F.col("q")).otherwise(first))
    met = met.filter("5 * high >= 4 * nq AND 4 * low <= 5 * nq").groupBy("q", "nq", "gid").agg(F.count("*").alias("common"), F.first("low").alias("low"), F.first(F.col("own") == F.col("gid")).alias("inside"))
    met = written(met.filter(F.col("common") >= alike(F.least("nq", "low"))).select("q", "nq", "gid", "inside"), "met")

    groups = placed.join(met.select("gid").distinct(), "gid", "left_semi")
    wanted = groups.select("cid").union(met.select("q")).distinct()
    wanted = written(classes.select("cid", "a", "b", "text_hash").join(wanted, "cid", "left_semi"), "wanted")
    read = texts.join(bounded(wanted, 60), "text_hash").groupBy("cid", "a", "b").agg(F.first("text").alias("text"))
    read = read.select("cid", "a", "b", shingles(F.col("text")).alias("tokens"))
    sets = written(read.filter((F.xxhash64("tokens") == F.col("a")) & (F.xxhash64(F.lit(1), "tokens") == F.col("b"))).select("cid", "tokens"), "sets")

    # a group is stored as one member's tokens (of large ones, the one closest to the first three), and of each member those in which it differs
    stored = groups.join(sets, "cid").groupBy("gid").agg(F.collect_list(F.struct("cid", "n", "tokens")).alias("whole"))
    close = lambda m: sum(F.size(F.array_intersect(m["tokens"], F.col("whole")[k]["tokens"])) for k in range(3))
    best = F.array_max(F.transform("whole", lambda m, k: F.struct(close(m), k.alias("k"))))["k"]
    stored = stored.withColumn("base", F.get("whole", F.when(F.size("whole") > GROUP, best).otherwise(0))["tokens"])

    def apart(m: Column) -> Column:
        gone = F.array_except("base", m["tokens"])
        return let(gone, lambda x: F.struct(m["cid"].alias("cid"), m["n"].alias("n"), F.size(x).alias("gone"), F.concat(x, F.array_except(m["tokens"], F.col("base"))).alias("differ")))

    stored = stored.select("gid", "base", F.array_distinct(F.flatten("whole.tokens")).alias("union"), F.transform("whole", apart).alias("members"))
    stored = written(stored, "group-matrix")

    query = sets.select(F.col("cid").alias("q"), F.col("tokens").alias("query"))
    opened = met.join(query, "q").join(stored, "gid").filter(F.size(F.array_intersect("query", "union")) >= needed(F.col("nq")))

    def alikes(x: Column) -> Column:
        def similar(m: Column) -> Column:
            near = (~F.col("inside") | (m["cid"] > F.col("q"))) & (5 * F.least(m["n"], F.col("nq")) >= 4 * F.greatest(m["n"], F.col("nq")))
            # |query and m| = |query and base| - |base without m| + |what differs in both|
            enough = lambda both: 9 * (F.size("base") - x["gone"] - m["gone"] + both) >= 4 * (m["n"] + F.col("nq"))
            least = F.least(F.size(x["differ"]), F.size(m["differ"]))
            return near & (enough(F.lit(0)) | (enough(least) & enough(F.size(F.array_intersect(x["differ"], m["differ"])))))

        return F.transform(F.filter("members", similar), lambda m: m["cid"])

    asker = F.struct(F.size(F.array_except("base", "query")).alias("gone"), F.concat(F.array_except("base", "query"), F.array_except("query", "base")).alias("differ"))
    return opened.select("q", F.explode(let(asker, alikes)).alias("m")).select(F.least("q", "m").alias("q"), F.greatest("q", "m").alias("m"))


def components(pairs: DataFrame) -> DataFrame:
    """(cid, root) for every class in ``pairs`` (q, m): the smallest class that it reaches."""
    edges = written(pairs.select(F.col("q").alias("u"), F.col("m").alias("v")).unionByName(pairs.select(F.col("m").alias("u"), F.col("q").alias("v"))), "edges")
    roots = written(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("cid"), F.least("u", "v").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("cid").alias("v"), "root"), "v").groupBy(F.col("u").alias("cid")).agg(F.min("root").alias("near"))
        jump = roots.select(F.col("cid").alias("root"), F.col("root").alias("far"))
        step = roots.join(near, "cid").join(jump, "root").select("cid", F.least("root", "near", "far").alias("new"), (F.least("near", "far") < F.col("root")).alias("moved"))
        step = written(step, "roots")
        roots = step.select("cid", F.col("new").alias("root"))
        if step.filter("moved").isEmpty():
            return roots


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, n_similar, component_id, class_id."""
    docs = picked(docs, id_col, text_col)
    bits = frequent_tokens(docs)
    text_hash = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), F.col("text")).alias("y"))  # of 128 bits
    head = lambda s: F.struct(F.size(s).alias("n"), F.xxhash64(s).alias("a"), F.xxhash64(F.lit(1), s).alias("b"), prefix(s, bits).alias("prefix"))
    rows = written(docs.select("doc_id", text_hash.alias("text_hash"), let(shingles(F.col("text")), head).alias("x")).select("doc_id", "text_hash", "x.*"), "rows")

    classes = rows.filter("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("text_hash").alias("text_hash"), F.first("prefix").alias("prefix"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = written(rows.select("doc_id", "n", "a", "b"), "short-rows", instead_of=rows)
    pairs = written(links(classes.select("cid", "n", "a", "b", "text_hash", "prefix"), docs.select(text_hash.alias("text_hash"), "text")), "links")
    short = classes.select("cid", "copies", "first_id")
    if pairs.isEmpty():
        told = short.select("cid", F.lit(0).cast("long").alias("others"), F.col("first_id").alias("component_id"))
    else:
        both = pairs.unionByName(pairs.select(F.col("m").alias("q"), F.col("q").alias("m")))
        others = both.join(short.select(F.col("cid").alias("m"), "copies"), "m").groupBy(F.col("q").alias("cid")).agg(F.sum("copies").alias("others"))
        roots = components(pairs)
        lowest = roots.join(short, "cid").groupBy("root").agg(F.min("first_id").alias("component_id"))
        told = short.join(others.join(roots, "cid").join(lowest, "root"), "cid", "left").select("cid", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component_id", "first_id").alias("component_id"))
    told = classes.select("a", "b", "cid", "copies").join(told, "cid")
    out = rows.select("doc_id", "n", "a", "b").join(told, ["a", "b"], "left")
    linked = F.when(F.col("n") > 0, F.col("copies") - 1 + F.col("others")).otherwise(0)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), linked.cast("long").alias("n_similar"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[p:p + 4], ' ') AS t FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS p FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT x.r AS r, y.r AS o, count(*) AS i FROM s x JOIN s y ON x.t = y.t AND x.r <> y.r GROUP BY x.r, y.r),
links AS MATERIALIZED (SELECT r, o FROM pairs JOIN n USING (r) JOIN n AS m ON m.r = pairs.o WHERE 100 * i >= 80 * (n.n + m.n - i)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, links.o FROM reach JOIN links ON links.r = reach.o),
low AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r),
near AS (SELECT r, count(*) AS c FROM links GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, 0)::BIGINT AS n_similar, component_id FROM d JOIN low USING (r) LEFT JOIN n USING (r) LEFT JOIN near USING (r)
"""
