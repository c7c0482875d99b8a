import random
import re

from pyspark.sql import functions as F

from quire.functions import markers as m
from quire.functions import text as t


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "md string").select(column).first()[0]


def test_places_equal_those_of_a_regular_expression_engine(spark):
    chance = random.Random(4)
    parts = ["<!-- PDF_PAGE_BEGIN 3 -->", "<!-- PDF_PAGE_END 3 -->", "\n", "## 1.2 x\n", "é日𝒳", "<table>", "</table>", "**Table 3 – x**", "Table 12 ", " "]
    texts = ["".join(chance.choices(parts, k=chance.randint(0, 25))) for _ in range(120)]
    for rx in (m.PAGE_BEGIN.pattern, m.HEADING, m.TABLE, m.reference("Table"), m.definition("Table")):
        group = min(1, re.compile(rx).groups)
        rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, md string").select("k", t.matches(F.col("md"), rx, group).alias("x")).collect()
        for r in rows:
            assert [(x.start, x.end, x.text, x.value) for x in r.x] == [(y.start(), y.end(), y[0], y[group]) for y in re.finditer(rx, texts[r.k])]


def test_scalars(spark):
    seconds = spark.createDataFrame([(k,) for k in (-1.0, 0.0, 45.9, 60.0, 135.0, 3599.0, 3600.0, 3792.0)], "s double")
    assert [r[0] for r in seconds.select(t.duration(F.col("s"))).collect()] == ["0s", "0s", "45s", "1m 00s", "2m 15s", "59m 59s", "1h 00m 00s", "1h 03m 12s"]
    sections = spark.createDataFrame([(s,) for s in ("A.1", "10", "2.10", "2.9", "B", "2", "A")], "s string")
    assert [r[0] for r in sections.orderBy(t.section_key(F.col("s"))).collect()] == ["2", "2.9", "2.10", "10", "A", "A.1", "B"]
    words = one(spark, "<b>Alpha</b> $beta gamma$ <!-- delta --> *Epsilon* alpha tiny", F.array_sort(t.significant_words(F.col("md"))))
    assert words == ["alpha", "epsilon"]
    assert one(spark, "a  \n\n\n\nb\t\n\n", t.spaced(F.col("md"))) == "a\n\nb\n"
    assert one(spark, "Table 3–A B", t.table_file_prefix(F.array(F.lit(4), F.lit(2)), F.col("md"))) == "p002-004_table_3-a_b"
    assert one(spark, "", t.chunk_name(F.lit(0))) == "chunk_01"
    assert one(spark, None, t.content_hash(F.array().cast("array<struct<name:string,content:string>>"))) == ""
    statuses = spark.createDataFrame([(429, None), (400, None), (None, "timeout"), (None, "other"), (None, None)], "status int, kind string")
    assert [r[0] for r in statuses.select(t.retryable(F.col("status"), F.col("kind"))).collect()] == [True, False, True, False, False]
