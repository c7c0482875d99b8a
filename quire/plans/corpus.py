"""Marked documents, chunks and usage made up from the given tables by the same expressions in Spark and DuckDB.

The tables hold no marked documents, so each query makes its own from whole ``documents``: three lines of text a page,
and headings, references, tables, images and defects by arithmetic on the document's id and the page's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = {
    "spark": "SELECT doc_id AS d, i, line FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n', -1)) AS i, line",
    "duckdb": "SELECT doc_id AS d, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)",
}


def joined(engine: str, value: str, order: str, separator: str = "chr(10)") -> str:
    """Strings of a group in order, joined."""
    if engine == "duckdb":
        return f"string_agg({value}, {separator} ORDER BY {order})"
    return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v), {separator})"


def _case(condition: str, *parts: str) -> str:
    return f"CASE WHEN {condition} THEN {' || '.join(parts)} ELSE '' END"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


NL = "chr(10)"
NUMBER = "CASE WHEN (d * 5 + p) % 13 = 0 AND p > 2 THEN p - 2 ELSE p END"
BITS = "CASE WHEN (d + p) % 3 = 0 THEN '0010b' WHEN (d + p) % 3 = 1 THEN '0001b' ELSE '0100b' END"
ROWS = (
    "'<tr><td rowspan=\"2\">x</td><td>0001b</td><td>z</td></tr>' || chr(10) || '<tr><td>0010b</td><td>z</td>'",
    _case("(d + p) % 6 = 0", "'<td>w</td>'"),
    f"'</tr>' || chr(10) || '<tr><td colspan=\"2\">m</td><td>' || {BITS} || '</td></tr>'",
)
TABLE = " || ".join(["'<table><thead><tr><th>a</th><th>b</th><th>c</th></tr></thead>' || chr(10) || '<tbody>'", *ROWS, "'</tbody></table>'"])
SIMPLE = "'<table><tbody><tr><td>q</td><td>r</td></tr></tbody></table>'"
RECT = f"'<!-- IMAGE_RECT 0.' || {text('(d + p) % 4 + 1')} || ',0.1,0.' || {text('(d + p) % 4 + 5')} || ',0.' || {text('d % 5 + 3')} || ' -->'"
PARTS = (
    f"'## ' || {text('p')} || ' Part' || {NL} || '### ' || {text('p')} || '.1 One' || {NL} || '### ' || {text('p')} || '.' || {text('(d + p) % 4 + 1')} || ' Two' || {NL}",
    _case("(d + p) % 7 = 0", f"'## 1 Again' || {NL}"),
    f"'see Table ' || {text('(d + p) % 5 + 1')} || ' and Figure ' || {text('(d * 3 + p) % 4 + 1')} || {NL} || body || {NL}",
    _case("(d + p) % 4 = 1", f"'<!-- TABLE_CONTINUE -->' || {NL} || {SIMPLE} || {NL}"),
    _case("(d + p) % 2 = 0", f"'**Table ' || {text('(d + p) % 5 + 1')} || ' – Title**' || {NL} || {NL} || {TABLE} || {NL}"),
    _case("(d + p) % 5 = 0", f"'<!-- IMAGE_BEGIN -->' || {NL} || {RECT} || {NL} || '**Figure ' || {text('(d * 3 + p) % 4 + 1')} || ' – Cap**' || {NL} || '<!-- IMAGE_AI_GENERATED_DESCRIPTION_BEGIN -->a drawing<!-- IMAGE_AI_GENERATED_DESCRIPTION_END -->' || {NL}", _case("(d + p) % 35 <> 0", f"'<!-- IMAGE_END -->' || {NL}")),
    _case("(d + p) % 29 = 0", f"'The table data has been omitted here' || {NL}"),
    _case("(d + p) % 8 = 0", f"'trailing   ' || {NL} || {NL} || {NL} || {NL}"),
)
PAGE = (
    f"'<!-- PDF_PAGE_BEGIN ' || {text('n')} || ' -->' || {NL} || CASE WHEN (d * 3 + p) % 10 = 0 THEN '<!-- PDF_PAGE_SKIP -->' || {NL} ELSE "
    + " || ".join(PARTS)
    + f" END || CASE WHEN (d + 2 * p) % 19 = 0 THEN '' WHEN (d + 3 * p) % 23 = 0 THEN '<!-- PDF_PAGE_END ' || {text('n + 1')} || ' -->' ELSE '<!-- PDF_PAGE_END ' || {text('n')} || ' -->' END"
)


def pages_sql(engine: str) -> str:
    """d, p (place), n (number), body, page (text with marks)."""
    return f"""SELECT d, p, n, body, {PAGE} AS page FROM (SELECT d, p, {NUMBER} AS n, body FROM (
      SELECT d, CAST(floor(i / 3) AS BIGINT) + 1 AS p, {joined(engine, 'line', 'i')} AS body FROM ({LINES[engine]}) GROUP BY d, CAST(floor(i / 3) AS BIGINT) + 1) WHERE (d * 7 + p * 3) % 11 <> 0)"""


def documents_sql(engine: str) -> str:
    return f"SELECT d AS doc_id, {joined(engine, 'page', 'p')} AS md FROM ({pages_sql(engine)}) GROUP BY d"


def chunks_sql(engine: str) -> str:
    """doc_id, idx, page_start, md: four pages a chunk; each chunk but the first repeats the page before it, altered."""
    again = "replace(page, ' Part', ' Copy')"
    both = f"SELECT d, CAST(floor((p - 1) / 4) AS INT) AS idx, p, page FROM pages UNION ALL SELECT d, CAST(floor(p / 4) AS INT), p, {again} FROM pages WHERE p % 4 = 0"
    return f"WITH pages AS ({pages_sql(engine)}), parts AS ({both}) SELECT d AS doc_id, idx, CAST(idx * 4 + 1 AS BIGINT) AS page_start, {joined(engine, 'page', 'p')} AS md FROM parts GROUP BY d, idx"


USAGE = """SELECT doc_id, CAST(doc_id % 4 AS INT) AS idx, CASE WHEN doc_id % 3 = 0 THEN 'opus' WHEN doc_id % 3 = 1 THEN 'sonnet' ELSE 'haiku' END AS model, n_chars * 40 AS input_tokens, n_chars AS output_tokens,
  CASE WHEN doc_id % 3 = 1 THEN n_chars * 5 ELSE 0 END AS cache_creation_tokens, CASE WHEN doc_id % 3 = 2 THEN n_chars * 7 ELSE 0 END AS cache_read_tokens FROM {documents}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(documents_sql("spark"), documents=table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(pages_sql("spark"), documents=table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(chunks_sql("spark"), documents=table(spark, sf_dir, "documents"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(USAGE, documents=table(spark, sf_dir, "documents"))
