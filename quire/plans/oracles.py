"""DuckDB SQL for the registered queries that SQL can express, written from their meaning and not from their plans."""

from __future__ import annotations

from ..functions import markers as m
from . import corpus

DOCS = f"md AS MATERIALIZED ({corpus.documents_sql('duckdb').replace('{documents}', 'documents')})"
PAGES = f"pages_made AS MATERIALIZED ({corpus.pages_sql('duckdb').replace('{documents}', 'documents')})"
CHUNKS = f"chunks AS MATERIALIZED ({corpus.chunks_sql('duckdb').replace('{documents}', 'documents')})"
USAGE = f"usage AS ({corpus.USAGE.replace('{documents}', 'documents')})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rows(name: str, pattern: str, group: int = 1, source: str = "md", key: str = "doc_id", text: str = "md") -> str:
    """A table of all matches: key, o (from 0), s and e (places), t (text), v (group)."""
    rx = lit(pattern)
    return (
        f"{name} AS MATERIALIZED (SELECT {key}, i - 1 AS o, length(array_to_string(p[1:i], '')) + length(array_to_string(a[1:i - 1], '')) AS s, length(array_to_string(p[1:i], '')) + length(array_to_string(a[1:i], '')) AS e, a[i] AS t, b[i] AS v"
        f" FROM (SELECT {key}, p, a, b, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {key}, regexp_split_to_array({text}, {rx}) AS p, regexp_extract_all({text}, {rx}) AS a, regexp_extract_all({text}, {rx}, {group}) AS b FROM {source})))"
    )


MARKS = rows("raw_marks", m.PAGE_BEGIN.pattern) + ", marks AS (SELECT doc_id, o, s, v::BIGINT AS page FROM raw_marks)"
ENDS = rows("raw_ends", m.PAGE_END.pattern) + ", ends AS (SELECT doc_id, o, s, v::BIGINT AS page FROM raw_ends)"
ON_PAGE = "ASOF LEFT JOIN marks ON x.doc_id = marks.doc_id AND x.s >= marks.s"
AT = "coalesce(' (page ' || page || ')', '')"
HEADINGS = (
    rows("raw_headings", m.HEADING)
    + f""", headings AS MATERIALIZED (SELECT x.doc_id, x.o, x.s, x.v AS section, regexp_extract(x.v, '^(.*)\\.[^.]*$', 1) AS parent, try_cast(regexp_extract(x.v, '([^.]*)$', 1) AS BIGINT) AS number, page,
  array_to_string(list_transform(string_split(x.v, '.'), lambda q: CASE WHEN regexp_full_match(q, '[0-9]+') THEN '0' || lpad(q, 12, '0') ELSE '1' || q END), '.') AS sort_key FROM raw_headings AS x {ON_PAGE})"""
)
LABEL = "CASE WHEN len(regexp_extract_all(substr(md.md, greatest(x.s - 200, 0) + 1, x.s - greatest(x.s - 200, 0)), {rx}, 1)) > 0 THEN 'Table ' || regexp_extract_all(substr(md.md, greatest(x.s - 200, 0) + 1, x.s - greatest(x.s - 200, 0)), {rx}, 1)[-1] END".format(rx=lit(m.definition("Table")))
TABLES = rows("raw_tables", m.TABLE, 0) + f", tbl AS MATERIALIZED (SELECT x.doc_id, x.o, x.s, x.e, x.t, {LABEL} AS label, page FROM raw_tables AS x JOIN md USING (doc_id) {ON_PAGE})"
SECTIONS = f"""parts AS (SELECT doc_id, o, 'head' AS section, regexp_extract(t, {lit(m.HEAD)}, 0) AS html FROM tbl UNION ALL SELECT doc_id, o, 'body', regexp_extract(t, {lit(m.BODY)}, 0) FROM tbl),
filled AS (SELECT *, regexp_extract_all(html, {lit(m.ROW)}, 1) AS r FROM parts WHERE len(regexp_extract_all(html, {lit(m.ROW)}, 1)) > 0),
sections AS (SELECT doc_id, o, section, r FROM filled UNION ALL SELECT doc_id, o, 'table', regexp_extract_all(t, {lit(m.ROW)}, 1) FROM tbl WHERE NOT EXISTS (SELECT 1 FROM filled WHERE filled.doc_id = tbl.doc_id AND filled.o = tbl.o)),
table_rows AS (SELECT doc_id, o, section, unnest(range(0, len(r))) AS i, unnest(r) AS h FROM sections),
cells AS (SELECT doc_id, o, section, i, unnest(regexp_extract_all(h, {lit(m.CELL)}, 1)) AS a FROM table_rows),
spans AS (SELECT doc_id, o, section, i, coalesce(try_cast(nullif(regexp_extract(a, {lit(m.COLSPAN)}, 1), '') AS BIGINT), 1) AS c, coalesce(try_cast(nullif(regexp_extract(a, {lit(m.ROWSPAN)}, 1), '') AS BIGINT), 1) AS h FROM cells),
widths AS MATERIALIZED (SELECT q.doc_id, q.o, q.section, q.i, coalesce(sum(s.c), 0)::BIGINT AS width FROM table_rows AS q LEFT JOIN spans AS s ON s.doc_id = q.doc_id AND s.o = q.o AND s.section = q.section AND s.i <= q.i AND q.i < s.i + greatest(s.h, 1) GROUP BY ALL)"""
MODES = "modes AS (SELECT doc_id, o, section, arg_max(width, struct_pack(n := n, w := width)) AS mode FROM (SELECT doc_id, o, section, width, count(*) AS n FROM widths GROUP BY ALL) GROUP BY ALL)"
OUT = "doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1)::BIGINT AS ord, {severity} AS severity, {kind} AS kind, {page} AS page_no, {message} AS message"


def out(order: str, severity: str, kind: str, page: str, message: str) -> str:
    return OUT.format(order=order, severity=severity, kind=kind, page=page, message=message)


def missing(kind: str) -> str:
    return f"""WITH {DOCS}, {MARKS}, {rows("refs", m.reference(kind))},
    defs AS (SELECT doc_id, unnest(regexp_extract_all(md, {lit(m.definition(kind))}, 1)) AS n FROM md),
    found AS (SELECT x.doc_id, x.v AS n, list_sort(list_distinct(list(page))) AS pages FROM refs AS x {ON_PAGE} WHERE regexp_full_match(x.v, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM defs WHERE defs.doc_id = x.doc_id AND defs.n = x.v) GROUP BY ALL)
    SELECT {out("n::BIGINT", "'warning'", lit(kind.lower()), "pages[1]::BIGINT", f"'{kind} ' || n || ' is referenced in text but not defined in output' || CASE WHEN len(pages) > 0 THEN ' (referenced on page ' || array_to_string(pages, ', ') || ')' ELSE '' END")} FROM found"""


def sequence_issues() -> str:
    lagged = "lagged AS (SELECT doc_id, o, page, lag(page) OVER (PARTITION BY doc_id ORDER BY o) AS before FROM marks)"
    skipped = f"len(regexp_extract_all(md, {lit(m.PAGE_SKIP.pattern)}))"
    return f"""WITH {DOCS}, {MARKS}, {lagged},
    every AS (
      SELECT doc_id, 0 AS g, 0 AS o, 'error' AS severity, 'none' AS kind, NULL AS page, 'No page markers found in output' AS message FROM md WHERE doc_id NOT IN (SELECT doc_id FROM marks)
      UNION ALL SELECT doc_id, 0, 0, 'info', 'found', NULL, 'Page markers found: ' || count(*) || ' markers, range ' || min(page) || '-' || max(page) || any_value(CASE WHEN {skipped} > 0 THEN ' (' || {skipped} || ' skipped)' ELSE '' END) FROM marks JOIN md USING (doc_id) GROUP BY doc_id
      UNION ALL SELECT doc_id, 1, o, 'error', 'non_monotonic', page, 'Page markers not monotonic: page ' || page || ' follows page ' || before FROM lagged WHERE page < before
      UNION ALL SELECT doc_id, 2, o, 'error', 'gap', page, 'Missing page marker(s): page ' || before || ' jumps to page ' || page || ' (missing ' || (page - before - 1) || ' page(s))' FROM lagged WHERE page - before > 1)
    SELECT {out("g, o", "severity", "kind", "page", "message")} FROM every"""


def end_issues() -> str:
    return f"""WITH {DOCS}, {MARKS}, {ENDS}, b AS (SELECT DISTINCT doc_id, page FROM marks), e AS (SELECT DISTINCT doc_id, page FROM ends), has AS (SELECT DISTINCT doc_id FROM ends),
    every AS (
      SELECT DISTINCT doc_id, 0 AS g, NULL::BIGINT AS page, 'error' AS severity, 'no_end' AS kind, 'No PDF_PAGE_END markers found (PDF_PAGE_BEGIN markers present)' AS message FROM b WHERE doc_id NOT IN (SELECT doc_id FROM has)
      UNION ALL SELECT doc_id, 0, NULL, 'info', 'ends_found', 'Page end markers found: ' || count(*) || ' markers, range ' || min(page) || '-' || max(page) FROM ends GROUP BY doc_id
      UNION ALL SELECT doc_id, 1, page, 'error', 'unmatched_end', 'PDF_PAGE_END ' || page || ' has no matching PDF_PAGE_BEGIN' FROM (SELECT * FROM e EXCEPT SELECT * FROM b)
      UNION ALL SELECT doc_id, 2, page, 'error', 'missing_end', 'PDF_PAGE_BEGIN ' || page || ' has no matching PDF_PAGE_END' FROM (SELECT * FROM b EXCEPT SELECT * FROM e) WHERE doc_id IN (SELECT doc_id FROM has))
    SELECT {out("g, page", "severity", "kind", "page", "message")} FROM every"""


def image_issues() -> str:
    page, begin, end = (lit(x.pattern) for x in (m.PAGE_BEGIN, m.IMAGE_BEGIN, m.IMAGE_END))
    return f"""WITH {DOCS}, lines AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS l FROM (SELECT doc_id, string_split(md, chr(10)) AS x FROM md)),
    paged AS (SELECT doc_id, i, l, last_value(nullif(regexp_extract(l, {page}, 1), '')::BIGINT IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS page FROM lines),
    events AS (SELECT doc_id, i, 0 AS k, 'b' AS what, page FROM paged WHERE regexp_matches(l, {begin}) UNION ALL SELECT doc_id, i, 1, 'e', page FROM paged WHERE regexp_matches(l, {end})),
    s AS (SELECT *, lag(what) OVER w AS was, lag(page) OVER w AS since, lead(what) OVER w AS next FROM events WINDOW w AS (PARTITION BY doc_id ORDER BY i, k)),
    every AS (
      SELECT doc_id, 0 AS g, i, 'error' AS severity, 'nested' AS kind, since AS page, 'Nested IMAGE_BEGIN on page ' || coalesce(page::VARCHAR, 'None') || ' — previous block opened' || coalesce(' (page ' || nullif(since, 0) || ')', '') || ' was not closed' AS message FROM s WHERE what = 'b' AND was = 'b'
      UNION ALL SELECT doc_id, 0, i, 'error', 'orphan_end', page, 'IMAGE_END without matching IMAGE_BEGIN on page ' || coalesce(page::VARCHAR, 'None') FROM s WHERE what = 'e' AND coalesce(was, 'e') = 'e'
      UNION ALL SELECT doc_id, 1, i, 'error', 'unclosed', page, 'IMAGE_BEGIN' || coalesce(' on page ' || nullif(page, 0), '') || ' was never closed with IMAGE_END' FROM s WHERE what = 'b' AND next IS NULL
      UNION ALL SELECT doc_id, 2, 0, 'info', 'counts', NULL, 'Image blocks: ' || count(*) FILTER (what = 'b') || ' IMAGE_BEGIN, ' || count(*) FILTER (what = 'e') || ' IMAGE_END' FROM events GROUP BY doc_id)
    SELECT {out("g, i", "severity", "kind", "page", "message")} FROM every"""


def gap_issues() -> str:
    named = "CASE WHEN parent = '' THEN '' ELSE parent || '.' END"
    return f"""WITH {DOCS}, {MARKS}, {HEADINGS}, n AS (SELECT doc_id, parent, number, min(s) AS s, arg_min(page, s) AS page FROM headings WHERE number IS NOT NULL GROUP BY ALL),
    p AS (SELECT doc_id, parent, min(s) AS first FROM n GROUP BY ALL), l AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, parent ORDER BY number) AS before FROM n)
    SELECT {out("first, number", "'warning'", "'gap'", "page", f"'Section gap: section ' || {named} || before || ' jumps to section ' || {named} || number || ' (missing ' || (number - before - 1) || ' section(s))' || {AT}")} FROM l JOIN p USING (doc_id, parent) WHERE number - before > 1"""


def duplicate_issues() -> str:
    return f"""WITH {DOCS}, {MARKS}, {HEADINGS}, d AS (SELECT doc_id, section, any_value(sort_key) AS sort_key, count(*) AS n, string_agg('p' || coalesce(page, 0), ', ' ORDER BY o) AS pages FROM headings GROUP BY ALL HAVING count(*) > 1),
    every AS (SELECT doc_id, '' AS k, 'total' AS kind, 'Duplicate section headings: ' || count(*) || ' sections appear more than once' AS message FROM d GROUP BY doc_id
      UNION ALL SELECT doc_id, sort_key, 'section', '  Section ' || section || ' appears ' || n || ' times (pages: ' || pages || ')' FROM d)
    SELECT {out("k", "'warning'", "kind", "NULL::BIGINT", "message")} FROM every"""


def order_issues() -> str:
    return f"""WITH {DOCS}, {MARKS}, {HEADINGS}, l AS (SELECT *, lag(section) OVER w AS before, lag(sort_key) OVER w AS k FROM headings WINDOW w AS (PARTITION BY doc_id ORDER BY o))
    SELECT {out("o", "'warning'", "'backward'", "page", f"'Section ordering: ' || section || ' follows ' || before || ' (backward jump)' || {AT}")} FROM l WHERE sort_key < k"""


def binary_issues() -> str:
    where = f"coalesce(label, 'HTML table') || {AT}"
    return f"""WITH {DOCS}, {MARKS}, {TABLES}, b AS (SELECT doc_id, o, label, page, unnest(range(0, len(x))) AS i, unnest(x) AS bits FROM (SELECT *, regexp_extract_all(t, {lit(m.BINARY)}, 1) AS x FROM tbl)),
    v AS (SELECT *, list_reduce(list_transform(string_split(bits, ''), lambda c: c::BIGINT), lambda a, c: a * 2 + c) AS n FROM b), l AS (SELECT *, lag(n) OVER w AS m, lag(bits) OVER w AS before FROM v WINDOW w AS (PARTITION BY doc_id, o ORDER BY i))
    SELECT {out("o, i", "'warning'", "CASE WHEN n = m THEN 'duplicate' ELSE 'backward' END", "page", f"CASE WHEN n = m THEN 'Duplicate binary value in ' || {where} || ': ' || bits || 'b appears twice consecutively' ELSE 'Binary sequence not monotonic in ' || {where} || ': ' || bits || 'b follows ' || before || 'b' END")} FROM l WHERE n <= m"""


def suspect_issues() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {lit(name)} AS kind, length(regexp_split_to_array(md, {lit(rx)})[1]) AS s, regexp_extract(md, {lit(rx)}, 0) AS t FROM md WHERE regexp_matches(md, {lit(rx)})" for k, (name, rx) in enumerate(m.SUSPECT))
    return f"""WITH {DOCS}, {MARKS}, x AS ({each}), y AS (SELECT x.doc_id, k, kind, t, page FROM x {ON_PAGE})
    SELECT {out("k", "'error'", "kind", "page", f"'Possible fabricated ' || kind || {AT} || ': " + '"' + "' || substr(t, 1, 100) || '" + '"' + "'")} FROM y"""


def width_issues() -> str:
    where = f"coalesce(label, 'HTML table') || {AT}"
    span = lambda s: f"CASE WHEN {s}_low = {s}_high THEN {s}_low::VARCHAR ELSE {s}_low || '-' || {s}_high END"
    return f"""WITH {DOCS}, {MARKS}, {TABLES}, {SECTIONS}, {MODES},
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o ORDER BY section = 'body', i) - 1 AS a FROM widths),
    whole AS (SELECT doc_id, o, arg_max(width, struct_pack(n := n, w := width)) AS expected FROM (SELECT doc_id, o, width, count(*) AS n FROM widths GROUP BY ALL) GROUP BY ALL HAVING sum(n) > 1),
    ranges AS (SELECT doc_id, o, min(width) FILTER (section = 'head') AS h_low, max(width) FILTER (section = 'head') AS h_high, min(width) FILTER (section = 'body') AS b_low, max(width) FILTER (section = 'body') AS b_high FROM widths GROUP BY ALL),
    differ AS (SELECT h.doc_id, h.o FROM modes AS h JOIN modes AS b ON h.doc_id = b.doc_id AND h.o = b.o AND h.section = 'head' AND b.section = 'body' AND h.mode <> b.mode),
    odd AS (SELECT p.*, expected, row_number() OVER (PARTITION BY p.doc_id, p.o ORDER BY a) AS k, count(*) OVER (PARTITION BY p.doc_id, p.o) AS total FROM placed AS p JOIN whole USING (doc_id, o) WHERE width <> expected),
    every AS (
      SELECT doc_id, o, 0 AS g, 'header_vs_body' AS kind, ': header rows define ' || {span('h')} || ' columns but body rows have ' || {span('b')} || ' columns (expected ' || expected || ')' AS tail FROM differ JOIN ranges USING (doc_id, o) JOIN whole USING (doc_id, o)
      UNION ALL SELECT doc_id, o, k, 'row', ': row ' || a || ' has ' || width || ' columns, expected ' || expected FROM odd WHERE k <= 3
      UNION ALL SELECT doc_id, o, 9, 'more', ': ... and ' || (total - 3) || ' more row(s) with column count != ' || expected FROM odd WHERE k = 4)
    SELECT {out("o, g", "'warning'", "kind", "page", f"{where} || tail")} FROM every JOIN (SELECT doc_id, o, label, page FROM tbl) USING (doc_id, o)"""


def claims() -> str:
    return rows("blocks", m.PAGE_BLOCK, 1, "chunks", "doc_id, idx") + ", per AS (SELECT doc_id, idx, v::BIGINT AS page, arg_min(t, o) AS block FROM blocks GROUP BY ALL), claims AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS k FROM per)"


def words(column: str) -> str:
    for rx in (m.DESCRIPTION, "(?s)<!--.*?-->", "<[^>]+>", r"(?s)\$\$.*?\$\$", r"\$[^$]+\$", r"[*_#`\[\]()>|]"):
        column = f"regexp_replace({column}, {lit(rx)}, ' ', 'g')"
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z]+')), lambda w: length(w) >= 5)"


def rect_blocks() -> str:
    begin, end, page, rect = (lit(x.pattern) for x in (m.IMAGE_BEGIN, m.IMAGE_END, m.PAGE_BEGIN, m.IMAGE_RECT))
    return f"""lines AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS l FROM (SELECT doc_id, string_split(md, chr(10)) AS x FROM md)),
    marked AS (SELECT doc_id, i, l, last_value(nullif(regexp_extract(l, {page}, 1), '')::BIGINT IGNORE NULLS) OVER w AS page, count(*) FILTER (regexp_matches(l, {begin})) OVER w AS b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    closed AS (SELECT doc_id, b, min(i) AS e, arg_min(page, i) AS page FROM marked WHERE b > 0 AND regexp_matches(l, {end}) AND NOT regexp_matches(l, {begin}) GROUP BY ALL),
    inner_lines AS (SELECT marked.doc_id, marked.b, marked.i, l, closed.page, closed.e FROM marked JOIN closed USING (doc_id, b) WHERE marked.i < e AND NOT regexp_matches(l, {begin})),
    found AS (SELECT doc_id, b, page, e, arg_max(regexp_extract(l, {rect}, 0), i) FILTER (regexp_matches(l, {rect})) AS r, arg_min(regexp_extract(trim(l), {lit(m.BOLD_LINE)}, 1), i) FILTER (regexp_matches(trim(l), {lit(m.BOLD_LINE)})) AS caption FROM inner_lines GROUP BY ALL),
    rects AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1)::BIGINT AS ord, page AS page_no, {", ".join(f"try_cast(regexp_extract(r, {rect}, {k}) AS DOUBLE) AS {c}" for k, c in enumerate(("x0", "y0", "x1", "y1"), 1))}, coalesce(caption, '') AS caption FROM found WHERE r IS NOT NULL AND page IS NOT NULL)"""


def decisions() -> str:
    side = lambda c: f"greatest(0.0, least(1.0, {c} {'+' if c[1] == '1' else '-'} 0.01)) * {'612.0' if c[0] == 'x' else '792.0'} AS {c}"
    pick = lambda a, b: f"round(CASE WHEN how = 'bbox' THEN {a} ELSE {b} END, 6) AS {a}"
    return f"""WITH {DOCS}, {MARKS}, {rect_blocks()}, dims AS (SELECT DISTINCT doc_id, page AS page_no FROM marks),
    clips AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS idx, {", ".join(map(side, ("x0", "y0", "x1", "y1")))} FROM rects),
    rasters AS (SELECT doc_id, page_no, k * 150.0 AS a0, (page_no % 3) * 200.0 AS b0, k * 150.0 + 200.0 AS a1, (page_no % 3) * 200.0 + CASE WHEN k = 2 THEN 10.0 ELSE 150.0 END AS b1 FROM (SELECT doc_id, page_no, unnest(range(0, doc_id % 3 + 1)) AS k FROM dims)),
    large AS (SELECT * FROM rasters WHERE (a1 - a0) * (b1 - b0) / (612.0 * 792.0) >= 0.02),
    met AS (SELECT c.*, a0, b0, a1, b1 FROM clips AS c LEFT JOIN large AS r ON c.doc_id = r.doc_id AND c.page_no = r.page_no AND least(x1, a1) > greatest(x0, a0) AND least(y1, b1) > greatest(y0, b0)),
    g AS (SELECT doc_id, page_no, idx, x0, y0, x1, y1, count(a0) AS n_matched, min(a0) AS u0, min(b0) AS u1, max(a1) AS u2, max(b1) AS u3 FROM met GROUP BY ALL),
    h AS (SELECT *, CASE WHEN n_matched = 0 THEN 'bbox' WHEN n_matched = 1 THEN 'native' ELSE 'union' END AS how FROM g)
    SELECT doc_id, page_no, idx::BIGINT AS idx, how, n_matched, {pick('x0', 'u0')}, {pick('y0', 'u1')}, {pick('x1', 'u2')}, {pick('y1', 'u3')}, 600::BIGINT AS dpi, 'img_p' || lpad(page_no::VARCHAR, 3, '0') || '_' || lpad(idx::VARCHAR, 2, '0') || '.png' AS name FROM h"""


def tail() -> str:
    newlines = "length({x}) - length(replace({x}, chr(10), ''))"
    cut = "substr(md, s[len(s) - k + 1] + 1)"
    return f"""WITH {CHUNKS}, {rows("b", m.PAGE_BEGIN.pattern, 1, "chunks", "doc_id, idx")}, p AS (SELECT doc_id, idx, list(s ORDER BY o) AS s FROM b GROUP BY ALL),
    k AS (SELECT doc_id, idx, md, s, unnest(range(least(2, len(s)), len(s) + 1)) AS k FROM chunks JOIN p USING (doc_id, idx)),
    fit AS (SELECT doc_id, idx, arg_min({cut}, k) AS t FROM k WHERE k = len(s) OR {newlines.format(x=cut)} >= 40 GROUP BY ALL)
    SELECT doc_id, idx::BIGINT AS idx, sha256(coalesce(t, array_to_string(string_split(md, chr(10))[greatest(len(string_split(md, chr(10))) - 39, 1):], chr(10)))) AS tail FROM chunks LEFT JOIN fit USING (doc_id, idx)"""


def remap() -> str:
    def shifted(column: str, x: m.Marker) -> str:
        part = lambda g: f"regexp_extract_all({column}, {lit(x.around)}, {g})"
        return f"array_to_string(list_transform(range(1, len(regexp_split_to_array({column}, {lit(x.pattern)})) + 1), lambda i: regexp_split_to_array({column}, {lit(x.pattern)})[i] || coalesce({part(1)}[i] || ({part(2)}[i]::BIGINT + page_start + 2) || {part(3)}[i], '')), '')"

    return f"""WITH {CHUNKS}, a AS (SELECT *, nullif(regexp_extract(md, {lit(m.PAGE_BEGIN.pattern)}, 1), '')::BIGINT < page_start + 3 AS moved, {shifted('md', m.PAGE_BEGIN)} AS one FROM chunks), b AS (SELECT *, {shifted('one', m.PAGE_END)} AS two FROM a)
    SELECT doc_id, idx::BIGINT AS idx, sha256(CASE WHEN moved THEN two ELSE md END) AS md FROM b"""


PLAN = """n AS (SELECT doc_id, ceil(n_chars / 500)::BIGINT AS total FROM documents), starts AS (SELECT doc_id, total, unnest(CASE WHEN total <= 10 THEN [1] ELSE range(1, total + 1, 10) END) AS page_start FROM n),
  plan AS (SELECT doc_id, ((page_start - 1) // 10)::BIGINT AS idx, page_start::BIGINT AS page_start, least(page_start + 9, total)::BIGINT AS page_end, page_start = 1 AS is_first, least(page_start + 9, total) >= total AS is_last FROM starts)"""
CHANGES = "changes AS (SELECT doc_id, doc_id % 11 = 0 OR (doc_id % 5 = 0 AND doc_id % 4 <> 0) AS changed FROM documents)"
RATES = "(VALUES ('opus', 5.0, 25.0, 10.0, 37.5), ('sonnet', 3.0, 15.0, 6.0, 22.5), ('haiku', 1.0, 5.0, 1.0, 5.0)) AS r(model, i, o, li, lo)"
PRICED = f"""{USAGE}, rated AS (SELECT usage.*, (CASE WHEN input_tokens + cache_creation_tokens + cache_read_tokens > 200000 THEN li ELSE i END)::DOUBLE AS ri, (CASE WHEN input_tokens + cache_creation_tokens + cache_read_tokens > 200000 THEN lo ELSE o END)::DOUBLE AS ro FROM usage JOIN {RATES} USING (model)),
  priced AS (SELECT *, (input_tokens * ri + cache_creation_tokens * ri * 2.0::DOUBLE + cache_read_tokens * ri * 0.1::DOUBLE + output_tokens * ro) / 1000000 AS cost FROM rated)"""

SPACED = r"regexp_replace(regexp_replace(regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n+$', '') || chr(10)"
RULE_LINES = r"""f AS (SELECT p_partkey::VARCHAR AS file, [ '; a comment', '@replace tables', '', 'text ' || p_partkey, '; gone', '', '@add after figures', 'more', CASE WHEN p_partkey % 3 = 0 THEN '@add' ELSE '@append headings' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '  last' END ] AS l, p_partkey FROM part),
  sections AS (SELECT file, 1 AS ord, 'replace' AS directive, 'tables' AS name, 2 AS line_no, l[4] AS rule FROM f
    UNION ALL SELECT file, 2, 'add after', 'figures', 7, 'more' FROM f
    UNION ALL SELECT file, 3, CASE WHEN p_partkey % 3 = 0 THEN 'add' ELSE 'append' END, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'headings' END, 9, l[10] FROM f)"""

ORACLES = {
    "page_markers_scan": f"WITH {DOCS}, {MARKS} SELECT doc_id, o AS ord, s AS start, page AS page_no FROM marks",
    "page_content": f"WITH {DOCS}, {rows('a', m.PAGE_BLOCK, 1)}, {rows('b', m.PAGE_BLOCK, 2)} SELECT a.doc_id, a.v::BIGINT AS page_no, sha256(arg_max(b.v, b.o)) AS body FROM a JOIN b ON a.doc_id = b.doc_id AND a.o = b.o GROUP BY a.doc_id, a.v::BIGINT",
    "page_counts": f"WITH {DOCS}, {MARKS}, g AS (SELECT doc_id, count(*) AS n, min(page) AS a, max(page) AS b FROM marks GROUP BY doc_id) SELECT doc_id, len(regexp_extract_all(md, {lit(m.PAGE_SKIP.pattern)}))::BIGINT AS n_skipped, coalesce(n, 0) AS n_pages, a AS first_page, b AS last_page FROM md LEFT JOIN g USING (doc_id)",
    "page_sequence": sequence_issues(),
    "page_end_mismatch": end_issues(),
    "image_block_pairing": image_issues(),
    "heading_gaps": gap_issues(),
    "duplicate_headings": duplicate_issues(),
    "section_backward": order_issues(),
    "missing_tables": missing("Table"),
    "missing_figures": missing("Figure"),
    "binary_sequence": binary_issues(),
    "tables_checked": f"WITH {DOCS}, n AS (SELECT doc_id, len(regexp_extract_all(md, {lit(m.TABLE)})) AS n FROM md) SELECT doc_id, 0::BIGINT AS ord, 'info' AS severity, 'checked' AS kind, NULL::BIGINT AS page_no, 'Tables checked: ' || n || CASE WHEN n = 1 THEN ' table' ELSE ' tables' END AS message FROM n WHERE n > 0",
    "fabrication_hits": suspect_issues(),
    "table_width_issues": width_issues(),
    "table_titles": f"WITH {DOCS}, {MARKS}, {TABLES} SELECT doc_id, o AS tbl_no, s AS start, e AS \"end\", label FROM tbl",
    "complex_tables": f"""WITH {DOCS}, {MARKS}, {TABLES}, x AS (SELECT doc_id, o, e - 1 AS s, page AS first, label FROM tbl WHERE regexp_matches(t, {lit(m.SPAN)})), y AS (SELECT x.doc_id, x.o, first, page AS last, label FROM x {ON_PAGE}),
      z AS (SELECT *, CASE WHEN first IS NULL THEN []::BIGINT[] WHEN last > first THEN range(first, last + 1) WHEN last < first THEN []::BIGINT[] ELSE [first] END AS pages FROM y)
      SELECT doc_id, o AS tbl_no, array_to_string(pages, ',') AS pages, CASE WHEN len(pages) > 0 THEN 'p' || lpad(list_min(pages)::VARCHAR, 3, '0') || '-' || lpad(list_max(pages)::VARCHAR, 3, '0') || '_' || replace(lower(coalesce(label, 'HTML table')), ' ', '_') END AS prefix FROM z""",
    "table_row_widths": f"WITH {DOCS}, {MARKS}, {TABLES}, {SECTIONS} SELECT doc_id, o AS tbl_no, section, i AS row_idx, width FROM widths",
    "table_width_mode": f"WITH {DOCS}, {MARKS}, {TABLES}, {SECTIONS}, {MODES} SELECT doc_id, o AS tbl_no, section, mode FROM modes",
    "continued_tables": f"""WITH {DOCS}, {MARKS}, {TABLES}, {rows('c', m.TABLE_CONTINUE.pattern, 0)}, l AS (SELECT doc_id, o, s, t, lag(e) OVER (PARTITION BY doc_id ORDER BY o) AS before FROM tbl),
      k AS (SELECT doc_id, o, t, EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.s >= l.before AND c.s < l.s) AS continues FROM l)
      SELECT doc_id, o AS tbl_no, max(CASE WHEN NOT continues THEN o END) OVER (PARTITION BY doc_id ORDER BY o) AS head_no, len(regexp_extract_all(t, {lit(m.ROW)}))::BIGINT AS n_rows, continues FROM k""",
    "significant_words": f"WITH {DOCS}, w AS (SELECT doc_id, array_to_string(list_sort({words('md')}), ' ') AS w FROM md) SELECT doc_id, sha256(w) AS words_sha256, length(w) AS n FROM w",
    "image_rects": f"WITH {DOCS}, {rect_blocks()} SELECT * FROM rects",
    "rect_decisions": decisions(),
    "format_spacing": f"WITH {DOCS} SELECT doc_id, sha256({SPACED}) AS md FROM md",
    "strip_blocks": f"WITH {DOCS} SELECT doc_id, sha256(regexp_replace(regexp_replace(md, {lit(m.DESCRIPTION)}, '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS md FROM md",
    "page_of_reference": f"WITH {DOCS}, {MARKS}, {rows('refs', m.reference('Table'))} SELECT x.doc_id, x.s AS start, x.v AS number, page AS page_no FROM refs AS x {ON_PAGE}",
    "merge_first_writer": f"WITH {CHUNKS}, {claims()} SELECT doc_id, idx::BIGINT AS idx, count(*) AS n_pages, count(*) FILTER (k = 1) AS n_new FROM claims GROUP BY ALL",
    "merge_document": f"""WITH {CHUNKS}, {claims()}, n AS (SELECT doc_id, count(*) AS n, any_value(md) AS md, string_agg(regexp_replace(regexp_replace(md, '^\\s+', ''), '\\s+$', ''), chr(10) || chr(10) ORDER BY idx) AS loose FROM chunks GROUP BY doc_id),
      p AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY page) AS t FROM claims WHERE k = 1 GROUP BY doc_id) SELECT doc_id, sha256(CASE WHEN n = 1 THEN md ELSE coalesce(t, loose) END) AS md FROM n LEFT JOIN p USING (doc_id)""",
    "remap_markers": remap(),
    "context_tail": tail(),
    "chunk_plan": f"WITH {PLAN} SELECT * FROM plan",
    "manifest_changes": f"WITH {CHANGES} SELECT * FROM changes",
    "resume_fresh_chunks": f"WITH {PLAN}, {CHANGES} SELECT doc_id, idx, page_start, page_end FROM plan JOIN changes USING (doc_id) WHERE changed OR (doc_id + idx) % 3 = 0",
    "request_cost": f"WITH {PRICED} SELECT doc_id, model, round(cost, 8) AS cost FROM priced",
    "document_cost": f"WITH {PRICED}, g AS (SELECT doc_id, count(*) AS chunks, sum(input_tokens + cache_creation_tokens + cache_read_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, sum(cost) AS c FROM priced GROUP BY doc_id) SELECT doc_id, chunks, i AS total_input_tokens, i + CASE WHEN doc_id % 4 = 0 THEN 2000 ELSE 0 END AS total_all_input_tokens, o + CASE WHEN doc_id % 4 = 0 THEN 1500 ELSE 0 END AS total_all_output_tokens, round(c + CASE WHEN doc_id % 4 = 0 THEN 0.15::DOUBLE ELSE 0.0 END, 8) AS total_cost FROM g",
    "cost_rollup": f"WITH {PRICED} SELECT model, doc_id, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, round(sum(cost), 8) AS cost, grouping(model, doc_id)::BIGINT AS level FROM priced GROUP BY ROLLUP (model, doc_id)",
    "status_counts": "SELECT count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 <> 0) AS converted, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 = 0) AS cached, count(*) FILTER (doc_id % 7 = 0) AS failed FROM documents",
    "fidelity_overlap": f"""WITH {DOCS}, {PAGES}, {rows('a', m.PAGE_BLOCK, 1)}, {rows('b', m.PAGE_BLOCK, 2)},
      own AS (SELECT doc_id, page_no, {words('body')} AS w FROM (SELECT a.doc_id, a.v::BIGINT AS page_no, arg_max(b.v, b.o) AS body FROM a JOIN b ON a.doc_id = b.doc_id AND a.o = b.o GROUP BY ALL) WHERE NOT regexp_matches(body, {lit(m.PAGE_SKIP.pattern)})),
      plain AS (SELECT d AS doc_id, n AS page_no, arg_max(body, p) AS t FROM pages_made GROUP BY ALL), src AS (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 3 = 0 THEN regexp_replace(t, '[a-z]{{7,}}', 'x', 'g') ELSE t END AS t FROM plain),
      theirs AS (SELECT doc_id, page_no, {words('t')} AS x FROM src)
      SELECT doc_id, page_no, len(w)::BIGINT AS n_words, len(list_intersect(w, x))::BIGINT AS n_common, round(len(list_intersect(w, x)) / len(w), 6) AS ratio FROM own JOIN theirs USING (doc_id, page_no) WHERE len(w) >= 20 AND len(x) >= 5""",
    "content_hash": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, ''))) AS hash FROM conversations GROUP BY conv_id",
    "rules_sections": f"WITH {RULE_LINES} SELECT file, ord::BIGINT AS ord, directive, name, line_no::BIGINT AS line_no, rule FROM sections",
    "rules_problems": f"WITH {RULE_LINES} SELECT file, line_no::BIGINT AS line_no, 'no rule text' AS problem FROM sections WHERE rule = ''",
    "backoff_schedule": "SELECT event_id, least(1.0::DOUBLE * pow(2.0, event_id % 10), 30.0) AS seconds FROM events",
    "duration_format": "WITH s AS (SELECT o_orderkey, floor(greatest((o_orderkey % 9000) - 20.0 + 0.5, 0.0))::BIGINT AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM orders JOIN s USING (o_orderkey)",
}
