"""Text functions over columns: places of all matches of a pattern, trimming, section keys, durations, significant words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markers


def java(pattern: str) -> str:
    """The pattern for Spark: line ends are ``\\n`` alone, white space is Unicode's."""
    return "(?d)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Array of (start, end, text, value) of all matches, in code points from 0. A text split at its matches gives the
    lengths between them; places are their running sum. The pattern must not match nothing."""
    rx = F.lit(java(pattern))
    between = F.transform(F.split(text, java(pattern), -1), lambda s: F.length(s))
    parts = [F.regexp_extract_all(text, rx, F.lit(g)).alias(name) for g, name in ((0, "text"), (group, "value")) if g or name == "text"]
    rows = F.arrays_zip(between.alias("gap"), *parts)
    none = F.array().cast("array<struct<start:int,end:int,text:string,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        one = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["value" if group else "text"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["found"], one).alias("found"))

    found = F.aggregate(F.filter(rows, lambda x: x["text"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]
    return F.when(text.rlike(java(pattern)), found).otherwise(none)


#: Rows up to which ``last_before`` counts them; more are searched by halving.
COUNTED = 32


def last_before(rows: Column, place: Column, field: str) -> Column:
    """As-of lookup inside a row: ``field`` of the last element of ``rows``, which are in order of ``start``, that starts at
    or before ``place``; null if none does. ``place`` is evaluated once; ``rows`` should be a column or bound by ``let``."""

    def of(p: Column) -> Column:
        counted = F.size(F.filter(rows, lambda m: m["start"] <= p)) - 1
        strides = F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda s: s <= F.size(rows))
        searched = F.aggregate(strides, F.lit(-1), lambda at, s: F.when(F.get(rows, at + s)["start"] <= p, at + s).otherwise(at))
        return F.get(rows, F.when(F.size(rows) <= COUNTED, counted).otherwise(searched))[field]

    return let(place, of)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def section_key(section: Column) -> Column:
    """A key that sorts numbers by value and before letters, part by part."""
    digits = lambda p: p.rlike("^[0-9]+$")
    return F.transform(
        F.split(section, "[.]"),
        lambda p: F.struct(F.when(digits(p), 0).otherwise(1).alias("kind"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"), F.when(digits(p), "").otherwise(p).alias("letter")),
    )


def duration(seconds: Column) -> Column:
    """45s, 2m 15s, 1h 03m 12s; truncated, 0s below zero."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("bigint")
    minutes, hours = F.floor(s / 60).cast("bigint"), F.floor(s / 3600).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(minutes < 60, F.format_string("%dm %02ds", minutes, s % 60))
        .otherwise(F.format_string("%dh %02dm %02ds", hours, minutes % 60, s % 60))
    )


def significant_words(text: Column, least: int = 5) -> Column:
    """The set of lower-case ASCII words of at least ``least`` letters, without descriptions, comments, tags, formulas and marks."""
    for pattern in (markers.DESCRIPTION, "(?s)<!--.*?-->", "<[^>]+>", r"(?s)\$\$.*?\$\$", r"\$[^$]+\$", r"[*_#`\[\]()>|]"):
        text = F.regexp_replace(text, java(pattern), " ")
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) >= least)


def spaced(text: Column) -> Column:
    """No runs of blank lines, no blanks at line ends, one newline at the end."""
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?md)[ \t]+$", "")
    return F.concat(F.regexp_replace(text, "\n+$", ""), F.lit("\n"))


def without_descriptions(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, java(markers.DESCRIPTION), ""), "\n{3,}", "\n\n")


def content_hash(parts: Column) -> Column:
    """SHA-256 of the contents of files given as (name, content), in order of names; '' without files."""
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: p["content"]), "")
    return F.when(F.size(parts) == 0, "").otherwise(F.sha2(joined, 256))


def table_file_prefix(pages: Column, label: Column) -> Column:
    """p001-002_table_3 for a table's pages and label."""
    name = F.translate(F.replace(F.lower(label), F.lit(" "), F.lit("_")), "–—", "--")
    return F.format_string("p%03d-%03d_%s", F.array_min(pages), F.array_max(pages), name)


def chunk_name(idx: Column) -> Column:
    return F.format_string("chunk_%02d", idx + 1)


def backoff(attempt: Column, first: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before the next attempt, without jitter: doubling up to ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def retryable(status: Column, kind: Column) -> Column:
    """Whether a failed request may be tried again: by HTTP status, or by the kind of a failure of the connection."""
    dropped = ("connection", "timeout", "RemoteProtocolError", "ReadError", "ProtocolError")
    return F.coalesce(status.isin(429, 500, 502, 503, 529), F.lit(False)) | F.coalesce(kind.isin(*dropped), F.lit(False))
