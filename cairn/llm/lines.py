"""Boilerplate lines by their frequency on a site.

For each host, the pages that contain a line are divided by the host's pages; lines above the
ratio go from the host's pages. Only column expressions. Each page sends each of its distinct
lines once, as two 64-bit hashes under different seeds, so counting is one partial aggregation
whatever the host's share of all rows. A host has at most (mean lines of a page / ratio) such
lines, so the list of them joins back to the pages as one array for each host.

Defined results: a null text stays null and has no lines; a null host is a site of its own; lines
are compared without blanks at their ends, and blank lines always stay; a page that repeats counts
as often as it occurs. Two guards are off unless asked for: ``min_pages`` is how many pages a line must
be on, so that small sites lose nothing, and ``keep_whole`` leaves a page with nothing but boilerplate
as it is, as such a page is a copy rather than a page with boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import written

MAX_RATIO = 0.1
BLANK = " \t\x0b\x0c\r"


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one."""
    t = F.trim(line, F.lit(BLANK))
    return F.when(t != "", F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")))


def boilerplate(df: DataFrame, *, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = 1) -> DataFrame:
    """(host, lines): the keys of each host's lines above the ratio; hosts without any are left out."""
    pages = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), _key), lambda k: k.isNotNull()))
    n_lines = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    joined = n_lines.alias("l").join(totals.alias("t"), F.col("l.host").eqNullSafe(F.col("t.host")))
    over = joined.where(F.col("n") > F.lit(max_ratio) * F.col("total")).select("l.host", "line")
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(df: DataFrame, *, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = 1, keep_whole: bool = False, count_cols: tuple[str, str] | None = None) -> DataFrame:
    """``df`` without boilerplate lines in its text; ``count_cols`` names columns for the lines and those dropped."""
    bad = written(boilerplate(df, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages), "boilerplate")
    bad = bad.select(F.col("host").alias("__bad_host"), F.col("lines").alias("__bad_lines"))
    text, keep = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in df.columns]
    marked = df.join(bad, F.col(f"`{host_col}`").eqNullSafe(F.col("__bad_host")), "left")
    some = F.size(F.col("__bad_lines")) > 0
    parts = F.split(text, "\n", -1)
    left = F.filter(parts, lambda x: F.coalesce(~F.array_contains(F.col("__bad_lines"), _key(x)), F.lit(True)))
    marked = marked.select(*keep, F.when(some, left).alias("__left"))
    if keep_whole:
        content = F.exists("__left", lambda x: _key(x).isNotNull())
        marked = marked.select(*keep, F.when(content, F.col("__left")).alias("__left"))
    changed = F.coalesce(F.array_join("__left", "\n"), text)
    extra = []
    if count_cols:
        n = F.coalesce(F.size(parts), F.lit(0))
        n = F.when(text.isNull(), 0).otherwise(n).cast("bigint")
        extra = [n.alias(count_cols[0]), F.when(F.col("__left").isNull(), 0).otherwise(n - F.size("__left")).cast("bigint").alias(count_cols[1])]
    out = marked.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], *extra)
    if "n_chars" in df.columns and text_col == "text":
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out
