"""Operator 6, line dedup: lines that a large share of a site's pages carry are boilerplate.

For each host, the pages that contain a line are divided by the host's pages; every line above the boilerplate ratio goes from every page, other
lines stay, in order. A line of one page only is not repeated, so it takes two pages at least, however few a host has. A page is a different text of a
host: its copies are the same page once more, so that a body that was copied often isn't taken for furniture. ``count_copies`` counts rows instead.

Lines are compared trimmed of blanks only (a tab or a carriage return makes another line); blank lines are never boilerplate. Counting happens over (host, 128-bit line hash) with partial
sums before the shuffle, so that neither a hot host nor a hot line meets in one task. Only lines that are boilerplate are joined
back, and their hits go back to the pages by (host, text), once for all copies.

Defined cases: a null host is a host of its own; a null text stays null, an empty one empty; equal rows get equal
results; an empty table gives an empty result; a line that stands twice on a page counts once and goes twice; input
columns named like an output column are replaced. Lines of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

RATIO = 0.05
#: On fewer pages than this a line isn't repeated.
MIN_PAGES = 2


def _hash(text):
    return F.unhex(F.md5(text.cast("binary")))


def _line_hash(line):
    return _hash(F.trim(line))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, count_copies: bool) -> DataFrame:
    """host, line (128-bit hash), n_pages, n_host_pages: the lines above the ratio. A line's hash meets others of its host only."""
    pages = docs.select(
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"),
        F.col(f"`{host_col}`").isNull().alias("no_host"),
        _hash(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("page"),
        F.array_distinct(F.transform(F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"), lambda x: F.trim(x) != ""), _line_hash)).alias("lines"),
    )
    if not count_copies:  # copies have the same lines
        pages = pages.groupBy("host", "no_host", "page").agg(F.first("lines").alias("lines"))
    n_pages = pages.groupBy("host", "no_host").agg(F.count("*").alias("n_host_pages"))
    counted = pages.select("host", "no_host", F.explode("lines").alias("line")).groupBy("host", "no_host", "line").agg(F.count("*").alias("n_pages"))
    often = counted.filter(F.col("n_pages") >= MIN_PAGES)
    return often.join(n_pages, ["host", "no_host"]).filter(F.col("n_pages") > ratio * F.col("n_host_pages"))


def dedup_lines(
    docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, count_copies: bool = False,
) -> DataFrame:
    """docs with text cleaned, n_lines (not blank) and n_dropped."""
    found = boilerplate(docs, host_col, text_col, ratio, count_copies).select("host", "no_host", "line")
    text = F.col(f"`{text_col}`")
    keyed = without(docs, "n_lines", "n_dropped").withColumns({
        "__host": F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")),
        "__no_host": F.col(f"`{host_col}`").isNull(),
        "__page": _hash(F.coalesce(text, F.lit(""))),
    })
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    own = keyed.select(
        F.col("__host").alias("host"), F.col("__no_host").alias("no_host"), F.col("__page").alias("page"),
        F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _line_hash))).alias("line"),
    )
    dropped = own.join(found, ["host", "no_host", "line"], "left_semi").groupBy("host", "no_host", "page").agg(
        F.collect_set("line").alias("__dropped")
    ).withColumnsRenamed({"host": "__host", "no_host": "__no_host", "page": "__page"})
    joined = keyed.join(dropped, ["__host", "__no_host", "__page"], "left")
    is_gone = lambda x: F.array_contains(F.col("__dropped"), _line_hash(x)) & (F.trim(x) != "")
    drops = F.col("__dropped").isNotNull()
    return joined.select(
        *[
            F.when(drops, F.array_join(F.filter(lines, lambda x: ~is_gone(x)), "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")
        ],
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_lines"),
        F.when(drops, F.size(F.filter(lines, is_gone))).otherwise(0).cast("long").alias("n_dropped"),
    )


def oracle_ctes(docs: str = "documents") -> str:
    """line_clean(every column of docs, n_lines, n_dropped), text cleaned: DuckDB."""
    return f"""
page AS (SELECT row_number() OVER () AS page_row, *, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}),
page_line AS (
  SELECT DISTINCT source, coalesce(text, '') AS body, trim(line) AS line
  FROM (SELECT source, text, unnest(lines) AS line FROM page) WHERE trim(line) <> ''
),
host_pages AS (SELECT source, count(DISTINCT coalesce(text, '')) AS n_host_pages FROM {docs} GROUP BY source),
furniture AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n_pages FROM page_line GROUP BY ALL) l
  JOIN host_pages h ON l.source IS NOT DISTINCT FROM h.source
  WHERE n_pages >= {MIN_PAGES} AND n_pages > {RATIO}::DOUBLE * n_host_pages
),
by_host AS (SELECT source, list(line) AS gone FROM furniture GROUP BY source),
marked AS (
  SELECT page.*, list_filter(lines, lambda x: trim(x) <> '' AND list_contains(coalesce(gone, []), trim(x))) AS cut,
         list_filter(lines, lambda x: NOT (trim(x) <> '' AND list_contains(coalesce(gone, []), trim(x)))) AS rest
  FROM page LEFT JOIN by_host ON page.source IS NOT DISTINCT FROM by_host.source
),
line_clean AS (
  SELECT * EXCLUDE (page_row, lines, cut, rest, text),
         CASE WHEN len(cut) > 0 THEN array_to_string(rest, chr(10)) ELSE text END AS text,
         len(list_filter(lines, lambda x: trim(x) <> '')) AS n_lines, len(cut) AS n_dropped
  FROM marked
)"""


ORACLE = f"""
WITH {oracle_ctes()}
SELECT doc_id, source, text, n_lines, n_dropped FROM line_clean
"""
