"""Operator 12, source divergence audit: how the sources of a language differ in their words, by count cells.

A term is a run of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of at least ``MIN_DOCS`` of its documents. A group (language and source)
or a language gives a kept term of count c the share p = 1 + floor(10**9 * (c + 2) / (N + 2 V)), N its count of kept terms, V their number, and two shares
p and q differ by f = floor((p - q)**2 / (p + q)). All of it is exact.

Part ``term`` ranks a group's terms against its language. f hangs on the group's and the language's count of a term alone, so terms fall into cells
(group count, language count). f is evaluated once a cell, a group's cells are ranked with the number of terms before them, and only the terms of cells that begin within
the first ranks are looked at again: equal values are merged and their terms taken in UTF-8 order. Part ``pair`` sums f over all kept terms for each two sources of a
language: terms are dealt to blocks, a block is a matrix of counts (terms by sources) in a task, and the blocks' sums are added. The result has a row for each two
sources, so that work is in proportion to it, not to pairs of documents.

Counting is the one pass over the texts. A task counts in two dictionaries per group and hands them on when they have ``TABLE`` terms, so a source
with a third of all documents is counted where its documents lie, and only sums meet.

Defined cases: null text, language and source are read as ''; a text without terms still makes its group; equal rows count each; a language without kept terms has pair
values of 0 and no term rows; a language with one source has no pair rows; an empty table gives an empty result. Texts are read whole, a piece at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, written

MIN_DOCS, RANKS, SMOOTH, ONE = 10, 10, 2, 1_000_000_000
#: Terms that a task holds before it hands its counts on; bytes of a text that are split at once; counts in a block's matrix.
TABLE, PIECE, BLOCK = 400_000, 1 << 20, 1 << 18
#: Bytes of UTF-8: letters and all beyond ASCII stay, A-Z become a-z, the rest separates.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = "lang string, a int, b int, value long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about PIECE bytes at a time."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group; one row of no term for each group seen."""
    occurrences: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in occurrences.items():
            docs = documents[lang, source]
            terms = [None, *[t.decode() for t in n]]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], ["lang", "source", "term", "n", "docs"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, group in enumerate(zip(langs, sources, strict=True)):
            n, own = occurrences[group], set()
            for terms in _pieces(texts[i].as_py()):
                n.update(terms)
                own.update(terms)
            documents[group].update(own)
            if len(n) >= TABLE or i % 64 == 0 and sum(map(len, occurrences.values())) >= TABLE:
                yield from rows()
    yield from rows()


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); term is null in one row of each group."""
    told = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (lang_col, source_col, text_col)]
    slim = docs.select(told[0].alias("lang"), told[1].alias("source"), told[2].cast("binary").alias("text"))
    return slim.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """Decimals: a billion times a count may pass 64 bits."""
    count, whole = (count + SMOOTH).cast("decimal(20,0)"), (total + SMOOTH * n_terms).cast("decimal(20,0)")
    return F.call_function("div", count * F.lit(ONE).cast("decimal(10,0)"), whole) + 1


def divergence(p: Column, q: Column) -> Column:
    """Of two shares as longs; both are a billion and one at most, so their squared difference fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """share() of a matrix of counts. A billion is 31,250 times 32,000: multiplied in two steps, counts up to 2.9e14 stay within 64 bits."""
    whole = totals + SMOOTH * n_terms
    q, r = np.divmod((counts + SMOOTH) * 31_250, whole)
    return 1 + q * 32_000 + r * 32_000 // whole


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block of terms: the sum of f for each two sources a < b of its language."""
    for batch in batches:
        for lang, n_terms, totals, cells in zip(batch["lang"], batch["n_terms"], batch["totals"], batch["cells"], strict=True):
            term, at, n = (np.array([c[k] for c in cells], np.int64) for k in ("term", "at", "n"))
            known, row = np.unique(term, return_inverse=True)
            counts = np.zeros((len(known), len(totals)), np.int64)
            counts[row, at] = n
            p = _shares(counts, np.asarray(totals, np.int64), int(n_terms)).T.copy()  # a source's shares lie together
            for a in range(len(totals) - 1):
                d, s = p[a + 1 :] - p[a], p[a + 1 :] + p[a]
                yield pd.DataFrame({"lang": lang, "a": a, "b": np.arange(a + 1, len(totals)), "value": (d * d // s).sum(axis=1)})


def _pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language. groups: lang, source, total, at, n_terms; kept: lang, source, term, term_no, n."""
    profile = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda g: g["total"]).alias("totals"), F.max("n_terms").alias("n_terms"))
    parts = profile.select("lang", F.ceil(F.col("n_terms") * F.size("totals") / BLOCK).cast("int").alias("parts"))
    cells = kept.join(groups.select("lang", "source", "at"), ["lang", "source"]).join(F.broadcast(parts), "lang")
    cells = cells.withColumn("block", F.pmod("term_no", F.greatest("parts", F.lit(1))))
    blocks = cells.groupBy("lang", "block").agg(F.collect_list(F.struct(F.col("term_no").alias("term"), "at", "n")).alias("cells"))
    # One row a block, of some BLOCK counts at most.
    sums = blocks.join(profile, "lang").select("lang", "n_terms", "totals", "cells").mapInPandas(_pair_sums, _SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "source", "at")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = named.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    every = groups.select("lang", "source", F.col("at").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_sources") - 1)).alias("b")).filter("a <> b")
    found = every.join(both, ["lang", "a", "b"], "left").join(others, ["lang", "b"])
    return found.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = written(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "term-counts")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    # A number for each kept term of a language, which stands for it in blocks.
    terms = written(terms.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("term_no")), "kept-terms")
    kept = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "term_no", "n", "lang_n"), "kept-counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = Window.partitionBy("lang")
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumns({"at": F.row_number().over(place.orderBy("source")) - 1, "n_sources": F.count("*").over(place).cast("int")})
    groups = written(groups, "groups")
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")).cast("long"), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).cast("long")
    cells = cells.select("lang", "source", "n", "lang_n", "terms", p.alias("p"), q.alias("q")).filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each cell has a term, so later cells than the first `ranks` values can't matter; then those that begin within the ranks.
    best = cells.withColumn("place", F.rank().over(own)).filter(F.col("place") <= ranks)
    before = F.coalesce(F.sum("terms").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("terms").over(Window.partitionBy("lang", "source", "value"))
    best = written(best.withColumn("before", before).filter(F.col("before") < ranks).select("lang", "source", "n", "lang_n", "value"), "best-cells")
    found = kept.join(best, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= ranks)
    pairs = _pairs(groups, kept).withColumn("rank", F.row_number().over(ordered))
    told = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*told).unionByName(top.withColumn("part", F.lit("term")).select(*told))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, coalesce(count(term), 0) AS v, coalesce(sum(lang_n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n, any_value(lang_n) AS lang_n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + {ONE}::HUGEINT * (coalesce(n, 0) + 2) // (g.total + 2 * v)::HUGEINT AS p,
         1 + {ONE}::HUGEINT * (kept.lang_n + 2) // (l.total + 2 * v)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value, 0 AS most FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT, {RANKS} FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM ranked QUALIFY most = 0 OR rank <= most
"""
