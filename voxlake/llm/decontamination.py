"""Operator 4, benchmark decontamination: a hash set of normalised test n-grams, scanned over token windows.

Texts become words (A-Z lower-cased; runs of letters, digits and characters beyond ASCII). Every 13 consecutive
words of a benchmark item are a window; an item of fewer words, but at least one, is one window. All windows of the
corpus with the length of some benchmark window are hashed and looked up in the set of benchmark windows; the words of
a hit are compared before it counts. The set is broadcast while its size, counted first, is below a limit. Beyond it windows meet in a shuffle as two hashes, so that
what moves grows with the words, and the words are compared in the texts that were hit, which come after.

A document's result depends on its text alone, so hits are gathered by text (a 128-bit hash), once for all copies of a text,
and joined back to the documents; Spark can split a text with very many copies there.

Defined cases: a null or empty text has no words and is clean; an item without words has no window; items are told apart by their ids, so rows
that share an id are one item (those without an id too: it counts, first in items as null), and equal texts under different ids are different
items; equal rows each get the result; an empty benchmark or corpus gives clean or no rows; input columns named
like an output column are replaced. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, let, without, words, written

WINDOW = 13
#: Most bytes of benchmark windows that are broadcast.
BROADCAST_BYTES = 64 << 20


def _hash(at, n: Column) -> Column:
    """Hash of the first, the last and two inner words of a window; at(i) is its word i, counted from 0. Equal windows have equal hashes."""
    last = n - 1
    inner = [F.floor(last / 3).cast("int"), F.floor(last * 2 / 3).cast("int")]
    return F.xxhash64(at(F.lit(0)), at(inner[0]), at(inner[1]), at(last))


def benchmark_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """item (string), n (words), gram (array of words): the distinct windows of each item."""
    tokens = words(F.col(f"`{text_col}`"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), tokens.alias("tokens"))
    items = items.filter(F.size("tokens") > 0).withColumn("n", F.least(F.size("tokens"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1)
    return items.withColumn("at", F.explode(starts)).select("item", "n", F.slice("tokens", F.col("at"), F.col("n")).alias("gram")).distinct()


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """fp, at, n, gram, once for each place of a text: where windows (n, gram) occur in docs (fp, tokens)."""
    grams = windows.select("n", "gram", _hash(lambda i: F.get("gram", i), F.col("n")).alias("h")).distinct()
    # One row per window length that occurs, 13 at most: the lengths to scan for, and the bytes that a broadcast would take.
    sizes = grams.groupBy("n").agg(F.sum(F.length(F.array_join("gram", "")) * 4 + 16 * F.col("n") + 64).alias("bytes")).collect()
    lengths = sorted(r["n"] for r in sizes)
    if not lengths:
        return docs.select("fp", F.lit(0).alias("at"), F.lit(0).alias("n"), F.col("tokens").alias("gram")).limit(0)
    # One scan: at each word, a window of each length that occurs. One that reaches beyond the text equals no window of the set.
    places = docs.filter(F.size("tokens") >= lengths[0])
    places = places.select("fp", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - (lengths[0] - 1))).alias("at"))
    kinds = [F.struct(F.lit(n).alias("n"), _hash(lambda i: F.get("tokens", F.col("at") - 1 + i), F.lit(n)).alias("h")) for n in lengths]
    if len(lengths) == 1:
        scanned = places.withColumn("w", kinds[0])
    else:
        scanned = places.withColumn("w", F.explode(F.array(*kinds)))
    scanned = scanned.select("fp", "tokens", "at", F.col("w.n").alias("length"), F.col("w.h").alias("own_h"))
    own = F.slice("tokens", F.col("at"), F.col("length"))
    if sum(r["bytes"] for r in sizes) > BROADCAST_BYTES:
        return _far_hits(docs, scanned.select("fp", "at", "length", "own_h", F.xxhash64(own).alias("own_words")), grams)
    grams = F.broadcast(grams)
    # The hash alone is the join's key; equality of the words, written so that it is no key, is the check.
    same = (F.col("own_h") == F.col("h")) & (F.col("n") <= F.col("length")) & (F.col("n") >= F.col("length")) & (own <= F.col("gram")) & (own >= F.col("gram"))
    return scanned.join(grams, same).select("fp", "at", "n", "gram").distinct()


def _far_hits(docs: DataFrame, scanned: DataFrame, grams: DataFrame) -> DataFrame:
    """hits() for a set too large to broadcast. scanned: fp, at, length, own_h, own_words (hash of all words of the window)."""
    same = (F.col("own_h") == F.col("h")) & (F.col("own_words") == F.col("all_words")) & (F.col("length") == F.col("n"))
    met = written(scanned.join(grams.withColumn("all_words", F.xxhash64("gram")), same).select("fp", "at", "n", "gram").distinct(), "benchmark-hits")
    texts = docs.join(met.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("tokens").alias("tokens"))
    return met.join(texts, "fp").filter(F.slice("tokens", F.col("at"), F.col("n")) == F.col("gram")).select("fp", "at", "n", "gram")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, percent: int = 5, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurring window), items (sorted ids of the items with occurring windows, a null first),
    spans (array of first and last hit word, 1-based, merged) and contaminated (some hit, and percent of the words or more)."""
    added = ("n_words", "n_hit", "items", "spans", "contaminated")
    text = F.col(f"`{text_col}`")
    # Copies meet by this key; a document's other columns play no part in its result.
    keyed = without(docs.withColumns({"__fp": F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))), "__tokens": words(text)}), *added)
    windows = benchmark_windows(benchmark, size, item_col, text_col)
    # Written once, as spans and items both read it; it holds the places that hit, not the windows scanned.
    places = written(hits(keyed.select(F.col("__fp").alias("fp"), F.col("__tokens").alias("tokens")), windows), "benchmark-hits")
    # Occurrences of one text: at most one per word and window length.
    order = Window.partitionBy("fp").orderBy("at", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = places.select("fp", "at", "n", (F.col("at") + F.col("n") - 1).alias("end"))
    ends = ends.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    ends = ends.withColumn("span", F.sum((F.col("at") > F.col("reached") + 1).cast("int")).over(order))
    spans = ends.groupBy("fp", "span").agg(F.min("at").alias("first"), F.max("end").alias("last"))
    spans = spans.groupBy("fp").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")
    )
    items = places.select("fp", "gram").distinct().join(windows.select("item", "gram"), "gram").groupBy("fp").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("item"))), lambda x: x["item"]).alias("items")  # a set of bare ids would leave the null one out
    )
    # Written before the join, so that Spark can split a text of very many copies there.
    found = written(spans.join(items, "fp"), "benchmark-texts").withColumnsRenamed({c: f"__{c}" for c in ("fp", "n_hit", "spans", "items")})
    n_hit = F.coalesce(F.col("__n_hit"), F.lit(0)).cast("long")
    n_words = F.size("__tokens").cast("long")
    counted = keyed.withColumn("__n_words", n_words).drop("__tokens").join(found, "__fp", "left")
    return counted.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("__spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("__n_words"))).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD}|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    starts_with_word = F.coalesce(text, F.lit("")).rlike(f"^{WORD}")

    def cut(known: Column) -> Column:
        pieces, word_first = known["pieces"], known["word_first"]
        # Piece j (0-based) is word number (j + 1) / 2 rounded up or down, or stands after it.
        number = lambda j: F.floor((j + F.when(word_first, 2).otherwise(1)) / 2)
        is_word = lambda j: (j % 2 == 0) == word_first
        gone = lambda j: F.exists(
            spans, lambda s: (number(j) >= s["first"]) & F.when(is_word(j), number(j) <= s["last"]).otherwise(number(j) < s["last"])
        )
        return F.array_join(F.filter(pieces, lambda p, j: ~gone(j)), "")

    known = F.struct(pieces.alias("pieces"), starts_with_word.alias("word_first"))
    return F.when(F.size(spans) == 0, text).otherwise(let(known, cut))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') with the hit words of those cut out."""
    text_col = options.get("text_col", "text")
    marked = contamination(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns if c != text_col}), benchmark, **options)
    back = [F.col(f"`{c if c == text_col else f'__in_{c}'}`").alias(c) for c in docs.columns]
    if remove == "documents":
        return marked.filter(~F.col("contaminated")).select(*back)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = F.when(F.col("contaminated"), without_spans(F.col(f"`{text_col}`"), F.col("spans"))).otherwise(F.col(f"`{text_col}`"))
    return marked.withColumn(text_col, cut).select(*back)


#: d_words(doc row, words), w(item, n, gram): DuckDB, shared by op4's SQL and the pipeline's.
def oracle_ctes(docs: str = "documents") -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
d AS (SELECT row_number() OVER () AS row_id, *, {split} AS w FROM {docs}),
b AS (SELECT item_id::VARCHAR AS item, {split} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, list_slice(w, pos, pos + least(len(w), {WINDOW}) - 1) AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS pos FROM b WHERE len(w) > 0)
),
at_word AS (
  SELECT row_id, pos, n, list_slice(w, pos, pos + n - 1) AS gram
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
),
hit AS (SELECT a.row_id, a.pos, a.n, g.item FROM at_word a JOIN grams g ON a.n = g.n AND a.gram = g.gram),
hit_words AS (SELECT row_id, count(DISTINCT word) AS n_hit FROM (SELECT row_id, unnest(range(pos, pos + n)) AS word FROM hit) GROUP BY row_id),
hit_items AS (SELECT row_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY row_id),
contaminated AS (
  SELECT d.*, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
)"""


ORACLE = f"""
WITH {oracle_ctes()}
SELECT doc_id, n_words, n_hit, len(items) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, contaminated
FROM contaminated
"""
