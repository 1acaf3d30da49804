"""Operator 8, near-dedup by BagMinHash: weighted-Jaccard signatures, banding, verification of the multiset overlap.

A document is the multiset of its five-word shingles (A-Z lower-cased; a text of fewer words is one shingle). A shingle that occurs
c times covers the weight (0, c], cut into dyadic intervals (0, 1], (1, 2], (2, 4], ... Each interval of each shingle has a Poisson process of
points in time, its rate the interval's length, seeded by shingle and interval only. Every point belongs to one of m registers and to
one unit of the interval, found by halving it; a document of weight c sees the points of units up to c. A register keeps the
earliest point seen. Two documents agree in a register with probability equal to their weighted Jaccard similarity, and points later than
the latest register are never made, so that long documents cost little more than reading them.

Texts that are equal as word sequences collapse first. The others meet in 32 buckets of 5 registers each (two of similarity 0.8 miss each other with
probability 3e-6). First, every text of a bucket is verified against the bucket's most central text, the one that meets the most texts over all its
buckets, and verified links are joined to components: a group of copies costs one comparison for each. A crowded bucket (more than 16 texts) that
still lies in several components gets another hub, from a component that had none there, for as long as a round links at least a twentieth of what it
compares. Then what shares a bucket and still lies in different components is compared too, so that no link between components is lost. In a bucket of
16 texts or fewer that is every pair. In a larger one, pairs come from a prefix filter, which is exact: shingles are taken rarest first, and the
first one that two texts of the similarity share has so few others before it, in either text, that the rest can still hold the overlap. There is no cap.

Links are verified exactly: sum of minima over sum of maxima of the shingle counts, at least 0.8. Classes are connected components, found by
star contraction with each round written to the shared folder; nothing but counts reaches the driver.

Defined cases: null and empty texts have no shingles and form one class of their own; equal rows share a class; a null id joins
its text's class but never names one (a class of null ids only is named null); an empty table gives an empty result; input columns named like
an output column are replaced. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import batches_of
from .common import UPPER, WORD, without, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: In a bucket of more texts than this, pairs across components come from the prefix filter.
CROWDED = 16
#: Hub rounds go on while they link one in so many of the pairs that they compare.
WORTH = 20
#: Most hashes of texts (16 bytes each) that are broadcast.
ASKED = 500_000
#: Rows in an Arrow batch of texts, of bags of shingles or of pairs of them.
BAGS_AT_ONCE = 256
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = str.maketrans(UPPER, UPPER.lower())
_find = re.compile(WORD).findall


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _find(text.translate(_LOWER))


def shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 64-bit hash and count of each different shingle, in the order of document and hash. texts: lists of words."""
    words = [w for text in texts for w in text]
    sizes = np.array([len(t) for t in texts], np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    codes = own[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    n = np.minimum(sizes, SHINGLE)
    length = np.repeat(n, sizes)  # of the shingle that starts at a word
    place = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    start = np.flatnonzero(place <= np.repeat(sizes, sizes) - length)
    h = np.zeros(len(start), np.uint64)
    for step in range(SHINGLE):
        more = length[start] > step
        at = np.minimum(start + step, len(words) - 1)
        h = np.where(more, _mix(h * _GOLD + codes[at] + np.uint64(step)), h)
    doc = owner[start]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def registers(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """The earliest points (docs, REGISTERS) of weighted elements; infinite where a document has none."""
    # One process per dyadic interval that the weight reaches: interval 0 is (0, 1], interval j is (2**(j-1), 2**j].
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), top + 1)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    below = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.maximum(below, 1.0)
    process_doc, weight = doc[owner], count[owner]
    seed = _mix(element[owner] + _GOLD * (level + 1).astype(np.uint64))
    time, made = np.zeros(len(owner)), 0
    best = np.full(n_docs * REGISTERS, np.inf)
    block = 1
    while len(process_doc):
        k = np.arange(made, made + block, dtype=np.uint64)
        bits = _mix(seed[:, None] + (k * np.uint64(3) + np.uint64(1)) * _GOLD)
        gaps = -np.log(((bits >> np.uint64(11)) + np.uint64(1)).astype(float) / 2.0**53) / width[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        other = _mix(bits + _M2)
        register = (other >> np.uint64(40)).astype(np.int64) * REGISTERS >> 24
        # Halving the interval picks a unit: the binary digits of a uniform number.
        unit = below[:, None] + np.floor((other & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32 * width[:, None]) + 1
        seen = unit <= weight[:, None]
        np.minimum.at(best, (process_doc[:, None] * REGISTERS + register)[seen], at[seen])
        latest = best.reshape(n_docs, REGISTERS).max(axis=1)
        time, made = at[:, -1], made + block
        more = time < latest[process_doc]
        process_doc, weight, seed, time, below, width = (x[more] for x in (process_doc, weight, seed, time, below, width))
        block = min(2 * block, 64)
    return best.reshape(n_docs, REGISTERS)


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    own = best.view(np.uint64).reshape(len(best), BANDS, ROWS)
    keys = np.tile(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(best), 1))
    for r in range(ROWS):
        keys = _mix(keys * _GOLD + own[:, :, r])
    return keys.view(np.int64)


def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        texts = texts.fillna("").tolist()
        fps, bands = [], []
        for a, b in batches_of(texts):
            words = [words_of(t) for t in texts[a:b]]
            fps += [hashlib.md5(" ".join(w).encode()).digest() for w in words]
            keys = band_keys(registers(*shingles(words), b - a))
            bands += [k if w else k[:0] for w, k in zip(words, keys, strict=True)]
        yield pd.DataFrame({"fp": fps, "bands": bands})


def _bag(texts: pd.Series) -> pd.DataFrame:
    texts = texts.fillna("").tolist()
    out = []
    for a, b in batches_of(texts):
        doc, h, c = shingles([words_of(t) for t in texts[a:b]])
        cuts = np.searchsorted(doc, np.arange(1, b - a))
        out += list(zip(np.split(h.view(np.int64), cuts), np.split(c.astype(np.int32), cuts), strict=True))
    return pd.DataFrame(out, columns=["h", "c"])


def _overlap(ha: pd.Series, ca: pd.Series, hb: pd.Series, cb: pd.Series) -> pd.Series:
    out = np.zeros(len(ha))
    for i, (h1, c1, h2, c2) in enumerate(zip(ha, ca, hb, cb, strict=True)):
        _, at1, at2 = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
        shared = np.minimum(c1[at1], c2[at2]).sum()
        out[i] = shared / (c1.sum() + c2.sum() - shared)
    return pd.Series(out)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, raw (hash of the text as it is), fp (hash of its words), bands: a slim row per document, written once."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _raw(text).alias("raw"), F.pandas_udf(_signed, "fp binary, bands array<long>")(text).alias("s"))
    return _in_small_batches(rows.select("id", "raw", "s.fp", "s.bands"), "signatures")


def _raw(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b); a round of star contraction at a time."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Large star: what is greater than a node links to the least of its neighbourhood; then small star: so does what is less.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        pairs = large.join(least, "a")
        small = pairs.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(pairs.select("a", F.col("least").alias("b")))
        now = written(small.filter("a <> b").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(state) == before and state[0] == state[2]:
            break
        before = tuple(state)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "components")


def _in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """Written with few rows in an Arrow batch, as each holds a whole text or bag."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BAGS_AT_ONCE))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


class _Verifier:
    """Shingle bags of the texts that share a bucket, made and written once, and the overlap of pairs of them."""

    def __init__(self, docs: DataFrame, needed: DataFrame, text_col: str, similarity: float):
        """needed: fp, raw (the raw hash of one of the texts of these words)."""
        self.similarity = similarity
        text = F.col(f"`{text_col}`")
        texts = docs.select(_raw(text).alias("raw"), text.alias("text")).join(needed, "raw")
        texts = texts.groupBy("fp").agg(F.min("text").alias("text"))  # copies: one of each
        bag = F.pandas_udf(_bag, "h array<long>, c array<int>")
        #: fp, h, c (hashes and counts of the shingles).
        self.bags = _in_small_batches(texts.select("fp", bag("text").alias("s")).select("fp", "s.h", "s.c"), "bags")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the bound."""
        # Later rounds ask for few texts: only their bags are moved, where the list of them is known to be small.
        asked, bags = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), self.bags
        if asked.count() <= ASKED:
            bags = bags.join(F.broadcast(asked), "fp", "left_semi")
        first = bags.withColumnsRenamed({"fp": "a", "h": "ha", "c": "ca"})
        second = bags.withColumnsRenamed({"fp": "b", "h": "hb", "c": "cb"})
        found = pairs.join(first, "a").join(second, "b").withColumn("overlap", F.pandas_udf(_overlap, "double")("ha", "ca", "hb", "cb"))
        return _in_small_batches(found.filter(F.col("overlap") >= self.similarity).select("a", "b"), "verified")

    def prefix_pairs(self, placed: DataFrame) -> DataFrame:
        """Pairs (a > b) across components of texts that may reach the similarity. placed: key, fp, root, of crowded buckets.

        Of a bucket's components the one with most texts there is the main one; its texts needn't be asked for, as every pair sought has a side outside.
        """
        sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        asking = placed.join(main, "key").filter("root <> main").select("fp").distinct()
        texts = placed.select("fp", "root").distinct()
        bags = self.bags.withColumn("size", F.aggregate("c", F.lit(0), lambda x, y: x + y))
        held = bags.join(texts, "fp").select("fp", "root", "size", F.inline(F.arrays_zip("h", "c")))
        often = held.groupBy("h").agg(F.count("*").alias("often"))
        t = self.similarity
        before = Window.partitionBy("fp").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)
        ranked = held.join(often, "h").withColumn("ahead", F.coalesce(F.sum("c").over(before), F.lit(0)))
        # Classes of sizes, so wide that all partners of a text lie in two neighbouring ones at most.
        level = lambda size: F.floor(F.log(size) / (-2 * math.log(t)) + 1e-9).cast("int")
        least = F.ceil(t * F.col("size") - 1e-9)
        firsts = ranked.filter(F.col("ahead") <= F.col("size") - least).select("h", "fp", "root", "size", "ahead", level(F.col("size")).alias("class"))
        firsts = written(firsts, "prefixes")
        offered = firsts.withColumnsRenamed({"fp": "y", "root": "root_y", "size": "size_y", "ahead": "ahead_y"})
        # The overlap is at most what isn't ahead, and at least t / (1 + t) of both sizes: so large a partner may be.
        largest = F.floor((F.col("size") - F.col("ahead")) * (1 + t) / t - F.col("size") + 1e-6)
        asked = firsts.join(asking, "fp", "left_semi").withColumn("class", F.explode(F.sequence(level(least), level(F.greatest(largest, least)))))
        asked = asked.withColumnsRenamed({"fp": "x", "root": "root_x"})
        need = F.ceil(t / (1 + t) * (F.col("size") + F.col("size_y")) - 1e-9)
        met = asked.join(offered, ["h", "class"]).filter("root_x <> root_y")
        met = met.filter((F.col("ahead") <= F.col("size") - need) & (F.col("ahead_y") <= F.col("size_y") - need))
        return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _pairs_across(members: DataFrame) -> DataFrame:
    """Pairs (a > b) of members (key, fp, root) that share a key but no root."""
    other = members.select("key", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    met = members.withColumnRenamed("fp", "a").join(other, "key").filter((F.col("root") < F.col("root_b")))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b): components of components."""
    known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
    tops = components(edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    old = roots.withColumnRenamed("root", "old").join(tops.select(F.col("node").alias("old"), "root"), "old", "left")
    new = tops.join(roots.select("node"), "node", "left_anti")
    return written(old.select("node", F.coalesce("root", "old").alias("root")).unionByName(new.select("node", "root")), "components")


def _in_pieces(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """shared (key, fp, n, met) with root, for the buckets that lie in several components."""
    placed = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    pieces = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    pieces = written(pieces, "pieced-keys")  # before the join, so that Spark can split a bucket of very many texts there
    return written(placed.join(pieces, "key"), "pieces")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, raw, fp, root, one row per document: root is the least fp of its class."""
    signed = signatures(docs, id_col, text_col)
    nodes = written(signed.groupBy("fp").agg(F.min("raw").alias("raw"), F.first("bands").alias("bands")), "texts")
    members = nodes.select("fp", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(members.join(buckets, "key"), "buckets")
    # The most central text of a bucket: the one that meets most others, over all its buckets.
    central = shared.groupBy("fp").agg(F.sum("n").alias("met"))
    shared = written(shared.join(central, "fp"), "placed")
    verifier = _Verifier(docs, nodes.select("fp", "raw").join(central.select("fp"), "fp"), text_col, similarity)
    hubs = written(shared.groupBy("key").agg(F.max_by("fp", F.struct("met", "fp")).alias("hub")), "hubs")
    pair = (F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b"))
    compared = written(shared.join(hubs, "key").filter("fp <> hub").select(*pair).distinct(), "pairs")
    roots = components(verifier.links(compared))
    placed = _in_pieces(shared.filter("n > 2"), roots)
    while True:
        crowded = placed.filter(F.col("n") > CROWDED)
        # The next hub: of the components without one in the bucket, the largest there; of its texts, the most central.
        had = hubs.join(roots.withColumnRenamed("node", "hub"), "hub", "left").select("key", F.coalesce("root", "hub").alias("root")).distinct()
        sizes = crowded.join(had, ["key", "root"], "left_anti").groupBy("key", "root").agg(F.count("*").alias("there"), F.max(F.struct("met", "fp")).alias("best"))
        least = sizes.groupBy("key").agg(F.max(F.struct("there", "best", "root")).alias("top"))
        next_hubs = written(least.select("key", F.col("top.best.fp").alias("hub"), F.col("top.root").alias("hub_root")), "hubs")
        pairs = crowded.join(next_hubs, "key").filter("root <> hub_root").select(*pair).distinct().join(compared, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = verifier.links(pairs)
        n_found, n_pairs = found.count(), pairs.count()
        hubs, compared = hubs.unionByName(next_hubs.select("key", "hub")), compared.unionByName(pairs)
        if n_found:
            roots = _merged(roots, found)
            placed = _in_pieces(placed.drop("root"), roots)
        if n_found * WORTH <= n_pairs:
            break
    # What shares a bucket and still lies in different components.
    pairs = _pairs_across(placed.filter(F.col("n") <= CROWDED)).unionByName(verifier.prefix_pairs(placed.filter(F.col("n") > CROWDED))).distinct()
    more = verifier.links(written(pairs.join(compared, ["a", "b"], "left_anti"), "pairs"))
    if more.head(1):
        roots = _merged(roots, more)
    classed = signed.select("id", "raw", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return classed.select("id", "raw", "fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: its id, class_id (the least id of its class), class_size and is_first (its row is the one to keep)."""
    rows = near_duplicates(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    rows = written(rows, "classed")
    # Written before the join, so that Spark can split a class of very many documents there.
    named = written(rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return rows.join(named, "root").select(
        F.col("id").alias(id_col), "class_id", "class_size", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("is_first")
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, that of the least id (a null id last; then the least text hash)."""
    rows = written(near_duplicates(docs, id_col=id_col, text_col=text_col, similarity=similarity), "classed")
    choice = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("raw"))
    chosen = rows.withColumn("choice", choice).groupBy("root").agg(F.min("choice").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    chosen = written(chosen, "classes")  # before the join, so that Spark can split a class of very many documents there
    gone = rows.withColumn("choice", choice).join(chosen, "root").filter("NOT (choice <=> kept)")
    gone = written(gone.select(F.col("choice.no_id").alias("__no_id"), F.col("id").alias("__id"), F.col("raw").alias("__raw")).distinct(), "removed")
    repeated = rows.groupBy("id", "raw").count().filter("count > 1").limit(1).count() > 0
    own = docs.withColumns({"__raw": _raw(F.col(f"`{text_col}`"))})
    same = (own["__raw"] == gone["__raw"]) & own[id_col].eqNullSafe(gone["__id"])
    kept = own.join(gone, same, "left_anti")
    if repeated:  # the same id and text in several rows
        kept = kept.dropDuplicates([id_col, "__raw"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
