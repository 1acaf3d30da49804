"""Operator 9, quality rules: an isolation forest on rule statistics.

Each whole text gets its rule statistics (words, characters in words, symbols, repeated lines, words in repeated
three-word windows, words without a letter or digit). Base rules reject short and repetitive texts outright. The others are judged by an
isolation forest: random splits of the statistics, grown on a bounded sample, isolate an odd document after a short path.
The score above which a document goes is calibrated on all labelled rows: of the cuts at which no more than ``most_lost``
of the rows labelled good would go, the one with the fewest wrong verdicts (the middle one of several); without rows labelled bad, the lowest of them.

The forest grows on the driver from ``sample`` rows at most (those of the lowest hash; labelled good where labels exist, and one labelled
bad for each ``odd_rows`` of them): 100 trees of 256 rows each. The calibration gathers counts per score bin, 1000 bins per label. Statistics and scores are computed in Arrow
batches with nothing shuffled but these.

Defined cases: a null or empty text has all statistics 0 and fails the base rules; labels that are null or of unknown documents count for
nothing; without labels the forest grows on a sample of all documents and only base rules reject; equal texts get equal
verdicts; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of
from .common import without, written
from .quality_classifier import HELD_OUT, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bare_words")
SAMPLE = 8192
TREES, TREE_ROWS, DEPTH = 100, 256, 8
BINS = 1000
MOST_LOST = 0.01
#: Of so many good rows that the forest grows on, one odd row joins them: a split needs an odd value to fall beside.
ODD_ROWS = 50


def measure(texts: list[str]) -> np.ndarray:
    """One row per text, one column per statistic."""
    out = np.zeros((len(texts), len(STATISTICS)), np.int64)
    words: list[str] = []
    for i, text in enumerate(texts):
        found = WORD.findall(text)
        words += found
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        out[i] = len(found), 0, sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), 0, 0
    if not words:
        return out
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    length = np.fromiter(map(len, number), np.int64, len(number))
    owner = np.repeat(np.arange(len(texts)), out[:, 0])
    out[:, 1] = np.bincount(owner, length[codes], len(texts))
    bare = np.fromiter((not any(map(str.isalnum, w)) for w in number), bool, len(number))
    out[:, 5] = np.bincount(owner, bare[codes], len(texts))
    # Equal windows of a text have equal keys; numbering pairs first keeps the keys below 2**63.
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    if len(whole):
        _, pair = np.unique(codes[whole] * len(number) + codes[whole + 1], return_inverse=True)
        _, triple = np.unique(pair * len(number) + codes[whole + 2], return_inverse=True)
        _, place, times = np.unique(triple * len(texts) + owner[whole], return_inverse=True, return_counts=True)
        again = whole[times[place] > 1]
        hit = np.zeros(len(words), bool)
        for step in range(3):
            hit[again + step] = True
        out[:, 4] = np.bincount(owner, hit, len(texts))
    return out


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics and base_failed."""
    @F.pandas_udf(", ".join(f"{name} long" for name in STATISTICS))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            parts = [measure(texts[a:b]) for a, b in batches_of(texts)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.int64), columns=list(STATISTICS))

    out = without(docs.withColumn("__measured", measured(F.col(f"`{text_col}`"))), *STATISTICS, "base_failed")
    columns = [F.col(f"`{c}`") for c in out.columns if c != "__measured"]
    out = out.select(*columns, *[F.col(f"__measured.{name}").alias(name) for name in STATISTICS])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def features(rows: pd.DataFrame) -> np.ndarray:
    """What the forest splits on: shares of the statistics, so that length alone isn't odd."""
    s = {name: rows[name].to_numpy(float) for name in STATISTICS}
    words, chars = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    return np.stack([
        s["n_symbols"] / chars, s["n_symbols"] / words, s["n_bare_words"] / words,
        s["n_repeat_words"] / words, chars / words,
    ], axis=1)


@dataclass
class Forest:
    """Trees as arrays (tree, node): children of node k are 2k+1 and 2k+2; a leaf splits at infinity and keeps its path length."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    sample: int

    @classmethod
    def grow(cls, rows: np.ndarray, seed: int = 17) -> Forest:
        random = np.random.default_rng(seed)
        size = 2 ** (DEPTH + 1) - 1
        feature, split, path = np.zeros((TREES, size), np.int64), np.full((TREES, size), np.inf), np.zeros((TREES, size))
        used = min(TREE_ROWS, len(rows))
        for t in range(TREES):
            own = rows[random.permutation(len(rows))[:used]]
            todo = [(0, own, 0)]
            while todo:
                k, part, depth = todo.pop()
                low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
                wide = np.flatnonzero(high > low)
                if depth == DEPTH or len(part) <= 1 or not len(wide):
                    path[t, k] = depth + _mean_path(len(part))
                    continue
                f = random.choice(wide)
                feature[t, k], split[t, k] = f, random.uniform(low[f], high[f])
                under = part[:, f] < split[t, k]
                todo += [(2 * k + 1, part[under], depth + 1), (2 * k + 2, part[~under], depth + 1)]
        return cls(feature, split, path, used)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; odd rows near 1."""
        total = np.zeros(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                leaf = np.isinf(split[at])
                if leaf.all():
                    break
                value = rows[np.arange(len(rows)), feature[at]]
                at = np.where(leaf, at, 2 * at + 1 + (value >= split[at]))
            total += path[at]
        return 2.0 ** (-total / TREES / max(_mean_path(self.sample), 1e-9))


def _mean_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Model:
    forest: Forest | None
    threshold: float


def anomaly(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with anomaly, the forest's score."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # 100 trees of 511 nodes

    @F.pandas_udf("double")
    def odd(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(features(rows)))

    scored = stats.withColumn("__anomaly", odd(F.struct(*STATISTICS)))
    return without(scored, "anomaly").withColumnRenamed("__anomaly", "anomaly")


def fit(
    stats: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, odd_rows: int = ODD_ROWS, most_lost: float = MOST_LOST,
    held_out: int = HELD_OUT, id_col: str = "doc_id", label_col: str = "quality",
) -> Model:
    """The forest and its threshold, from statistics and labels; rows whose crc32(doc_id) mod 4 is held_out teach nothing."""
    taught = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label"))
    taught = taught.filter(F.col("__label").isin(0, 1) & (fold(F.col("__id")) != held_out))
    rows = stats.filter(~F.col("base_failed"))
    labelled = rows.join(taught, rows[id_col] == taught["__id"])
    order = [F.xxhash64(*STATISTICS), *STATISTICS]
    some = lambda df, most: df.select(*STATISTICS).orderBy(*order).limit(most).toPandas()
    good = some(labelled.filter("__label = 1"), sample)
    calibrated = len(good) >= 2
    grown_on = pd.concat([good, some(labelled.filter("__label = 0"), len(good) // odd_rows)]) if calibrated else some(rows, sample)
    forest = Forest.grow(features(grown_on)) if len(grown_on) >= 2 else None
    if not calibrated:
        return Model(forest, 1.0)
    binned = anomaly(labelled, forest).groupBy("__label", F.ceil(F.col("anomaly") * BINS).cast("int").alias("bin")).count()
    counts = np.zeros((2, BINS + 1), np.int64)
    for r in binned.collect():
        counts[r["__label"], r["bin"]] = r["count"]
    lost, missed = counts[1].sum() - np.cumsum(counts[1]), np.cumsum(counts[0])  # at each cut: good rows above it, bad rows up to it
    allowed = np.flatnonzero(lost <= most_lost * counts[1].sum())
    wrong = (lost + missed)[allowed]
    best = allowed[wrong == wrong.min()] if counts[0].any() else allowed[:1]
    return Model(forest, int(best[len(best) // 2]) / BINS)


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """stats with anomaly and kept."""
    scored = anomaly(without(stats, "kept"), model.forest)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= model.threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept rows of docs, their columns as they are. The fit reads statistics that are written without the texts; the verdicts measure them again, as a copy of the whole corpus beside
    them would cost more disk than that costs time."""
    names = {c: f"__in_{c}" for c in docs.columns}
    measured = statistics(docs.withColumnsRenamed(names), "__in_text")
    slim = written(measured.select(F.col("__in_doc_id").alias("doc_id"), *STATISTICS, "base_failed"), "rule-statistics")
    kept = judge(measured, fit(slim, labels, **options)).filter("kept")
    return kept.select(*[F.col(f"`{new}`").alias(old) for old, new in names.items()])
