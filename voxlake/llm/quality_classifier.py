"""Operator 2, quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters and runs of other characters but white space, case kept. Features are hashed
unigrams, bigrams and word repetitions (as a shape, whatever the word) of the whole text, each occurrence worth 1/sqrt(number of features). Training updates one row at a time
(FTRL-proximal, with L1 and L2), over a bounded sample of labelled rows: at most ``max_rows`` of them, those of
the lowest hash. Rows whose crc32(doc_id) mod 4 is ``held_out`` never teach. Scoring is a sparse dot product per
document, in Arrow batches, with the weights in a broadcast of 4 bytes times ``2**bits``.

Defined cases: a null or empty text has no features and gets the score of the bias; labels that are null or for no
document teach nothing; without any label every score is 0.5; documents that share an id share its label, and so do labels
that share one (each teaches); equal texts get equal scores; an empty table gives an empty result; input columns named like an output
column are replaced. Neither labels, lang, source nor doc_id take part in a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of
from .common import without

BITS = 20
MAX_ROWS = 8000
EPOCHS = 3
HELD_OUT = 2
TOKEN = re.compile(r"\w+|[^\w\s]+")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def hashed(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, flat, and how many each text has: unigrams and bigrams, repeated ones included."""
    tokens: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = TOKEN.findall(text)
        sizes[i] = len(found)
        tokens += found
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    own = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in number), np.uint64, len(number))
    codes = own[np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))] if tokens else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-1] == owner[1:]
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))[inside]
    # An n-gram that repeats a word also counts as the shape alone: the word right before, or the one before that.
    shapes = []
    for step in (1, 2):
        again = np.flatnonzero((codes[:-step] == codes[step:]) & (owner[:-step] == owner[step:]))
        shapes.append((np.full(len(again), step, np.uint64) * np.uint64(0xD6E8FEB86659FD93), owner[again]))
    shift = np.uint64(64 - bits)
    singles = (codes * np.uint64(0x9E3779B97F4A7C15)) >> shift
    features = np.concatenate([singles, pairs >> shift, *[k >> shift for k, _ in shapes]]).astype(np.int64)
    owners = np.concatenate([owner, owner[:-1][inside], *[o for _, o in shapes]])
    order = np.argsort(owners, kind="stable")
    return features[order], np.bincount(owners, minlength=len(texts))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.01) -> np.ndarray:
    """Weights (the last is the bias) of rows (feature numbers, values, label 0 or 1)."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, *, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS,
    held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> np.ndarray:
    """The weights. The sample of labels is taken before the join, so that only its documents are read further."""
    label = F.col(f"`{label_col}`")
    taught = labels.select(F.col(f"`{id_col}`").alias("id"), label.cast("int").alias("y"))
    taught = taught.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id")) != held_out))
    # max_rows labels: a broadcast of about 16 bytes times that.
    taught = F.broadcast(taught.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(taught, "id")

    @F.pandas_udf("i array<int>, x array<float>")
    def featured(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("").tolist()
        out = []
        for a, b in batches_of(texts):
            features, sizes = hashed(texts[a:b], bits)
            for one in np.split(features, np.cumsum(sizes)[:-1]):
                i, k = np.unique(one, return_counts=True)
                i, x = np.append(i, 2**bits), np.append(k / max(1.0, np.sqrt(len(one))), 1.0)
                out.append((i.astype(np.int32), x.astype(np.float32)))
        return pd.DataFrame(out, columns=["i", "x"])

    rows = found.select(F.xxhash64("id", "text").alias("h"), "id", "y", featured("text").alias("f"))
    # One task learns from max_rows rows at most, in the order of their hash.
    sample = rows.orderBy("h", "id", "y").limit(max_rows).select("y", "f.i", "f.x")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(np.asarray(i, np.int64), np.asarray(x, float), y) for b in batches for i, x, y in zip(b["i"], b["x"], b["y"], strict=True)]
        w = train(seen, bits, epochs)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})

    weights = np.zeros(2**bits + 1, np.float32)
    for r in sample.coalesce(1).mapInPandas(learn, "at int, w float").toLocalIterator():  # 2**bits + 1 rows at most
        weights[r["at"]] = r["w"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = np.zeros(len(texts))
            for a, b in batches_of(texts):
                features, sizes = hashed(texts[a:b], bits)
                owner = np.repeat(np.arange(b - a), sizes)
                out[a:b] = np.bincount(owner, w[features], b - a) / np.maximum(1, np.sqrt(sizes)) + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    out = without(docs.withColumn("__score", scored(F.col(f"`{text_col}`"))), "score", "predicted")
    predicted = (F.col("__score") >= threshold).cast("int")
    return out.withColumn("predicted", predicted).withColumnRenamed("__score", "score")
