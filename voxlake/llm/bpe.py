"""Operator 3, BPE encoding and decoding: batched numpy merge rounds.

A batch of texts is split into words by the byte-level pattern, each different word once. The symbols of all
words lie in one flat array. In each round, every pair of neighbours inside a word is looked up by binary search in
the sorted array of pair keys; of each word, the pairs of its lowest rank merge, from the left and without overlap. Words without a
known pair leave the array. Decoding gathers the bytes of each id from one flat table.

The vocabulary is read on the driver (its path is a parameter) and travels to the tasks in a broadcast of about 2 MB, its
size fixed by the vocabulary. Texts are encoded whole, in batches of a bounded number of characters; a longer text is a
batch of its own.

Defined cases: a null or empty text has no ids and decodes to ''; special tokens standing in a text become their ids, as
the vocabulary file says; equal texts get equal rows; an empty table gives an empty result; input columns named like an
output column are replaced; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

#: Fixed values of the byte-level format: its word pattern, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Characters that a task works on at once; its numpy arrays take some 50 bytes for each.
BATCH_CHARS = 500_000


def byte_of_char() -> dict[str, int]:
    """The format writes a byte as a character: itself if printable, else the next one from U+0100 on."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Arrays of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        chars = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.byte_ids = np.zeros(256, np.int64)
        for ch, b in chars.items():
            self.byte_ids[b] = ids[ch]
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(chars[ch] for ch in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.size = size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the word of each. symbols, word: the words' byte ids in order."""
        done_symbols, done_word = [], []
        none = len(self.merged)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                pair = symbols[:-1] * self.size + symbols[1:]
                place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
                known = (self.keys[place] == pair) & (word[:-1] == word[1:])
                rank[:-1][known] = self.ranks[place[known]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            lowest_of = np.repeat(lowest, sizes)
            settled = lowest_of == none
            if settled.any():
                done_symbols.append(symbols[settled])
                done_word.append(word[settled])
                active = ~settled
                symbols, word, rank, lowest_of = symbols[active], word[active], rank[active], lowest_of[active]
                if not len(symbols):
                    break
            left = rank == lowest_of
            # In a run of such pairs (as in 'aaaa') every other one merges, from the left.
            at = np.flatnonzero(left)
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
            first = at[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))]
            at = at[(at - first[run]) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        find = regex.compile(PATTERN).findall
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None
        words: list[str] = []
        sizes = []
        specials = {}  # place among the words -> id
        for text in texts:
            before = len(words)
            if cut is not None and any(s in text for s in self.special):
                for piece in cut(text):
                    if piece in self.special:
                        specials[len(words)] = self.special[piece]
                        words.append("")
                    else:
                        words += find(piece)
            else:
                words += find(text)
            sizes.append(len(words) - before)
        if not words:
            return [np.zeros(0, np.uint32) for _ in texts]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        raw = [w.encode() for w in number]
        lengths = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids, owner = self.merge(self.byte_ids[flat], np.repeat(np.arange(len(raw)), lengths))
        counts = np.bincount(owner, minlength=len(raw))
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        per_word = counts[codes]
        for place in specials:
            per_word[place] = 1
        ends = np.cumsum(per_word)
        spread = np.arange(ends[-1]) - np.repeat(ends - per_word, per_word)
        source = np.repeat(starts[codes], per_word) + spread
        out = ids[np.minimum(source, len(ids) - 1)] if len(ids) else np.zeros(ends[-1], np.int64)
        for place, i in specials.items():
            out[ends[place] - 1] = i
        text_ends = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        out = out.astype("<u4")
        return [out[a:b] for a, b in zip(text_ends[:-1], text_ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        starts = self.token_starts[ids]
        lengths = self.token_starts[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return ""
        places = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
        return self.token_bytes[places].tobytes().decode("utf-8", "replace")


def batches_of(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of texts with at most so many characters together, or one longer text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _added(docs: DataFrame, vocabulary_path: str, schema: str, row) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    @F.pandas_udf(schema)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            rows = []
            for a, b in batches_of(texts):
                rows += [row(vocabulary.value, ids) for ids in vocabulary.value.encode(texts[a:b])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return coded


def encode(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (array of ints). Batches leave a task as soon as they are encoded, half a million characters at a time."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("ids", "n_tokens")]
    text_at = docs.columns.index(text_col)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            for a, b in batches_of(texts):
                ids = vocabulary.value.encode(texts[a:b])
                sizes = np.array([len(x) for x in ids], np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                own = batch.slice(a, b - a)
                columns = [own.column(i) for i in kept] + [pa.array(sizes.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in kept] + ["n_tokens", "ids"])

    schema = T.StructType([docs.schema.fields[i] for i in kept]).add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(coded, schema)


def digests(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the decoded text's UTF-8)."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    row = lambda v, ids: (len(ids), sha(ids.tobytes()), sha(v.decode(ids).encode()))
    return _with(docs, _added(docs, vocabulary_path, schema, row), text_col, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _with(docs: DataFrame, coded, text_col: str, names: list[str]) -> DataFrame:
    out = without(docs.withColumn("__coded", coded(F.col(f"`{text_col}`"))), *names)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "__coded"], *[F.col(f"__coded.{n}").alias(n) for n in names])


def decode(tokens: DataFrame, vocabulary_path: str, *, ids_col: str = "ids") -> DataFrame:
    """tokens with decoded, the text of an array of ids; null ids give ''."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([vocabulary.value.decode(np.asarray(x)) if x is not None else "" for x in ids], dtype=object)

    out = without(tokens.withColumn("__decoded", text(F.col(f"`{ids_col}`"))), "decoded")
    return out.withColumnRenamed("__decoded", "decoded")
