"""Similarity of strings: Indel ratio (T1), token-set ratio (T3), word edit distance (M1) and alignment (M3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are coded as the characters from here on, of which Unicode has a million.
FIRST_CODE, MOST_WORDS = 0x10000, 0xFFFFF


def places_of(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    return places


def common_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by the bit-vector recurrence: one big integer holds a row of the table.
    places: those of a, if they are known already."""
    if not a or not b:
        return 0
    find = (places or places_of(a)).get
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & find(ch, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Names:
    """Names laid out for common_length with many probes: a probe's characters run over all names at once, one 64-bit row of the table each."""

    def __init__(self, names: list[str]):
        self.names = names
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.long = np.flatnonzero(self.lengths > 64)  # these are taken one by one
        self.full = np.array([(1 << min(len(n), 64)) - 1 for n in names], np.uint64)
        self.codes = np.array(names, "U64").view(np.uint32).reshape(len(names), 64)
        self.masks: dict[str, np.ndarray] = {}

    def mask(self, ch: str) -> np.ndarray:
        """For each name the bits of a character's places."""
        if ch not in self.masks:
            self.masks[ch] = np.packbits(self.codes == ord(ch), axis=1, bitorder="little").view(np.uint64)[:, 0] & self.full
        return self.masks[ch]

    def common_lengths(self, probe: str) -> np.ndarray:
        row = self.full.copy()
        for ch in probe:
            hit = row & self.mask(ch)
            row = (row + hit | row - hit) & self.full
        out = self.lengths - np.bitwise_count(row).astype(np.int64)
        for k in self.long:
            out[k] = common_length(self.names[k], probe)
        return out


def indel_ratio_of(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


def indel_ratio(a: Column, b: Column) -> Column:
    """T1 of two columns; null if one is."""
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else indel_ratio_of(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(a, b)


def any_similar(texts: Column, name: Column, cutoff: float) -> Column:
    """Whether T1 of some of an array of texts and the name is the cutoff or more; texts that are too short or too long for that aren't compared."""
    def near(text: str | None, name: str) -> bool:
        return text is not None and 200.0 * min(len(text), len(name)) >= cutoff * (len(text) + len(name)) and indel_ratio_of(text, name) >= cutoff

    @F.pandas_udf("boolean")
    def found(arrays: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([a is not None and n is not None and any(near(t, n) for t in a) for a, n in zip(arrays, names, strict=True)], dtype=bool)

    return found(texts, name)


def token_set_ratio_of(a: str, b: str) -> float:
    """The best ratio among the sorted common words, and those followed by either side's own words."""
    x, y = set(a.split()), set(b.split())
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 100.0
    with_left, with_right = f"{common} {left}".strip(), f"{common} {right}".strip()
    scores = [indel_ratio_of(with_left, with_right)]
    if common:
        scores += [indel_ratio_of(common, with_left), indel_ratio_of(common, with_right)]
    return max(scores)


def token_set_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_set_ratio_of(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(a, b)


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """M1 of two arrays of words: each becomes a string of one character per word, for the built-in edit distance. A word of the
    hypothesis that the reference doesn't have equals none of its words, so that all such words can share one character. A reference
    of more than a million different words raises. Null for an empty reference."""
    def edits(sides: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(FIRST_CODE) + F.array_position(sides["vocabulary"], w)), 8, "0")), "UTF-32")
        spelt = lambda words: F.array_join(F.transform(words, code), "")
        too_many = F.raise_error(F.lit("a reference of more than a million different words")).cast("int")
        return F.when(F.size(sides["vocabulary"]) >= MOST_WORDS, too_many).otherwise(F.levenshtein(spelt(sides["reference"]), spelt(sides["hypothesis"])))

    sides = F.struct(F.array_distinct(reference).alias("vocabulary"), reference.alias("reference"), hypothesis.alias("hypothesis"))
    return F.when(F.size(reference) > 0, F.transform(F.array(sides), edits)[0])


def _aligned(reference: list[str], hypothesis: list[str]) -> list[tuple[str, str | None, str | None]]:
    """Edit operations from the front; among equals a match, then a substitution, an insertion, a deletion, seen from the back."""
    n, m = len(reference), len(hypothesis)
    cost = [list(range(m + 1))]
    for i, word in enumerate(reference, 1):
        row = [i]
        for j, other in enumerate(hypothesis, 1):
            row.append(min(cost[i - 1][j - 1] + (word != other), row[j - 1] + 1, cost[i - 1][j] + 1))
        cost.append(row)
    steps, i, j = [], n, m
    while i or j:
        here = cost[i][j]
        both = i and j
        if both and reference[i - 1] == hypothesis[j - 1] and cost[i - 1][j - 1] == here:
            step = ("match", 1, 1)
        elif both and cost[i - 1][j - 1] + 1 == here:
            step = ("sub", 1, 1)
        elif j and cost[i][j - 1] + 1 == here:
            step = ("ins", 0, 1)
        else:
            step = ("del", 1, 0)
        op, up, back = step
        steps.append((op, reference[i - 1] if up else None, hypothesis[j - 1] if back else None))
        i, j = i - up, j - back
    return steps[::-1]


def alignment(reference: Column, hypothesis: Column) -> Column:
    """M3: array<struct<op, ref, hyp>> of two arrays of words."""
    @F.pandas_udf("array<struct<op:string,ref:string,hyp:string>>")
    def aligned(left: pd.Series, right: pd.Series) -> pd.Series:
        rows = ([{"op": o, "ref": r, "hyp": h} for o, r, h in _aligned(list(x), list(y))] for x, y in zip(left, right, strict=True))
        return pd.Series(list(rows))

    return aligned(reference, hypothesis)
