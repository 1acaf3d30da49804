"""Operator 5, URL filters: a bit-parallel wildcard automaton.

Glob rules ('*' any run, '?' one character) are packed into one bit vector over several 64-bit words, a
Shift-And mask per character class. All rules then run at once over each canonical URL: one shift, two ands and
one or per character and word, for a whole Arrow batch of URLs together. A state before a '*' keeps itself.

The canonical URL is '.host#path': host in lower case behind a dot, so that '*.net#...' fits a domain and all its
subdomains; '#' can occur in neither part. Prefix rules (host, path) are globs of that form, and the longest one that
fits decides. Where none fits, the block globs do (spam hosts by default).

Defined cases: a null URL, or one without '://', has an empty host and path, fits no prefix rule and no default
glob, and is allowed; equal URLs get equal verdicts; an empty table gives an empty result; input columns named like
an output column are replaced. Any URL length is run to its end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

#: (verdict, host, path) of the contract; a path starts with '/'.
PREFIX_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Globs over '.host#path' that block where no prefix rule speaks.
BLOCK_GLOBS = ("*.spam-*#*", "*.cheap-pills.*#*", "*.casino-*#*", "*.free-bets.*#*", "*.ads-*#*", "*.adserver.*#*")
_CHUNK = 4096


class GlobAutomaton:
    """All globs in one multiword bit vector. State j of a rule: its first j tokens have been read."""

    def __init__(self, globs: Iterable[str]):
        self.globs = list(globs)
        rules = []
        for glob in self.globs:
            tokens, loops = [], set()
            for ch in glob:
                if ch == "*":
                    loops.add(len(tokens))
                else:
                    tokens.append(ch)
            rules.append((tokens, loops))
        literals = sorted({ord(t) for tokens, _ in rules for t in tokens if t != "?"})
        self.literals = np.array(literals, dtype=np.uint32)
        bits = sum(len(tokens) + 1 for tokens, _ in rules)
        n_words = max(1, -(-bits // 64))
        self.start, self.keep = np.zeros(n_words, np.uint64), np.zeros(n_words, np.uint64)
        self.masks = np.zeros((len(literals) + 1, n_words), np.uint64)  # class 0: a character in no rule
        self.ends = []
        at = 0
        for tokens, loops in rules:
            self._set(self.start, at)
            for j in loops:
                self._set(self.keep, at + j)
            for j, token in enumerate(tokens, 1):
                classes = range(len(literals) + 1) if token == "?" else [literals.index(ord(token)) + 1]
                for c in classes:
                    self._set(self.masks[c], at + j)
            self.ends.append(divmod(at + len(tokens), 64))
            at += len(tokens) + 1

    @staticmethod
    def _set(vector: np.ndarray, bit: int) -> None:
        vector[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean (text, rule)."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), _CHUNK):
            rows = order[at : at + _CHUNK]
            out[rows] = self._run([texts[i] for i in rows])
        return out

    def _run(self, texts: list[str]) -> np.ndarray:
        """texts: longest first, so that those still being read are a prefix."""
        lengths = np.array([len(t) for t in texts])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.literals):
            found = np.minimum(np.searchsorted(self.literals, codes), len(self.literals) - 1)
            classes = np.where(self.literals[found] == codes, found + 1, 0)
        else:
            classes = np.zeros(len(codes), np.int64)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        alive = len(texts)
        for step in range(int(lengths[0]) if len(texts) else 0):
            while lengths[alive - 1] <= step:
                alive -= 1
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.masks[classes[ends[:alive] + step]]) | (now & self.keep)
        return np.stack([(state[:, w] >> np.uint64(b)) & one == one for w, b in self.ends], axis=1) if self.ends else np.zeros((len(texts), 0), bool)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path, as SQL expressions."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parts = {
        "__host": ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
        "__path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    }
    return without(pages.withColumns(parts), "host", "path").withColumnsRenamed({"__host": "host", "__path": "path"})


def judge_urls(
    pages: DataFrame, *, url_col: str = "url", prefix_rules: Iterable = PREFIX_RULES, block_globs: Iterable[str] = BLOCK_GLOBS
) -> DataFrame:
    """pages with host, path, rule (null if no prefix rule fits), glob (the first block glob that fits) and verdict."""
    rules, globs = list(prefix_rules), list(block_globs)
    quoted = [f"*.{host}#{path}*" for _, host, path in rules]
    longest = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    names = [host + path for _, host, path in rules]

    @F.pandas_udf("rule string, glob string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(quoted + globs)
        for hosts, paths in batches:
            fits = automaton.matches([f".{h}#{p}" for h, p in zip(hosts, paths, strict=True)])
            rule, glob = np.full(len(hosts), None, object), np.full(len(hosts), None, object)
            verdict = np.full(len(hosts), "allow", object)
            for j in range(len(globs) - 1, -1, -1):
                hit = fits[:, len(rules) + j]
                glob[hit], verdict[hit] = globs[j], "block"
            for i in reversed(longest):  # a longer rule overwrites a shorter one
                rule[fits[:, i]], verdict[fits[:, i]] = names[i], rules[i][0]
            yield pd.DataFrame({"rule": rule, "glob": glob, "verdict": verdict})

    parted = without(with_parts(pages, url_col), "rule", "glob", "verdict")
    return parted.withColumn("__judged", judged("host", "path")).select(
        *[F.col(f"`{c}`") for c in parted.columns], "__judged.rule", "__judged.glob", "__judged.verdict"
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT page_id, host, path, '.' || host AS dotted,
         CASE WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(dotted, '\.(spam-|cheap-pills\.|casino-|free-bets\.|ads-|adserver\.)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
