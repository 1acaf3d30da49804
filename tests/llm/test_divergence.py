"""Operator 12 against a plain loop over count dictionaries."""

import re
from collections import Counter, defaultdict

from voxlake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, ranks=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        whole = Counter()
        for (l, _), c in counts.items():
            if l == lang:
                whole.update({t: n for t, n in c.items() if t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = share(whole)
        shares = {s: share(c) for (l, s), c in counts.items() if l == lang}
        for source, p in shares.items():
            pair = [(sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept), s) for s, o in shares.items() if s != source]
            term = [((p[t] - q[t]) ** 2 // (p[t] + q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "lang string, source string, text string, value string, n int")
    return sorted(map(tuple, divergence.audit(docs, **options).collect()))


def rows():
    words = ["the", "Of", "aNd", "Élan", "ÉLAN", "x9y", "snake_case", "日本語", "😀", "z"]
    found = [("en", f"s{i % 5}", " ".join(words[(i * k) % 10] for k in range(1, 2 + i % 9))) for i in range(160)]
    found += [("en", "hot", "the the of and z z z")] * 80  # repeated rows count each
    found += [("de", f"s{i % 2}", "der die das " + "und " * (i % 3)) for i in range(24)]
    found += [(None, None, None), (None, "s1", ""), ("en", None, "the\x00of"), ("fr", "only", "le la " * 9), ("fr", "none", None), ("en", "s0", "wort " * 300_000)]
    return found


def test_equals_a_plain_loop(spark):
    assert audited(spark, rows()) == plain(rows())


def test_small_tables_and_pieces_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert audited(spark, rows()[:200], min_docs=3, ranks=2) == plain(rows()[:200], 3, 2)


def test_ties_are_ranked_in_utf8_order(spark):
    docs = [("en", s, f"{a} {b}") for s in "ab" for a, b in (("é", "z"), ("Z", "é"), ("b", "a")) for _ in range(5 + (s == "b"))] + [("en", "c", "q q q")] * 10
    got = audited(spark, docs)
    assert got == plain(docs) and [r[3] for r in got if r[1] == "a" and r[2] == "term"]


def test_language_without_kept_terms_has_pairs_of_value_zero(spark):
    docs = [("xx", "a", "one"), ("xx", "b", "two"), ("xx", "c", None)]
    assert audited(spark, docs) == plain(docs)
    assert {r[4] for r in audited(spark, docs)} == {0}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_tables_handed_on_early_give_the_same():
    """What a task hands on adds up, however often it does."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": "en", "source": f"s{i % 3}", "text": f"a{chr(97 + i % 26)} b c c".encode()} for i in range(300)])
    sums = []
    for table in (divergence.TABLE, 2):
        before, divergence.TABLE = divergence.TABLE, table
        total = defaultdict(lambda: [0, 0])
        for found in divergence._counted(iter([batch])):
            for r in found.to_pylist():
                total[r["lang"], r["source"], r["term"]][0] += r["n"]
                total[r["lang"], r["source"], r["term"]][1] += r["docs"]
        divergence.TABLE = before
        sums.append(dict(total))
    assert sums[0] == sums[1]


def test_shares_of_large_counts_are_exact():
    import numpy as np

    counts, totals = np.array([[123_456_789_012, 7], [0, 3]]), np.array([200_000_000_000_000, 10])
    want = [[1 + 10**9 * (int(c) + 2) // (int(t) + 4) for c, t in zip(row, totals)] for row in counts]
    assert divergence._shares(counts, totals, 2).tolist() == want
