"""Operator 13 against a plain trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from voxlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, role[:64], text[:64], tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, m in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not children[seq]
            saved[seq[:d]] += (len(m) - 1) * len(seq[-1][1]) if seq else 0
    out = []
    for seq, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(seq))
        up = min(members[seq[:-1]]) if seq else None
        out.append((min(m), len(seq), up, len(m), children[seq], leaves[seq], saved[seq], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", key string, depth int")
    return sorted((tuple(r) for r in prefix_trie.rebuilt_trie(table).collect()), key=str)


def some(seed, n, turns, kinds):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, turns)):
            rows.append((c * 7 % 400, t, r.choice(["user", "assistant"]), r.choice(kinds)))
    return rows


def edge_rows():
    rows = some(1, 60, 8, ["", "a", "bb", "ö€😀"])
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(150) for t in range(6)]  # a group of copies
    rows += [(None, 0, "user", "lost"), (2000, None, None, None), (2000, 0, "user", None), (-5, 0, "user", "x"), (-5, 6, "user", "y"), (-105, 1, "a", "b")]
    rows += [(2100, 3, "user", "same"), (2100, 3, "user", "same"), (2100, 3, "assistant", "same"), (2100, 3, "user", "s" * 5000)]
    rows += [(2200, 0, "user", "one turn")]
    return rows


def test_equals_a_plain_trie(spark):
    rows = edge_rows()
    assert found(spark, rows) == plain(rebuilt(rows))


@pytest.mark.parametrize(("width", "batch", "parts"), [(64, 3, 3), (2, 10_000, 4), (3, 2, 5), (1, 4, 2)])
def test_any_cut_gives_the_same(spark, monkeypatch, width, batch, parts):
    """Rows of few turns, shards of few rows, several partitions: nodes on edges and tries below tries."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    rows = some(2, 90, 9, ["a", "b"]) + [(500 + i, t, "user", "long" if t < 11 else str(i % 2)) for i in range(3) for t in range(9 + 4 * i)]
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert found(spark, rows) == plain(rebuilt(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_conversation_with_most_turns(spark):
    rows = [(300, t, "user", f"turn {t % 50}") for t in range(1500)] + some(3, 20, 5, ["a", "b"])
    assert found(spark, rows) == plain(rebuilt(rows))


def test_ids_are_hashed_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(100 * i, 0, "user", "hello") for i in range(40)]
    assert found(spark, rows) == plain(rebuilt(rows))


def test_empty_table(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
