"""Squelch and voice activity in batches, against whole captures."""

import math
import random
from collections import Counter

import pytest

from voxlake.operators import signal

VAD = signal.Vad(onset=2, onset_of=4, pre_roll=2, hang=3, tail=1, longest=30, least_active=2, least_ratio=0.1, floor=5.0, window=20)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def captures():
    """Long and short captures, one without an id, one id next to another, and ids that no double holds."""
    r = random.Random(4)
    return {c: [r.choice([1.0, 2.0, 40.0]) if i // 25 % 2 else r.random() * 4 for i in range(n)] for c, n in ((2**60, 400), (2**60 + 1, 90), (None, 61), (5, 1))}


def frames(spark, held):
    rows = [(c, i, x) for c, xs in held.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "capture long, frame long, power double")


def streams(found):
    plan = found._jdf.queryExecution().toString()
    return "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_squelch_follows_captures_across_batches(spark, small_batches):
    held, want = captures(), {}
    rise, fall = math.exp(-1 / 5), math.exp(-1 / 100)
    for c, xs in held.items():
        level = xs[0]
        for i, x in enumerate(xs):
            keep = rise if x > level else fall
            level = keep * level + (1 - keep) * x
            want[c, i] = (x, pytest.approx(level), level >= 3.0)
    found = signal.squelch(frames(spark, held), "capture", "frame", "power", 3.0, 1000.0)
    assert {(r.capture, r.frame): (r.power, r.level, r.open) for r in found.collect()} == want
    assert streams(found)


def brute_chunks(levels, v):
    """The detector over a whole list, as before batches."""
    noise = lambda q: sorted(q)[int(v.share * (len(q) - 1))] if q else 0.0
    chunks, quiet, recent, active, begun, silent, n_active, total = [], [], [], [], None, 0, 0, 0
    for i, level in enumerate(levels):
        if begun is None:
            loud = level >= max(v.floor, noise(quiet[-v.window :]) * v.open_ratio)
            quiet += [] if loud else [level]
            active, recent = (active + [loud])[-v.onset_of :], (recent + [i])[-v.pre_roll :]
            if sum(active) >= v.onset:
                begun, total, n_active, silent, active, recent = recent[0], len(recent), sum(active), 0, [], []
            continue
        total += 1
        loud = level >= max(v.floor, noise(quiet[-v.window :]) * v.close_ratio)
        n_active, silent = (n_active + 1, 0) if loud else (n_active, silent + 1)
        if silent >= v.hang:
            if n_active >= v.least_active and n_active / total >= v.least_ratio:
                chunks.append((begun, i + 1 - max(0, v.hang - v.tail), n_active, total))
            quiet += [level]
            begun, silent = None, 0
        elif i + 1 - begun >= v.longest:
            chunks.append((begun, i + 1, n_active, total))
            begun, silent, n_active, total = i + 1, 0, 0, 0
    return chunks


def test_voice_activity_detects_across_batches(spark, small_batches):
    held = captures()
    want = Counter((c, k, *chunk) for c, xs in held.items() for k, chunk in enumerate(brute_chunks(xs, VAD)))
    found = signal.voice_activity(frames(spark, held), "capture", "frame", "power", VAD)
    assert Counter(map(tuple, found.collect())) == want and len(want) > 5
    assert streams(found)
