"""Queries that SQL can't express, against plain loops over the same rows; and what works in blocks against what doesn't."""

import math
import random
import re
import shutil
import subprocess
import sys
from collections import Counter
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import signal, similarity, text
from voxlake.functions.similarity import Names, common_length, token_set_ratio_of
from voxlake.operators import clips, evaluation, linking, sessions
from voxlake.plans import evaluation as evaluation_plan
from voxlake.plans import reports as reports_plan
from voxlake.plans import text as plan

SF = "/root/testdata/sf0.001"


def turns(spark, words=None):
    swap = dict(words or ())
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    return [(r.conv_id, r.turn, " ".join(swap.get(w, w) for w in r.text.split(" "))) for r in rows]


def made_up(said):
    t = said.strip()
    low = t.lower().rstrip(".,!?").strip()
    words = low.split()
    return (
        len(t) < 2 or low in text.HALLUCINATIONS or re.fullmatch(r"[\W\s]+", t) is not None or len(words) >= 4 and len(set(words)) == 1
        or re.fullmatch(r"(\w[\w\s]*?)\s*(\1\s*){3,}", t, re.IGNORECASE) is not None
    )


def test_hallucinations(spark):
    want = {}
    for conv, _, said in turns(spark):
        for piece in said.split("."):
            n, k = want.get(conv, (0, 0))
            want[conv] = (n + 1, k + made_up(piece))
    assert {r.conv_id: (r.n, r.n_made_up) for r in plan.q_hallucination(spark, SF).collect()} == want
    for said in ("thank you.", "you you you you", "ab ab ab ab", "ab ab ab", "Bye!", "...", "roger that", "", "hm"):
        assert spark.range(1).select(text.hallucination(F.lit(said)).alias("x")).first().x == made_up(said)


#: What is heard and what the station's rules make of it.
STATION = [
    ("mass approach, good day", "Maas Approach, good day"), ("Aas Aapproach", "Maas Approach"), ("mus approaching", "mus approaching"), ("Tower approach", "Tower approach"),
    ("maes centre", "Maas Center"), ("Maaf center, Recon", "Maas Center, Recon"), ("mass  aproch", "Maas  Approach"), ("M.A.A.S. proach us", "Maas Approach us"), ("mass centers", "mass centers"),
    ("mass approach approach", "Maas Approach approach"), ("tower approach mass approach", "tower approach Maas Approach"), ("the mass aroach and mass center", "the Maas Approach and Maas Center"),
    ("(maas) approach", "(maas) approach"), ("5mass approach", "5mass approach"), ("mass-maas approach.", "mass-Maas Approach."), ("abcdefghijklmaas approach", "abcdefghijklmaas approach"),
    ("mass approaches", "Maas Approach"), ("approach", "approach"), ("mass\napproach", "Maas\nApproach"), ("", ""), ("mass", "mass"), ("maas centrer", "maas centrer"), ("mass apache", "mass apache"),
]


def test_station_corrections(spark):
    rows = spark.createDataFrame(STATION, "said string, want string").withColumn("got", text.station_corrections(F.col("said")))
    assert [(r.said, r.got) for r in rows.collect()] == STATION
    ruled = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", text.rule_corrections(plan._garbled(F.col("text"))).alias("ruled")).collect()
    got = {(r.conv_id, r.turn): r.corrected for r in plan.q_station_corrections(spark, SF).collect()}
    assert set(got) == {(r.conv_id, r.turn) for r in ruled} and len(got) > 50
    for r in ruled:  # nothing but the station's name and its noun changes
        changed = [after for before, after in zip(r.ruled.split(), got[r.conv_id, r.turn].split(), strict=True) if before != after]
        assert all(w.rstrip(".,!?").endswith(("Maas", "Approach", "Center")) for w in changed)


def gapped(said):
    after = re.search(r"\bcall\s?signs?\b(.*)$", said, re.IGNORECASE | re.DOTALL)
    out = ""
    for w in re.findall(r"[a-z0-9'-]+", (after[1] if after else "").lower()):
        compact = re.fullmatch("[a-z0-9]{1,8}", w) and (len(w) == 1 or re.search("[0-9]", w) and re.search("[a-z]", w))
        out += text.LETTERS.get(w) or text.DIGITS.get(w) or (w.upper() if compact else ".")
    out = out.strip(".")
    known = len(out.replace(".", ""))
    return out if "." in out and "..." not in out and known >= 3 and len(out) <= 7 else None


def test_partial_patterns(spark):
    want = Counter()
    for conv, _, said in turns(spark, plan._SPELT):
        for piece in re.split(r"[.,\n]", said):
            if (found := gapped("callsign " + piece)) is not None:
                want[conv, found] += 1
    assert {(r.conv_id, r.pattern): r.n for r in plan.q_partial_pattern(spark, SF).collect()} == want
    assert [gapped(s) for s in ("callsign papa alfa um one two", "callsign um one two", "alfa um bravo one")] == ["PA.12", None, None]


def test_substitutions(spark):
    """The alignment that prefers, from the back, a match, then a substitution, an insertion, a deletion."""
    want = Counter()
    for r in evaluation_plan._pairs(spark, SF).collect():
        a, b = ([w for w in re.findall(r"[a-z0-9']+", re.sub(r"\[[^\]]*\]", " ", x or "").lower())] for x in (r.ref, r.hyp))
        cost = np.zeros((len(a) + 1, len(b) + 1), int)
        cost[:, 0], cost[0] = range(len(a) + 1), range(len(b) + 1)
        for i, j in ((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1)):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i, j - 1] + 1, cost[i - 1, j] + 1)
        i, j = len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i - 1, j - 1] + 1:
                want[b[j - 1], a[i - 1]] += 1
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i, j - 1] + 1:
                j -= 1
            else:
                i -= 1
    assert {(r.hyp, r.ref): r.n for r in evaluation_plan.q_substitutions(spark, SF).collect()} == want


def test_signal_kernels():
    x = np.random.default_rng(1).normal(size=300)
    w, q = 2 * math.pi * 150 / 16000, 0.7071
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    y = []
    for n in range(len(x)):
        at = lambda s, k: s[n - k] if n >= k else 0.0  # noqa: E731, B023
        y.append(((1 + c) / 2 * x[n] - (1 + c) * at(x, 1) + (1 + c) / 2 * at(x, 2) + 2 * c * at(y, 1) - (1 - alpha) * at(y, 2)) / (1 + alpha))
    assert np.allclose(signal.high_pass(x[None], 16000.0)[0], y)
    y = []
    for n in range(len(x)):
        y.append(x[n] - (x[n - 1] if n else 0) + 0.995 * (y[n - 1] if n else 0))
    assert np.allclose(signal.dc_block(x[None])[0], y)
    taps = signal.low_pass(7200.0, 48000.0)
    smooth = [sum(h * (x[n + 31 - k] if 0 <= n + 31 - k < len(x) else 0) for k, h in enumerate(taps)) for n in range(len(x))]
    assert np.allclose(signal.resample(x[None], 48000.0, 16000.0)[0], smooth[::3])
    taps = signal.low_pass(7200.0, 37500.0)
    smooth = [sum(h * (x[n + 31 - k] if 0 <= n + 31 - k < len(x) else 0) for k, h in enumerate(taps)) for n in range(len(x))]
    size = int(300 * 16000 / 37500)
    assert np.allclose(signal.resample(x[None], 37500.0, 16000.0)[0], np.interp(np.linspace(0, 299, size), range(300), smooth))


def test_renamed_guesses(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id % 5 AS channel", "event_id AS id", "event_id * 40 AS at").collect()
    said = [(r.channel, r.id, r["at"], reports_plan._HEARD[r.id * 5 % len(reports_plan._HEARD)]) for r in rows]
    want = {}
    for channel, new, at, vessel in said:
        near = [(t, i, v) for c, i, t, v in said if c == channel and i % 2 == 0 and at - 900 < t < at and v != vessel and token_set_ratio_of(v.lower(), vessel.lower()) >= 50]
        if near:
            _, i, v = max(near)
            want[new] = (i, v, vessel)
    got = {r.new_id: (r.id, r.vessel, r.new_vessel) for r in reports_plan.q_renamed_guesses(spark, SF).collect()}
    assert got == want and got


def test_names_at_once_are_as_names_one_by_one():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.choice([0, 1, 5, 20, 63, 64, 65, 90])))
    names = [word() for _ in range(200)]
    laid = Names(names)
    for probe in [word() for _ in range(40)]:
        assert laid.common_lengths(probe).tolist() == [common_length(n, probe) for n in names]


def test_sessions_in_blocks_are_as_in_one(spark):
    r = random.Random(7)
    rows = [(c, i, None if r.random() < 0.05 else r.randrange(3000)) for c in ("a", "b", None, "") for i in range(150)]
    want = {}
    for channel, held in groupby(sorted(rows, key=lambda x: (str(x[0]), x[2] is not None, x[2] or 0, x[1])), key=lambda x: x[0]):
        session = n = 0
        before = None
        for _, i, at in held:
            if at is not None and before is not None and at - before > 10:
                session, n = session + 1, 0
            want[channel, i] = (session, n // 4)
            n, before = n + 1, at
    table = spark.createDataFrame(rows, "channel string, id long, at long")
    for block in (1, 3, 4096):
        got = {(x.channel, x.id): (x.session, x.window) for x in sessions.gap_sessions(table, "channel", "at", "id", 10, 4, block).collect()}
        assert got == want


def test_bootstrap_with_and_without_a_join(spark, monkeypatch):
    clips_ = spark.range(40).selectExpr("id", "id % 5 AS ea", "id % 7 + 3 AS wa", "id % 3 AS eb", "id % 4 + 2 AS wb")
    args = ("id", ("ea", "wa"), ("eb", "wb"), 50, 3)
    want = evaluation.bootstrap_ci(clips_, *args).collect()
    monkeypatch.setattr(evaluation, "MOST_SHARED", 0)
    assert evaluation.bootstrap_ci(clips_, *args).collect() == want
    assert evaluation.bootstrap_ci(clips_.limit(0), *args).count() == 1


def test_edit_distance_of_very_many_words(spark):
    words = [f"w{i}" for i in range(70_000)]
    rows = spark.createDataFrame([(words, [*words[:69_990], "x", *words[69_995:]])], "a array<string>, b array<string>")
    assert rows.select(F.levenshtein(F.lit("a"), F.lit("b")).alias("x"), similarity.word_edits(F.slice("a", 69_900, 101), F.slice("b", 69_900, 97)).alias("e")).first().e == 5
    few = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    assert few.select(similarity.word_edits(F.col("a"), F.col("b")).alias("e")).first().e == 2


def test_partial_callsigns_by_pattern_come_before_tails(spark):
    ships = spark.createDataFrame([("1", "STOLT KESTREL", "PAX12"), ("2", "ALFA", "PBX99")], "mmsi string, name string, callsign string")
    said = [("w", "callsign papa alfa um one two, stolt kestrel"), ("x", "callsign papa alfa um one two")]
    got = linking.partial_callsigns(spark.createDataFrame(said, "window string, text string"), ships, "window").collect()
    assert [tuple(r) for r in got] == [("w", "1", "STOLT KESTREL", "PA.12")]


def test_clips_are_found_by_name(spark, tmp_path):
    for name in ("2026-01-01/0001_sent.wav", "2026-01-01/0001_raw.wav", "2026-01-02/0002_sent.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(map(tuple, clips.discovered(spark, str(tmp_path)).collect())) == [("2026-01-01", "0001"), ("2026-01-02", "0002")]


@pytest.mark.parametrize("folder", [Path(__file__).resolve().parent.parent])
def test_a_copy_without_the_corpus_operators_still_imports(folder, tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(folder, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and all(n.startswith('q_') for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin"}).returncode == 0
