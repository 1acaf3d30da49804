"""The findings of round 3: a small case of each that failed before."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions import airband
from voxlake.operators import conversations, evaluation, fuzzy, linking, registry, temporal
from voxlake.plans import records
from voxlake.sources import files


def test_f1_a_word_is_held_against_airlines_once(monkeypatch):
    compared = []
    monkeypatch.setattr(airband, "indel_ratio_of", lambda a, b: compared.append((a, b)) or 0.0)
    airband.airline_of.cache_clear()
    for _ in range(50):
        assert airband.callsign_of("descending heading lufthansaa one two") is None
    airband.airline_of.cache_clear()
    assert len(compared) == len(set(compared)) and all(85 * (len(a) + len(b)) <= 200 * min(len(a), len(b)) for a, b in compared)


def test_f1_similar_airlines_are_found_as_before():
    airband.airline_of.cache_clear()
    assert [airband.airline_of(w) for w in ("lufthansaa", "speedbirt", "heading", "orangee", "klm", "lufthansaa")] == ["DLH", "BAW", None, None, "KLM", "DLH"]


def test_f3_patterns_meet_keys_by_equality(spark):
    asked = spark.createDataFrame([(p,) for p in ("AB.D", "....", ".B+D", "A..", "AB.E", "", None)], "pattern string")
    keys = spark.createDataFrame([(k,) for k in ("abcd", "xb+d", "ABC", "AXC", "abxe", "")], "name string")
    found = registry.unique_pattern(asked, keys, "pattern", "name")
    assert {tuple(r) for r in found.collect()} == {("AB.D", "ABCD"), ("....", None), (".B+D", "XB+D"), ("A..", None), ("AB.E", "ABXE"), ("", None), (None, None)}
    only = registry.unique_pattern(asked.filter("pattern = '....'"), keys.filter("name = 'abcd'"), "pattern", "name")
    assert [tuple(r) for r in only.collect()] == [("....", "ABCD")]  # no known character at all


@pytest.fixture
def suppliers(spark, tmp_path):
    """Keys of four and of five digits, of which some begin alike."""
    rows = [(k, f"S{k}") for k in (8, 1000, 9999, 10000, 10001, 10002, 10003)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_f5_references_of_clips_beyond_four_digits(spark, suppliers):
    found = records.q_reference_file(spark, suppliers).collect()
    assert sorted(map(tuple, found)) == sorted((f"{k:04d}"[:4], f"S{k}") for k in (8, 1000, 9999, 10000, 10001, 10002, 10003) if k % 3 < 2)


def test_f7_results_of_clips_beyond_four_digits(spark, suppliers):
    found = records.q_results_file(spark, suppliers).collect()
    assert sorted((r["clip_id"], r["text"]) for r in found) == sorted((f"{k:04d}"[:4], f"S{k}") for k in (8, 1000, 9999, 10000, 10001, 10002, 10003))


def test_f9_captures_beyond_four_digits(spark, suppliers, tmp_path):
    lines = [f'{{"index": {k}, "timestamp": "2026-01-01T10:00:00", "channel": "c", "text": "t{k}"}}' for k in (8, 9999, 10000, 10001)]
    (tmp_path / "captures.txt").write_text("\n".join(lines))
    found = files.capture_index(spark, str(tmp_path / "captures.txt")).collect()
    assert sorted((r["clip"], r["text"]) for r in found) == [("0008", "t8"), ("10000", "t10000"), ("10001", "t10001"), ("9999", "t9999")]
    assert records.q_capture_index(spark, suppliers).count() == 7


def test_f6_places_by_the_number_of_the_clip(spark):
    rows = [(c, "2026-01-01 10:00:00", "c", f"text {c}") for c in ("10001", "9999", "0008", "10000")]
    captures = spark.createDataFrame(rows, "clip string, stamp string, channel string, text string")
    found = files.replay_chunks(captures).orderBy("place").collect()
    assert [r["clip"] for r in found] == ["0008", "9999", "10000", "10001"]


def test_f12_f16_the_nearest_row_without_pairs(spark):
    roll = random.Random(3)
    asked = [(k, roll.choice("ab"), roll.randrange(400)) for k in range(120)] + [(900, "a", None), (901, None, 5)]
    rows = [(k, roll.choice("ab"), roll.randrange(400)) for k in range(200)] + [(800, "a", None), (801, None, 5)]
    left, right = spark.createDataFrame(asked, "id long, k string, at long"), spark.createDataFrame(rows, "n long, k string, at long")
    found = temporal.nearest_within(left, right, "id", "at", 3, "n", ["k"])
    best = {i: min(((abs(t - at), n) for n, kk, at in rows if None not in (t, at, k) and kk == k and abs(t - at) <= 3), default=(None, None)) for i, k, t in asked}
    assert {r["id"]: (r["delta"], r["found"] and r["found"]["n"]) for r in found.collect()} == best
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # rows within one bucket made pairs


def _echo(spoken, snaps, before, after, altitude, heading):
    """J7 as a plain loop."""
    times, out = sorted({t for t, *_ in snaps}), {}
    by = {}
    for t, hex_, ground, alt, head in snaps:
        by[t, hex_] = (ground, alt, head)
    for id_, t, numbers in spoken:
        base = max((x for x in times if x <= t - before), default=None)
        later = [x for x in times if t - before < x <= t + after]
        near = lambda kind, v, w: v is not None and (abs(v - w) <= altitude if kind == "altitude" else abs((v - w + 180) % 360 - 180) <= heading)
        hits = {}
        for pos, (kind, w) in enumerate(numbers):
            k = 1 if kind == "altitude" else 2
            for x in later:
                for (at, hex_), row in by.items():
                    old = by.get((base, hex_))
                    if at == x and not row[0] and near(kind, row[k], w) and old and old[k] is not None and not near(kind, old[k], w):
                        hits[hex_] = min(hits.get(hex_, (pos, x)), (pos, x))
        status = "no_numbers" if not numbers else "no_snapshots" if base is None or not later else ("none", "match")[len(hits)] if len(hits) < 2 else "ambiguous"
        only = next(iter(hits)) if status == "match" else None
        out[id_] = (status, (only, hits[only][1] - t) if only else None, sorted(hits))
    return out


def test_f10_f11_changes_meet_numbers_by_size(spark):
    roll = random.Random(7)
    snaps = [(t, f"h{h}", roll.random() < 0.1, roll.choice([None, 1000.0, 1100.0, 1200.0, 2000.0, -100.0]), roll.choice([None, 0.0, 3.0, 357.0, 180.0, 359.5])) for t in [*range(0, 300, 15), *range(5000, 5200, 15)] for h in range(6)]
    spoken = [(k, roll.choice([roll.randrange(-30, 420), roll.randrange(4900, 5400), 20000]), [(roll.choice(["altitude", "heading"]), roll.choice([0, 2, 90, 358, 360, 1000, 1100, 2000])) for _ in range(roll.randrange(3))]) for k in range(150)]
    numbers = spark.createDataFrame(spoken, "id long, t long, numbers array<struct<kind:string,value:int>>")
    table = spark.createDataFrame(snaps, "t long, hex string, on_ground boolean, selected_altitude double, selected_heading double")
    found = temporal.change_echo(numbers, table)
    got = {r["id"]: (r["status"], (r["hex"], r["delay"]) if r["hex"] else None, list(r["candidates"])) for r in found.collect()}
    assert got == _echo(spoken, snaps, 10, 60, 100.0, 5.0) and len({v[0] for v in got.values()}) == 5
    assert "is_altitude" in found._jdf.queryExecution().optimizedPlan().toString()  # numbers met every aircraft of their time


def test_f13_rows_without_a_key_are_dealt(spark):
    rows = spark.createDataFrame([(1, None, " b ", None), (2, "pa1", None, "this is pa-1"), (3, None, None, "x"), (4, " ", "zz", "x")], "id long, callsign string, vessel string, text string")
    ships = spark.createDataFrame([("7", "B", "PA1"), ("8", "C", "PA2")], "mmsi string, name string, callsign string")
    found = linking.enriched(rows, ships)
    assert {tuple(r)[:5] for r in found.collect()} == {(1, "B", "7", "PA1", "name"), (2, "B", "7", "pa1", "callsign"), (3, None, None, None, None), (4, "zz", None, None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(id") >= 2 or plan.count("xxhash64(") >= 2  # else nulls share one task


def test_f14_the_row_at_a_share_without_ranking_all(spark):
    roll = random.Random(5)
    values = {"a": [roll.choice([1.0, 2.5, 7.0]) for _ in range(500)], "b": [roll.random() for _ in range(12_000)], "c": [4.0], None: [3.0, 1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, some in values.items() for v in [*some, None]], "k string, v double")
    for share in (0.0, 0.001, 0.5, 0.95, 1.0):
        found = evaluation.floor_percentile_rows(rows, "k", "v", share)
        assert {r["k"]: r["value"] for r in found.collect()} == {k: sorted(some)[int(share * (len(some) - 1))] for k, some in values.items()}
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_f17_names_are_held_against_a_text_in_one_row(spark):
    chunks = spark.createDataFrame([(1, "calling neptune star now"), (2, "nothing here"), (3, None)], "w long, text string")
    pairs = spark.createDataFrame([(1, "Neptune Stars"), (2, "Neptune Stars"), (3, "Neptune"), (1, None)], "w long, name string")
    found = linking.corroborated(pairs, chunks, "w", "name")
    assert [tuple(r) for r in found.collect()] == [(1, "Neptune Stars")]
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_f2_nothing_is_broadcast(spark):
    probes = spark.createDataFrame([(1, 0, "NEPTUNE"), (2, 0, "ORION")], "key long, pos int, probe string")
    found = fuzzy.shortlist(probes, spark.createDataFrame([("7", "NEPTUNES"), ("8", "ORION")], "mmsi string, name string"), "key")
    assert {(r["key"], r["mmsi"]) for r in found.collect()} == {(1, "7"), (2, "8")}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


TURNS = "exchange long, channel string, turns array<struct<at: long, raw: string, text: string, live_vessel: string>>"
LABELS = "label long, channel string, start long, end long"


def rebuilt(exchanges, labels, ships):
    """Windows by plain loops."""
    found = []
    for label, channel, start, end in labels:
        if channel is None or start is None or end is None:
            continue
        own = [(x, turns) for x, c, turns in exchanges if x is not None and c == channel and any(t[0] is not None and start <= t[0] <= end for t in turns or [])]
        rows = sorted((t[0] is not None, t[0] or 0, x, i, t) for x, turns in own for i, t in enumerate(turns))
        for place, (_, _, x, _, (at, raw, text, live)) in enumerate(rows, 1):
            numbers = [m for n, m in ships if live is not None and n is not None and n.strip().upper() == live.strip().upper()]
            found.append((label, start, place, x, channel, at, raw or text, text, live, min(numbers, default=None)))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_f4_windows_equal_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(conversations, "BLOCK_TURNS", 8)
    r = random.Random(seed)
    turn = lambda at: (None if r.random() < 0.05 else at, r.choice([None, "", "raw"]), r.choice([None, f"said {at}"]), r.choice([None, "alfa ", "BRAVO", "none"]))
    exchanges = []
    for x in range(60):
        at, reach = r.choice([0, 40, r.randint(-200, 1500)]), r.choice([0, 3, 30, 400])
        exchanges.append((None if x == 7 else x, r.choice(["a", "a", "b", None]), [turn(at + r.randint(0, reach)) for _ in range(r.randint(0, 6))] if x != 9 else None))
    exchanges += [(100, "a", [turn(-50), turn(900_000_000)]), (101, "a", [(None, None, "x", None), (None, None, "y", None)]), (102, "a", [(None, "z", None, None), (45, None, "v", None)])]
    labels = []
    for i in range(40):
        start = r.choice([None, 40, r.randint(-250, 1600)])
        labels.append((i, r.choice(["a", "a", "b", "c", None]), start, None if start is None else start + r.choice([-5, 0, 1, 20, 50, 51, 100, 399, 900])))
    labels += [(50, "a", -500, 950_000_000), (51, "a", 1000, 2_000_000), (52, "a", None, 5), labels[3]]
    ships = [("Alfa", "2"), ("ALFA", "1"), (" bravo", "3"), (None, "4")]
    found = conversations.rebuilt_windows(spark.createDataFrame(exchanges, TURNS), spark.createDataFrame(labels, LABELS), spark.createDataFrame(ships, "name string, mmsi string"), 50)
    assert found.columns == ["label", "reference_at", "place", "exchange", "channel", "at", "text", "corrected", "live_vessel", "live_mmsi"] and dict(found.dtypes)["place"] == "int"
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rebuilt(exchanges, labels[:-1], ships), key=str)


def shuffled(df):
    """Records that a query shuffles."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            n += node.metrics().apply("shuffleRecordsWritten").value()
        below = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        todo += below
    return n


def test_f4_no_pair_of_label_and_turn_is_shuffled(spark):
    def job(n):
        rows = spark.createDataFrame([(i, i % 97) for i in range(n)], "id long, s long")
        turn = F.struct(F.col("s").alias("at"), F.lit("").alias("raw"), F.lit("said").alias("text"), F.lit("alfa").alias("live_vessel"))
        exchanges = rows.select(F.col("id").alias("exchange"), F.lit("a").alias("channel"), F.array(turn).alias("turns"))
        labels = rows.select(F.col("id").alias("label"), F.lit("a").alias("channel"), F.col("s").alias("start"), (F.col("s") + 30).alias("end"))
        return conversations.rebuilt_windows(exchanges, labels, spark.createDataFrame([("ALFA", "1")], "name string, mmsi string"), 30)

    few, many = shuffled(job(200)), shuffled(job(800))
    assert 0 < many <= 5 * few  # the result is sixteen times as large
