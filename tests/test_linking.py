"""Linking, reports, display and feed state on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from voxlake.functions import display
from voxlake.operators import linking, reports
from voxlake.streaming import health


@pytest.fixture(scope="module")
def ships(spark):
    rows = [("1", "STOLT KESTREL", "PA1234", "2026-01-01 10:00:00"), ("2", "ALFA", "XYZ99", "2026-01-01 01:00:00"), ("3", "BRAVO", None, None)]
    return spark.createDataFrame(rows, "mmsi string, name string, callsign string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_recent_ships(spark, ships):
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    assert [r.mmsi for r in linking.fresh_pool(ships, "last_seen", now, 60).collect()] == ["1"]
    assert linking.fresh_pool(ships, "last_seen", now, 540).count() == 2 and linking.fresh_pool(ships, "last_seen", now, 0).count() == 3


def test_enrichment_trusts_a_supported_callsign_over_a_name(spark, ships):
    rows = [(1, "PA1234", "alfa", "papa alfa one two three four"), (2, "PA1234", "alfa", "no call sign"), (3, "XYZ99", None, None), (4, None, " bravo ", "x"), (5, None, "nobody", "x"), (6, None, "alfa", "x")]
    got = {r.id: r for r in linking.enriched(spark.createDataFrame(rows, "id long, callsign string, vessel string, text string"), ships).collect()}
    assert [(got[i].mmsi, got[i].match_method, got[i].callsign) for i in range(1, 7)] == [
        ("1", "callsign", "PA1234"), ("2", "name", "PA1234"), ("2", "callsign", "XYZ99"), ("3", "name", None), (None, None, None), ("2", "name", "XYZ99"),
    ]
    assert got[5].vessel == "nobody"


def test_candidates_of_a_window(spark, ships):
    rows = [("w", "papa alfa one two three four over", "2"), ("w2", "alfa one two three four, stolt kestrel", None), ("w3", "alfa one two three four", None)]
    chunks = spark.createDataFrame(rows, "window string, text string, live_mmsi string")
    assert [(r.window, r.mmsi) for r in linking.spoken_callsigns(chunks, ships, "window").collect()] == [("w", "1")]
    assert [(r.window, r.mmsi, r.partial_pattern) for r in linking.partial_callsigns(chunks, ships, "window").collect()] == [("w2", "1", "A1234")]
    now = F.lit("2026-01-01 02:00:00").cast("timestamp")
    assert linking.live_candidates(chunks, ships, "window", now).count() == 1 and linking.live_candidates(chunks, ships, "window", now, 30).count() == 0


def test_guesses_are_renamed_by_a_later_similar_name(spark):
    rows = [("c", 1, 100, "stolt kestrl", True), ("c", 2, 150, "stolt kestrel", False), ("c", 3, 230, "stolt kestrel", False), ("c", 4, 160, "other", False), ("d", 5, 150, "stolt kestrel", False)]
    entries = spark.createDataFrame(rows, "channel string, id long, at long, vessel string, fuzzy boolean")
    assert [(r.new_id, r.id, r.new_vessel) for r in linking.renamed_guesses(entries, "channel", "at").collect()] == [(2, 1, "stolt kestrel")]


def test_finding_vessels(spark, ships):
    assert [r.mmsi for r in linking.find_vessels(ships, "kes").collect()] == ["1"] and [r.mmsi for r in linking.find_vessels(ships, "brafo").collect()] == ["3"]
    assert linking.find_vessels(ships, " ").count() == 0


def test_sightings_and_free_chunks(spark):
    snaps = spark.createDataFrame([("1", [(" KLM1 ",)]), ("2", [("KLM1",), ("",)])], "t string, aircraft array<struct<flight:string>>")
    assert [tuple(r) for r in linking.sightings(snaps).collect()] == [("KLM1", "1", "2", 2)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [r.id for r in linking.unassigned(ids(1, 2), ids(2, 2), ["id"]).collect()] == [1]


def test_correction_score(spark):
    rows = [("a b c", "a x c", "a b c", False, 1.0), ("a b", "a b", "a", False, 2.0), ("a", "b", "a", True, 9.0), ("", "x", "x", False, 5.0), (None, "x", "x", False, 5.0)]
    r = reports.correction_score(spark.createDataFrame(rows, "ref string, old string, new string, failed boolean, elapsed double"), "ref", "old", "new", "failed", "elapsed").first()
    assert (r.clips, r.improved, r.regressed, r.grew, r.shrank, r.failed, r.median_elapsed) == (3, 1, 1, 0, 1, 1, 2.0)
    assert r.wer_before == pytest.approx(2 / 6) and r.wer_after == pytest.approx(2 / 6)


def test_reports_on_small_tables(spark):
    hits = spark.createDataFrame([("a", ["b", "a"]), ("x", ["b"]), (None, ["a"])], "truth string, listed array<string>")
    assert tuple(reports.shortlist_hits(hits, "truth", "listed").first()) == (2, 1, 0.5, 2.0)
    assert [one(spark, reports.before_after(F.lit(b), F.lit(a))) for b, a in ((0.0, 0.5), (0.5, 0.0), (0.5, 0.1), (0.5, 0.4))] == ["inconclusive", "change helped", "partial", "no effect"]
    assert one(spark, reports.invented_words(F.array(F.lit("a"), F.lit("z"), F.lit("z")), F.array(F.lit("a")))) == ["z", "z"]
    days = spark.createDataFrame([("v", "d1", 3, 2), ("v", "d2", 0, 0)], "series string, day string, count long, uniques long")
    assert tuple(reports.traffic_report(days, "series").first()) == ("v", 3, 2, 1, "d2")
    matrix = reports.clip_matrix(spark.createDataFrame([("1", "x", 1.0), ("1", "y", 2.0)], "clip string, arm string, wer double"), "clip", "arm", "wer", ["x", "y"])
    assert tuple(matrix.first()) == ("1", 1.0, 2.0)


def test_exchanges_keep_their_turns_in_order(spark):
    chunks = spark.createDataFrame([(1, "10:00", "one"), (2, "10:01", "two"), (3, "10:02", "three")], "id long, time string, text string")
    exchanges = spark.createDataFrame([("e", [3, 1], "V")], "key string, chunk_ids array<long>, vessel string")
    corrections = spark.createDataFrame([("e", 3, "THREE")], "key string, id long, text string")
    r = reports.stored_exchanges(exchanges, chunks, corrections, "key").first()
    assert [(t.id, t.text, t.conv) for t in r.turns] == [(1, "one", None), (3, "three", "THREE")] and (r.start, r.end, r.vessel) == ("10:00", "10:02", "V")


def test_draft_labels_name_the_clips_inside(spark):
    exchanges = spark.createDataFrame([("c", 1000, 1400, "1", "V"), ("c", 5000, 5100, None, None)], "channel string, start long, end long, mmsi string, vessel string")
    clips = spark.createDataFrame([("c", "0002", 1400), ("c", "0001", 1000), ("c", "0003", 1401), ("d", "0004", 1100)], "channel string, clip string, at long")
    got = {r.start: (r.mmsi, r.note) for r in reports.draft_labels(exchanges, clips).collect()}
    assert got == {1000: ("1", "0001 0002"), 5000: ("-", None)}


def test_display(spark):
    s = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in k.items()])
    clue = lambda **k: s(**{"flight": None, "candidate": None, "repaired_from": None} | k)
    echo = lambda **k: s(**{"status": None, "flight": None, "hex": None, "kind": None, "value": None, "delay_s": None} | k)
    assert one(spark, display.evidence(F.lit(True), clue(), echo())) == "moved by hand"
    assert one(spark, display.evidence(F.lit(None).cast("boolean"), clue(flight="KLM1"), echo(status="none"))) == "callsign KLM1 heard"
    seen = echo(status="match", hex="abc", kind="altitude", value=4000, delay_s=12.4)
    assert one(spark, display.evidence(F.lit(False), clue(candidate="KLM2"), seen)) == "callsign KLM2 heard, not in ADS-B; abc selected 4000 ft 12 s later"
    assert one(spark, display.evidence(F.lit(False), clue(), echo(status="none"))) == "no clue"
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, display.particulars(F.lit(9), d(100), d(20), d(5.25), F.lit("RTM"), d(None), d(90.7), d(52), d(4))) == "IMO 9 · 100 × 20 m · draught 5.3 m · → RTM · 90° · 52.0000, 4.0000"
    assert [one(spark, display.is_airband(F.lit(c))) for c in ("118,000", "136.975", "137", "160,650", "x", None)] == [True, True, False, False, False, False]
    assert [one(spark, display.valid_key(F.lit(k))) for k in ("review", "heard:KLM1", "48abcd", "heard:", "x", None)] == [True, True, True, False, False, False]
    assert [one(spark, display.strip_enrichment(F.lit(t))) for t in ("[A/b] (PA1) hi", "(PA1) hi", "(MMSI:1) hi", "[A] hi")] == ["hi", "(PA1) hi", "hi", "hi"]
    assert [one(spark, display.read_label(F.lit(t))) for t in ("klm1", "klm1?", " ", None)] == ["KLM1", "UNSURE", "NONE", "NONE"]
    assert one(spark, display.clean_reply(F.lit('<think>x</think>Corrected transcript: "hello"'))) == "hello" and one(spark, display.strip_fence(F.lit('a ```json\n{"a": 1}\n``` b'))) == '{"a": 1}'
    assert [one(spark, display.is_malformed(F.lit("r"), F.lit(o), F.lit("a b"))) for o in ("fine", "We need to fix", "w " * 17)] == [False, True, True]
    assert one(spark, display.reference_text(F.lit(" a ? b "))) == "a [inaudible] b" and one(spark, display.reference_text(F.lit(" "))) is None
    line = display.system_line(F.lit(None).cast("string"), F.lit("KLM1"))
    assert tuple(one(spark, display.parsed_system(line))) == (None, "KLM1") and tuple(one(spark, display.parsed_system(F.lit("identified KLM1/A320")))) == ("KLM1", None)
    assert one(spark, display.resolver_lines(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("V")))) == "1. x\n2. y\n\n- V"


def test_aircraft_of_a_snapshot(spark):
    fields = "hex string, flight string, t string, r string, alt_baro string, nav_altitude_mcp double, nav_heading double, track double, lat double, lon double"
    craft = [("ABCDEF", " KLM1 ", "A320", "PH", "100", None, None, None, 53.0, 4.0), ("abcde0", "DAL2", "B", "N", "ground", None, None, None, None, None), ("~12345", "X1", None, None, None, None, None, None, 52.0, 4.0), ("abcde1", "AAA1", "B", "N", "5", None, None, None, 52.0, 4.0)]
    rows = spark.createDataFrame([(craft,)], f"aircraft array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")
    listed = rows.select(display.aircraft_listing(F.col("aircraft"), 52.0, 4.0).alias("l")).first().l
    assert [(a.flight, a.km is None) for a in listed] == [("AAA1", False), ("KLM1", False), ("DAL2", True)]
    state = rows.select(display.aircraft_state(F.col("aircraft"), F.lit("abcdef")).alias("s"), display.aircraft_state(F.col("aircraft"), F.lit("000000")).alias("none")).first()
    assert state.s.airline == "KLM" and state.s.t == "A320" and state.none is None


def test_lamps(spark):
    lamp = lambda age, connected, ok: one(spark, health.station_lamp(F.lit(age).cast("long"), F.lit(connected).cast("boolean"), F.lit(ok).cast("boolean")))
    assert [lamp(None, True, True), lamp(151, True, True), lamp(150, False, True), lamp(1, True, False), lamp(1, True, None)] == ["red", "red", "amber", "amber", "green"]
    hub = lambda f, since: one(spark, health.hub_lamp(F.lit(f), F.lit(since).cast("long"), F.lit(None).cast("long")))
    assert [hub(1, 5), hub(0, None), hub(0, 1801), hub(0, 1800)] == ["red", "unlit", "amber", "green"]


def test_hub_sink_publishes_scope_only_after_a_good_poll(spark, tmp_path):
    batch = lambda payload: spark.createDataFrame([(json.dumps(payload),)], "value string")
    write = health.hub_sink(str(tmp_path))
    write(batch([{"ERROR": False}, [{"MMSI": "1"}, {"MMSI": "2"}]]), 0)
    with pytest.raises(Exception, match="hub's answer"):
        write(batch([{"ERROR": True}]), 1)
    assert [p.name for p in (tmp_path / "scope").glob("poll=*")] == ["poll=0"] and spark.read.parquet(str(tmp_path / "scope")).count() == 2
