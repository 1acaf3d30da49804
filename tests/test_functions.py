"""Text, similarity, geometry and time functions on single values and against brute force."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import geo, similarity, text, time


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def on_texts(spark, texts, column):
    return [r[0] for r in values(spark, [(t,) for t in texts], "t string", column)]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abcé ", max_size=80))
def test_common_length_agrees_with_the_table(a, b):
    assert similarity.common_length(a, b) == brute_common(a, b)
    total = len(a) + len(b)
    assert similarity.indel_ratio_of(a, b) == (100.0 if not total else 200.0 * brute_common(a, b) / total)


def test_token_set_ratio():
    assert similarity.token_set_ratio_of("alfa bravo", "bravo alfa alfa") == 100.0
    assert similarity.token_set_ratio_of("alfa", "alfa charlie") == 100.0
    assert similarity.token_set_ratio_of("alfa", "zzz") < 50


def test_ratio_columns_pass_nulls(spark):
    rows = [("abc", "abd"), (None, "x"), ("x", None), ("", "")]
    got = values(spark, rows, "a string, b string", similarity.indel_ratio(F.col("a"), F.col("b")), similarity.token_set_ratio(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(200 * 2 / 6) and got[1] == (None, None) and got[2] == (None, None) and got[3][0] == 100.0


def test_word_edits_and_alignment(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "y"]), ([], ["a"]), (["a", "b"], []), (["a", "a"], ["a"])]
    got = values(spark, rows, "r array<string>, h array<string>", similarity.word_edits(F.col("r"), F.col("h")), similarity.alignment(F.col("r"), F.col("h")))
    assert [g[0] for g in got] == [2, None, 2, 1]
    assert [(s.op, s.ref, s.hyp) for s in got[0][1]] == [("match", "a", "a"), ("sub", "b", "x"), ("match", "c", "c"), ("ins", None, "y")]
    assert [s.op for s in got[1][1]] == ["ins"] and [s.op for s in got[2][1]] == ["del", "del"]


def test_distances_and_bearings(spark):
    rows = [(52.0, 4.0, 52.0, 4.0), (0.0, 0.0, 0.0, 90.0), (0.0, 0.0, 10.0, 0.0), (None, 0.0, 0.0, 0.0)]
    columns = [F.col(c) for c in "abcd"]
    got = values(spark, rows, "a double, b double, c double, d double", geo.great_circle_km(*columns), geo.bearing_deg(*columns))
    assert got[0][0] == 0 and got[1] == (pytest.approx(6371 * math.pi / 2), pytest.approx(90)) and got[2][1] == pytest.approx(0) and got[3] == (None, None)


def test_ship_types_and_stations(spark):
    types = {r.code: (r.coarse, r.reading) for r in geo.ship_types(spark).collect()}
    assert len(types) == 100 and types[70][0] == "Cargo" and types[81][1].startswith("Tanker — carrying hazardous") and types[5][0] == "Reserved"
    named = geo.with_ship_type(spark.createDataFrame([("70",), ("250",), (None,), ("x",)], "type string"), "type").collect()
    assert {r.type: r.type_name for r in named} == {"70": "Cargo", "250": "Type 250", None: None, "x": "Type x"}
    kinds = on_texts(spark, ["244123456", "002442000", "992440000", "970123456", "012345678", "111222333", "812345678", "x", "1234567890", None], geo.mmsi_class(F.col("t")))
    assert kinds == ["ship", "coast-station", "aton", "ais-sart", "ship-group", "sar-aircraft", "invalid", "invalid", "invalid", "invalid"]


def test_hallucinations(spark):
    made_up = ["you", "Thank you.", "", "a", "...", "go go go go", "over and out over and out over and out over and out", None, "  um  "]
    real = ["Maas Approach, Alfa", "go go go", "thank you sir", "over and out"]
    assert on_texts(spark, made_up + real, text.hallucination(F.col("t"))) == [True] * len(made_up) + [False] * len(real)


def test_prompt_echo(spark):
    prompt = "Maas Approach, motortanker Stolt Kestrel, draught"
    rows = [("stolt", prompt), ("maas approach", prompt), ("maas approach draught", prompt), ("stolt heading", prompt), ("", prompt), (None, prompt), ("stolt", None)]
    assert [r[0] for r in values(spark, rows, "t string, p string", text.prompt_echo(F.col("t"), F.col("p")))] == [True, False, True, False, False, False, False]


def test_corrections(spark):
    got = on_texts(spark, ["mass approach, motor vessel, draft two boys", "letter of the boy", "cosine PA", "Mars proach", "nice approaching", None], text.corrections(F.col("t")))
    assert got[:3] == ["Maas Approach, Motorvessel, draught two buoys", "letter of the buoy", "Callsign PA"]
    assert got[3] == "Maas Approach" and got[4] == "nice approaching" and got[5] is None


def test_spoken_callsigns(spark):
    assert on_texts(spark, ["papa alfa one two three, over", "no letters", None], text.spelled_runs(F.col("t")))[:1] == [["PA123"]]
    assert on_texts(spark, ["papa alfa one", "one two three", "papa one", "a b papa alfa"], text.phonetic_probes(F.col("t"))) == [["PA1"], [], [], ["ABPA"]]
    assert on_texts(spark, ["callsign papa something charlie one two", "callsign papa bravo", "papa x charlie"], text.partial_pattern(F.col("t"))) == ["P.C12", None, None]
    rows = [("PA12", "papa alfa one two"), ("PA12", "this is pa-12"), ("P", "papa"), (None, "papa")]
    assert [r[0] for r in values(spark, rows, "c string, t string", text.callsign_supported(F.col("c"), F.col("t")))] == [True, True, False, False]


def test_probes(spark):
    probes = on_texts(spark, ["good morning stolt kestrel", "", None], text.hint_probes(F.col("t")))
    assert "STOLT KESTREL" in probes[0] and "GOOD MORNING" not in probes[0] and probes[0].index("STOLT") < probes[0].index("STOLT KESTREL") and probes[1:] == [[], []]
    assert on_texts(spark, ["motor tanker stolt kestrel", "mv"], text.name_probes(F.col("t"))) == [["STOLT KESTREL", "STOLT", "KESTREL"], []]


def test_small_text_functions(spark):
    assert on_texts(spark, ["NLRTM@@@", "@", " X ", None], text.clean_destination(F.col("t"))) == ["NLRTM", None, "X", None]
    assert on_texts(spark, ["[ALFA/TANKER] hi", "[ALFA] hi", "[low] hi", "hi"], text.strip_tag(F.col("t"))) == ["hi", "hi", "[low] hi", "hi"]
    assert on_texts(spark, ["It's [inaudible] 9, OK", None], text.wer_tokens(F.col("t"))) == [["it's", "9", "ok"], []]
    assert on_texts(spark, ["a b  c d"], text.truncate_words(F.col("t"), 3)) == ["a b c"]
    assert on_texts(spark, ["None", "<name>", " real ", "-", None], text.null_placeholder(F.col("t"))) == [None, None, " real ", None, None]


def test_times(spark):
    assert [str(x) if x else None for x in on_texts(spark, ["2026-01-01 10:00:00 GMT", "bad", None], time.gmt(F.col("t")))] == ["2026-01-01 10:00:00", None, None]
    stamps = on_texts(spark, ["2026-01-01T10:00:00+02:00", "2026-01-01 10:00:00", "10:00"], time.stamp(F.col("t")))
    assert [str(x) if x else None for x in stamps] == ["2026-01-01 10:00:00", "2026-01-01 10:00:00", None]
    start = F.to_timestamp(F.lit("2026-01-01 23:59:00"))
    assert [str(x) for x in on_texts(spark, ["23:59:30", "00:00:10"], time.turn_time(start, F.col("t")))] == ["2026-01-01 23:59:30", "2026-01-02 00:00:10"]
