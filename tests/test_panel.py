"""Small projections that no query's SQL shows, against plain values."""

from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxlake.functions import display, geo
from voxlake.functions import time as T
from voxlake.operators import conversations
from voxlake.plans import records


def test_conversation_list_agrees_with_a_plain_loop(spark, sf_dir):
    readings = {r.code: r.reading for r in geo.ship_types(spark).collect()}
    want = defaultdict(lambda: [0, None, None])
    for o in records._table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").collect():
        k, vessel, mmsi = o.o_orderkey, f"SHIP {o.o_custkey}" if o.o_orderkey % 3 else None, str(o.o_custkey) if o.o_orderkey % 2 == 0 else None
        label = f"{vessel} ({mmsi})" if vessel and mmsi else vessel or mmsi or "unidentified"
        code = k % 100
        detail = f"{readings[code]} (AIS type {code})" if code in readings and readings[code] is not None else f"Unknown AIS ship type code {code}"
        known = bool(vessel or mmsi)
        row = want[f"c{k % 4}", known, not known, 2, 1 if k % 2 == 0 else 0]
        row[0] += 1
        row[1], row[2] = min(x for x in (row[1], label) if x), max(x for x in (row[2], detail) if x)
    got = {(r.channel, r.identified, r.bare, r.turn_count, r.candidate_count): [r.n, r.label, r.detail] for r in records.q_conversation_list(spark, sf_dir).collect()}
    assert got == dict(want)


def test_candidates_are_cut_to_what_is_shown(spark):
    kind = "array<struct<name:string,mmsi:string,via_callsign:boolean,via_live_match:boolean,via_partial_callsign:boolean,latitude:double,longitude:double,draught:double,destination:string,last_seen:string,score:double>>"
    rows = spark.createDataFrame([([("A", "1", True, None, False, 1.0, 2.0, None, "RTM", "t", 9.0)],), ([],), (None,)], f"c {kind}")
    got = [r.c for r in rows.select(display.compact_candidates(F.col("c")).alias("c")).collect()]
    assert got[0][0].asDict() == {"name": "A", "mmsi": "1", "via_callsign": True, "via_live_match": False, "via_partial_callsign": False, "latitude": 1.0, "longitude": 2.0, "draught": None, "destination": "RTM", "last_seen": "t"}
    assert got[1:] == [[], None]


def test_first_outcomes_know_the_call_sign_alone(spark):
    said = spark.createDataFrame([(1, "klm one two three descend"), (2, "delta seven three climb"), (3, "good day")], "id long, text string")
    aircraft = spark.createDataFrame([("KLM123", "abc", "B738", "PH-X")], "flight string, hex string, type string, reg string")
    got = {r.id: (r.hex, r.outcome.kind, r.outcome.badge) for r in conversations.first_outcomes(said, aircraft).collect()}
    assert got == {1: ("abc", "flight", "callsign"), 2: (None, "unknown", "unknown"), 3: (None, "unassigned", "none")}


def test_ranges():
    now = datetime(2026, 1, 1, 12)
    assert T.parse_range(None, None, now) == (datetime(2026, 1, 1, 11, 45), now, True)
    assert T.parse_range("2026-01-01T10:00:00", None, now) == (datetime(2026, 1, 1, 10), now, False)
    assert T.parse_range(None, "2026-01-01T11:30:00", now) == (datetime(2026, 1, 1, 11), datetime(2026, 1, 1, 11, 30), False)
    with pytest.raises(ValueError):
        T.parse_range("2026-01-02", "2026-01-01", now)
