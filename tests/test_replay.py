"""Replays against plain loops."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voxlake.operators import replay

T0 = datetime(2026, 1, 1)
OBS = "arrival long, mmsi string, observed_at timestamp, name string, callsign string, type int, destination string, latitude double, longitude double"


def test_registry_as_of_equals_a_plain_loop(spark):
    r = random.Random(1)
    obs = [(i, r.choice(["1", "2", "3", None]), T0 + timedelta(minutes=r.randint(0, 30)) if r.random() < 0.95 else None, r.choice([None, " ", "A", "B"]), r.choice([None, "PA1"]), r.choice([None, 70]), None,
            r.choice([None, 52.0 + i]), r.choice([None, 4.0])) for i in range(120)]
    asked = [(i, r.choice(["1", "2", "3", "9"]), T0 + timedelta(minutes=r.randint(-2, 33))) for i in range(40)]
    got = {x.label: x for x in replay.registry_as_of(spark.createDataFrame(obs, OBS), spark.createDataFrame(asked, "label long, mmsi string, reference_at timestamp")).collect()}
    assert set(got) == {a[0] for a in asked}
    for label, mmsi, at in asked:
        own = sorted((o for o in obs if o[1] == mmsi and o[2] is not None and o[2] <= at), key=lambda o: (o[2], o[0]))
        last = lambda i: next((o[i] for o in reversed(own) if o[i] is not None and str(o[i]).strip()), None)  # noqa: E731,B023
        fix = next(((o[7], o[8], o[2]) for o in reversed(own) if o[7] is not None and o[8] is not None), (None, None, None))
        x = got[label]
        assert (x.name, x.callsign, x.type) == (last(3), last(4), last(5)) and (x.latitude, x.longitude, x.position_at) == fix
        assert x.last_seen == (own[-1][2] if own else None)


def window(label, start, *chunks):
    return [(label, start, i + 1, T0.timestamp() + i, text, live) for i, (text, live) in enumerate(chunks)]


def test_candidates_stand_as_of_the_label(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    none = (None, None, None, None)
    obs = [(1, "1", at(0), "ALFA", "PAAB", *none), (2, "2", at(0), "BRAVO", "PCDE", *none), (3, "1", at(50), "ALFA", "PXYZ", *none), (4, "3", at(90), "LATER", "PQRS", *none)]
    rows = window(10, at(10), ("papa alfa alfa bravo calling", None), ("good day", "2")) + window(20, at(100), ("papa alfa alfa bravo again", "2"), ("papa quebec romeo sierra", None))
    windows = spark.createDataFrame(rows, "label long, reference_at timestamp, place int, at double, text string, live_mmsi string")
    arms = {"all": replay.Arm(), "fresh": replay.Arm(max_age_min=30), "heard": replay.Arm(live=False)}
    offered = replay.replay_candidates(windows, spark.createDataFrame(obs, OBS), arms)
    got = {(x.arm, x.label, x.mmsi): x.source for x in offered.collect()}
    # At 100 minutes the first ship bore another call sign, and only the third was heard of within half an hour.
    assert got == {
        ("all", 10, "1"): "spoken_callsign", ("all", 10, "2"): "live_match", ("all", 20, "2"): "live_match", ("all", 20, "3"): "spoken_callsign",
        ("fresh", 10, "1"): "spoken_callsign", ("fresh", 10, "2"): "live_match", ("fresh", 20, "3"): "spoken_callsign", ("heard", 10, "1"): "spoken_callsign", ("heard", 20, "3"): "spoken_callsign",
    }
    reply = lambda *e: json.dumps({"exchanges": [{"chunk_ids": ids, "vessel": v} for ids, v in e]})
    replies = spark.createDataFrame([("all", 10, reply(([1], "Alfa"), ([2], "Bravo"))), ("heard", 10, reply(([1, 2], "Bravo"))), ("fresh", 20, "{broken")], "arm string, label long, reply string")
    exchanges = replay.resolved_again(windows, offered, replies)
    found = {(x.window, x.exchange): (x.vessel, len(x.turns), x.failed) for x in exchanges.collect()}
    assert found["all|10", 0][:2] == ("ALFA", 1) and found["all|10", 1][:2] == ("BRAVO", 1)
    assert found["heard|10", 0][0] is None  # nobody offered that name in this arm
    assert any(k[0] == "fresh|20" and v[1:] == (2, True) for k, v in found.items())


def test_chunks_under_filters(spark):
    prompt = "Maas Approach, Rotterdam pilot, Europoort traffic, Botlek, Waalhaven"
    chunks = spark.createDataFrame([("1", T0, "c", "ALFA here"), ("2", T0, "c", prompt), ("3", T0, "c", "who is that")], "id string, time timestamp, channel string, text string")
    made = [("1", True, "alfa", None), ("1", False, "alfa", None), ("2", True, "BOTLEK", None), ("2", False, "BOTLEK", None), ("3", True, None, None), ("3", False, "bravo", None)]
    ships = spark.createDataFrame([("11", "ALFA", "PA"), ("22", "BRAVO", "PB")], "mmsi string, name string, callsign string")
    extracted = spark.createDataFrame(made, "id string, hints boolean, vessel string, callsign string")
    rows = replay.replayed_chunks(chunks, extracted, ships, F.lit(prompt), {"off": (False, False), "on": (True, True)})
    got = {(x.arm, x.id): (x.echo, x.vessel, x.mmsi) for x in rows.collect()}
    assert got["off", "1"] == got["on", "1"] == (False, "ALFA", "11")
    assert got["off", "2"] == (False, "BOTLEK", None) and got["on", "2"] == (True, None, None)
    assert got["off", "3"] == (False, "BRAVO", "22") and got["on", "3"] == (False, None, None)
    assert {(x.id, x.change) for x in replay.replay_changes(rows, "off", "on").collect()} == {("2", "dropped"), ("3", "dropped")}
    assert {x.display for x in rows.filter("echo").collect()} == {""}
