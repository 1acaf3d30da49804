"""Versioned tables, the registry as a stream of versions against a plain loop, the rolling store and the second look's sink."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxlake import schemas, store
from voxlake.streaming import registry

STATIC, POSITION = registry.STATIC, registry.POSITION
T0 = datetime(2026, 1, 1)


def test_versions_are_whole_and_the_newest_counts(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == []
    table.publish(spark.range(3), 0)
    table.publish(spark.range(5), 2)
    spark.range(9).write.parquet(str(tmp_path / "t/versions/3"))  # a writer that failed before the manifest
    assert table.read().count() == 5 and table.read(before=2).count() == 3 and table.read(before=0) is None
    table.publish(spark.range(4), 2)
    assert table.versions() == [0, 2] and table.read().count() == 4


def observation(r, n):
    row = dict.fromkeys([c.split()[0] for c in schemas.OBSERVATION.split(", ")])
    row |= {"arrival": n, "mmsi": r.choice(["1", "2", "3", "4", "5", " 6 ", "7", "", None]), "observed_at": T0 + timedelta(minutes=r.randint(0, 500))}
    if r.random() < 0.3:
        row["name"] = r.choice(["Alfa", "BRAVO", " ", "Charlie", "alfa"])
    if r.random() < 0.4:
        row |= {"callsign": r.choice(["PA1", "PB2", ""]), "length": r.choice([None, 10.0, 20.0])}
    if r.random() < 0.5:
        row |= {"latitude": r.random(), "longitude": r.choice([None, r.random()]), "sog": r.random()}
    return row


def plain(entries, batches, most):
    """The registry's rules one observation at a time; the waiting room is cut after each batch."""
    numbered = {e["mmsi"]: dict(e) for e in entries if e["mmsi"]}
    nameless = {e["name"].upper(): dict(e) for e in entries if not e["mmsi"]}
    for rows in batches:
        for o in sorted(rows, key=lambda o: o["arrival"]):
            mmsi, name = (o["mmsi"] or "").strip(), (o["name"] or "").strip()
            if not mmsi:
                continue
            e = numbered.get(mmsi)
            if name and not (e and e["name"]) and name.upper() in nameless:
                adopted = nameless.pop(name.upper()) | {"mmsi": mmsi}
                for c in STATIC:
                    if e and e[c] not in (None, ""):
                        adopted[c] = e[c]
                if e and e["position_at"] and (not adopted["position_at"] or e["position_at"] >= adopted["position_at"]):
                    adopted |= {c: e[c] for c in (*POSITION, "position_at")}
                if e:
                    adopted["last_seen"] = max(x for x in (e["last_seen"], adopted["last_seen"], datetime(1970, 1, 1)) if x)
                e = adopted
            e = e or dict.fromkeys((*STATIC, *POSITION, "position_at", "last_seen", "touched")) | {"mmsi": mmsi}
            for c in STATIC:
                if o[c] is not None and str(o[c]).strip():
                    e[c] = o[c]
            when = o["observed_at"]
            if o["latitude"] is not None and o["longitude"] is not None and (not e["position_at"] or when >= e["position_at"]):
                e |= {c: o[c] for c in POSITION} | {"position_at": when}
            e["last_seen"], e["touched"] = max(when, e["last_seen"] or when), when
            numbered[mmsi] = e
        waiting = sorted((e for e in numbered.values() if not e["name"]), key=lambda e: (e["touched"], e["mmsi"]), reverse=True)
        for e in waiting[most:]:
            del numbered[e["mmsi"]]
    return [*numbered.values(), *nameless.values()]


def as_rows(entries):
    columns = ("mmsi", *STATIC, *POSITION, "position_at", "last_seen")
    return sorted((tuple(e[c] for c in columns) for e in entries), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_registry_versions_equal_a_plain_loop(spark, tmp_path, seed):
    r, n, batches = random.Random(seed), 0, []
    for size in (6, 25, 20):
        batches.append([observation(r, n + i) for i in range(size)])
        n += size
    none = dict.fromkeys((*STATIC, *POSITION, "position_at", "last_seen", "touched"))
    saved = [none | {"mmsi": None, "name": "ALFA", "callsign": "OLD", "latitude": 1.0, "longitude": 2.0, "position_at": T0 + timedelta(minutes=250), "last_seen": T0},
             none | {"mmsi": None, "name": "DELTA", "callsign": "DD"}, none | {"mmsi": "9", "name": "ECHO"}]
    path = str(tmp_path / "registry")
    columns = [c.split()[0] for c in registry.ENTRY.split(", ")]
    registry.load_registry(path, spark.createDataFrame([tuple(e[c] for c in columns) for e in saved], registry.ENTRY))
    write = registry.registry_sink(path, 2)
    names = [c.split()[0] for c in schemas.OBSERVATION.split(", ")]
    frames = [spark.createDataFrame([tuple(o[c] for c in names) for o in rows], schemas.OBSERVATION) for rows in batches]
    for number, frame in enumerate(frames):
        write(frame, number)
        if number == 1:
            write(frame, number)  # run again after a restart
    got = [row.asDict() for row in store.VersionedTable(spark, path).read().collect()]
    assert as_rows(got) == as_rows(plain(saved, batches, 2))


def test_of_two_numbers_of_one_name_the_first_adopts(spark):
    none = dict.fromkeys((*STATIC, *POSITION, "position_at", "last_seen", "touched"))
    columns = [c.split()[0] for c in registry.ENTRY.split(", ")]
    held = spark.createDataFrame([tuple((none | {"mmsi": None, "name": "ALFA", "callsign": "OLD"})[c] for c in columns)], registry.ENTRY)
    seen = spark.createDataFrame([(2, "20", "alfa"), (1, "10", "Alfa "), (3, "20", "Bravo")], "arrival long, mmsi string, name string")
    for c in schemas.OBSERVATION.split(", ")[3:]:
        seen = seen.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    got = {e.mmsi: (e.name, e.callsign) for e in registry.next_entries(held, seen).collect()}
    assert got == {"10": ("Alfa ", "OLD"), "20": ("Bravo", None)}


def test_rolling_store_keeps_the_newest_and_archives_each_once(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(f"c{i}", i) for i in ids], "id string, start long")
    write = store.rolling_store_sink(str(tmp_path / "s"), str(tmp_path / "a"), "id", "start", 5)
    store.VersionedTable(spark, str(tmp_path / "s")).publish(rows(range(4)), 0)  # what was loaded at the start
    for number, ids in enumerate([range(2, 8), range(6, 9)]):
        write(rows(ids), number)
        write(rows(ids), number)
    assert sorted(r.start for r in store.VersionedTable(spark, str(tmp_path / "s")).read().collect()) == [4, 5, 6, 7, 8]
    assert sorted(r.start for r in spark.read.parquet(str(tmp_path / "a")).collect()) == list(range(9))


def test_union_of_two_indexes(spark):
    rows = lambda *r: spark.createDataFrame(r, "mmsi string, name string, seen long")
    got = store.merged_indexes(rows(("1", "A", 5), ("2", "B", 1), (None, "N", 1)), rows(("1", "A2", 7), ("2", "B", 1), (None, "N", 1), (None, "M", 1)), "mmsi", "seen")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows(("1", "A2", 7), ("2", "B", 1), (None, "N", 1), (None, "M", 1)).collect()))


def test_waiting_room_keeps_those_touched_last(spark):
    from voxlake.operators.registry import pending

    seen = spark.createDataFrame([("a", None, 1), ("b", " ", 2), ("c", None, 3), ("a", "", 9), ("d", "D", 10), ("d", None, 11)], "mmsi string, name string, arrival long")
    assert [tuple(r) for r in pending(seen, "mmsi", "name", "arrival", 2).collect()] == [("a", 9), ("c", 3)]
