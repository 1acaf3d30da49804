"""State with timers, each stream against a plain loop, with restarts from the checkpoint."""

import json
import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxlake.operators import station
from voxlake.streaming import stateful


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    stateful.use_rocksdb(spark)
    yield
    spark.conf.unset(key)


def add(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:03}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{number:03}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def start(df, tmp_path, out, **trigger):
    writer = df.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-checkpoint"))
    return writer.outputMode("append").trigger(**trigger).start()


def test_rolling_counts_equal_those_of_the_whole_log(spark, rocksdb, tmp_path):
    r = random.Random(3)
    log = [[{"mmsi": r.choice("abcdef"), "hour": max(0, 20 * b + r.randint(-15, 12))} for _ in range(25)] for b in range(4)]
    for b, rows in enumerate(log):  # each batch is a query of its own: a restart
        add(tmp_path / "in", b, rows)
        start(stateful.rolling_steps(source(spark, tmp_path / "in", "mmsi string, hour long"), (5, 24), 1000), tmp_path, "steps", once=True).awaitTermination()
    steps = spark.read.parquet(str(tmp_path / "steps"))
    got = {(x.width, x.hour): x.vessels for x in stateful.rolling_counts(steps).collect()}
    seen = [(x["mmsi"], x["hour"]) for rows in log for x in rows]
    for width in (5, 24):
        at, want = 0, {}
        for hour in range(0, 120):
            want[hour] = len({m for m, h in seen if hour - width < h <= hour})
            at = got.get((width, hour), at)
            assert at == want[hour], (width, hour)
        whole = station.rolling_distinct(spark.createDataFrame(seen, "mmsi string, hour long"), "hour", "mmsi", width)
        assert {x.hour: x.distinct_keys for x in whole.collect()} == {h: want[h] for h in {h for _, h in seen}}


def test_hours_older_than_the_retention_are_left_out(spark, rocksdb, tmp_path):
    add(tmp_path / "in", 0, [{"mmsi": "a", "hour": 500}])
    add(tmp_path / "in", 1, [{"mmsi": "a", "hour": 500 - 217}, {"mmsi": "a", "hour": 500 - 216}, {"mmsi": "b", "hour": 1}])
    for _ in range(2):
        start(stateful.rolling_steps(source(spark, tmp_path / "in", "mmsi string, hour long"), (24,)), tmp_path, "steps", once=True).awaitTermination()
    assert sorted((x.hour, x.step) for x in spark.read.parquet(str(tmp_path / "steps")).collect()) == [(1, 1), (25, -1), (284, 1), (308, -1), (500, 1), (524, -1)]


def n_beats(spark, folder):
    try:
        return spark.read.parquet(str(folder)).count()
    except Exception:  # nothing there yet
        return 0


def test_a_station_beats_without_messages(spark, rocksdb, tmp_path):
    add(tmp_path / "in", 0, [{"station": "s"}] * 3 + [{"station": "t"}])
    beats = stateful.heartbeats(source(spark, tmp_path / "in", "station string"), 0.5, 3)
    for n in (1, 2):
        query = start(beats, tmp_path, "beats", processingTime="200 milliseconds")
        deadline = time.time() + 40
        while time.time() < deadline and query.isActive and n_beats(spark, tmp_path / "beats") < 12 * n:
            time.sleep(0.5)
        query.stop()
        if n == 1:
            add(tmp_path / "in", 1, [{"station": "s"}] * 2)
    found = defaultdict(list)
    for x in spark.read.parquet(str(tmp_path / "beats")).orderBy("at").collect():
        found[x.station].append((x.at.timestamp(), x.messages, x.since_last, x.silence))
    assert set(found) == {"s", "t"}
    for rows in found.values():
        gaps = {round(b[0] - a[0], 3) for a, b in zip(rows, rows[1:])}
        assert gaps == {0.5}  # also over the restart: every period has its beat, once
        silent = 0
        for _, _, since, silence in rows:
            silent = 0 if since else silent + 1
            assert silence == (silent > 0 and silent % 3 == 0)
        assert sum(x[2] for x in rows) == rows[-1][1] and any(x[3] for x in rows)
    assert found["t"][-1][1] == 1 and found["s"][0][1] == 3


def test_each_transmission_falls_due_once(spark, rocksdb, tmp_path):
    said = lambda i, t, text="x": {"id": i, "t": f"2026-01-01T{t}", "text": text, "numbers": [i]}
    batches = [[said(1, "10:00:00"), said(2, "10:00:50", "two")], [said(1, "10:00:00", "again"), said(3, "10:01:20")], [said(4, "10:02:30")], [said(5, "11:00:00")], []]
    got = []
    for b, rows in enumerate(batches):
        if rows:
            add(tmp_path / "in", b, rows)
        rows = source(spark, tmp_path / "in", "id long, t string, text string, numbers array<long>")
        start(stateful.due_transmissions(rows), tmp_path, "due", availableNow=True).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "due")).collect() if any((tmp_path / "due").glob("*.parquet")) else []
        got.append(sorted((x.id, x.text, x.numbers[0]) for x in found))
    assert got[-1] == [(1, "x", 1), (2, "two", 2), (3, "x", 3), (4, "x", 4)]
    assert got[0] == []
