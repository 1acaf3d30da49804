"""Structured Streaming forms, each run to the end of a small folder of files."""

import json
import os

from voxlake import schemas
from voxlake.streaming import pipelines, registry


def stream(spark, path, schema, *batches):
    """One file, and so one micro-batch, per list of rows."""
    path.mkdir()
    for i, rows in enumerate(batches):
        (path / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def run(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_registry_merges_fields_and_keeps_the_newest_position(spark, tmp_path):
    seen = lambda n, t, **more: {"arrival": n, "mmsi": "1", "observed_at": t, **more}
    rows = stream(
        spark, tmp_path / "in", schemas.OBSERVATION,
        [seen(1, "2026-01-01T10:00:00", latitude=52.0, longitude=4.0, sog=1.0)],
        [seen(2, "2026-01-01T10:05:00", name="ALFA", type=70), seen(3, "2026-01-01T09:00:00", latitude=51.0, longitude=3.0, callsign="PA1")],
        [seen(4, "2026-01-01T10:10:00", latitude=53.0, longitude=5.0, name=" ")],
    )
    got = run(spark, registry.vessels(rows), "vessels", tmp_path, "update")
    assert [(r.name, r.callsign, r.latitude, r.sog) for r in got] == [("ALFA", "PA1", 52.0, 1.0), ("ALFA", "PA1", 53.0, None)]


def test_quiet_sessions_close_after_the_gap(spark, tmp_path):
    chunk = lambda i, t, channel="a": {"id": i, "time": f"2026-01-01T{t}", "channel": channel}
    rows = stream(
        spark, tmp_path / "in", schemas.CHUNK, [chunk(1, "10:00:00"), chunk(2, "10:00:50"), chunk(3, "10:03:00"), chunk(4, "10:00:30", "b")], [chunk(5, "12:00:00")], [chunk(6, "14:00:00")],
    )
    got = sorted((r.channel, r.n, r.first_id, r.last_id) for r in run(spark, pipelines.quiet_sessions(rows), "sessions", tmp_path))
    assert got == [("a", 1, 3, 3), ("a", 1, 5, 5), ("a", 2, 1, 2), ("b", 1, 4, 4)]


def test_hourly_counts(spark, tmp_path):
    seen = lambda t, m: {"t": f"2026-01-01T{t}", "mmsi": m}
    rows = stream(spark, tmp_path / "in", "t string, mmsi string", [seen("10:00:00", "1"), seen("10:59:59", "1"), seen("11:00:00", "2")], [seen("18:00:00", "3")], [seen("23:00:00", "3")])
    got = {r.hour.hour: (r.messages, r.vessels) for r in run(spark, pipelines.hourly_counts(rows), "hours", tmp_path)}
    assert got[10] == (2, 1) and got[11] == (1, 1)


def test_late_enrichment_emits_every_transmission_once(spark, tmp_path):
    said = stream(spark, tmp_path / "said", "id long, t string", [{"id": 1, "t": "2026-01-01T10:00:00"}, {"id": 2, "t": "2026-01-01T10:30:00"}], [{"id": 3, "t": "2026-01-01T12:00:00"}], [{"id": 4, "t": "2026-01-01T13:00:00"}])
    seen = stream(spark, tmp_path / "seen", "snap_t string, hex string", [{"snap_t": "2026-01-01T10:00:30", "hex": "a"}], [{"snap_t": "2026-01-01T12:05:00", "hex": "b"}], [{"snap_t": "2026-01-01T13:05:00", "hex": "c"}])
    got = {(r.id, r.hex) for r in run(spark, pipelines.late_enrichment(said, seen), "enriched", tmp_path)}
    assert {(1, "a"), (2, None)} <= got and (1, None) not in got


def test_archive_sink_appends_only_what_is_new(spark, tmp_path):
    write = pipelines.archive_sink(str(tmp_path / "archive"), "id", "place")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, place int, v string")
    write(batch(("a", 1, "first"), ("a", 2, "second"), ("b", 3, "b")), 0)
    write(batch(("a", 1, "first"), ("a", 2, "second"), ("b", 3, "b")), 0)
    write(batch(("a", 4, "late"), ("c", 5, "c")), 1)
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "archive")).collect()) == [("a", "first"), ("b", "b"), ("c", "c")]


def test_snapshot_log_lies_in_day_folders(spark, tmp_path):
    rows = stream(spark, tmp_path / "in", schemas.SNAPSHOT, [{"t": "2026-01-01T10:00:00", "aircraft": [{"hex": "a"}]}, {"t": "2026-01-02T10:00:00", "aircraft": []}])
    pipelines.snapshot_log(rows, str(tmp_path / "log"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(p.name for p in (tmp_path / "log").glob("day=*")) == ["day=2026-01-01", "day=2026-01-02"]
