"""Feeds and file sources on small fixtures."""

import json

import numpy as np
import pytest

from voxlake.sources import feeds, files


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_ais_messages_of_two_types(spark):
    fix = {"MessageType": "PositionReport", "MetaData": {"MMSI": 244, "ShipName": " ALFA ", "time_utc": "2026-01-02 03:04:05.123 +0000 UTC"}, "Message": {"PositionReport": {"Latitude": 52.0, "Longitude": 4.0, "Sog": 1.5}}}
    ship = {"MessageType": "ShipStaticData", "MetaData": {"MMSI": 245}, "Message": {"ShipStaticData": {"Name": "BRAVO", "Type": 70, "ImoNumber": 0, "Dimension": {"A": 10, "B": 20, "C": 0, "D": 0}, "Destination": "NLRTM@@@"}}}
    frames = lines(spark, fix, ship, {"MessageType": "Other", "MetaData": {"MMSI": 1}}, "not json", {"MessageType": "PositionReport", "MetaData": {}})
    got = {r.mmsi: r for r in feeds.ais_messages(frames).collect()}
    assert set(got) == {"244", "245"}
    assert got["244"].name == "ALFA" and got["244"].latitude == 52.0 and got["244"].length is None and str(got["244"].observed_at) == "2026-01-02 03:04:05"
    assert (got["245"].length, got["245"].beam, got["245"].imo, got["245"].destination) == (30.0, None, None, "NLRTM")
    assert feeds.unknown_frames(frames).count() == 3


def test_hub_payload_is_validated_as_a_whole(spark):
    good = [{"ERROR": False, "RECORDS": 2}, [{"MMSI": 1, "NAME": " A ", "TYPE": "x", "A": 1, "B": 2, "TIME": "2026-01-01 00:00:00 GMT"}, {"NAME": "no number"}]]
    rows = feeds.hub_ships(lines(spark, good)).collect()
    assert [(r.mmsi, r.name, r.type, r.length) for r in rows] == [("1", "A", None, 3.0)] and str(rows[0].observed_at) == "2026-01-01 00:00:00"
    assert feeds.hub_ships(lines(spark, [{"ERROR": False}, []])).count() == 0
    for bad in ([{"ERROR": True}], [{"ERROR": False}], {"x": 1}):
        with pytest.raises(Exception, match="hub's answer"):
            feeds.hub_ships(lines(spark, bad)).collect()


def test_aircraft_rows_and_the_current_snapshot(spark, tmp_path):
    day = tmp_path / "day=2026-01-01"
    day.mkdir()
    craft = lambda h, **more: {"hex": h, **more}
    (day / "a.json").write_text("\n".join([
        json.dumps({"t": "2026-01-01T10:00:00", "aircraft": [craft("a", flight=" KLM1 ", alt_baro="1000"), craft("")]}), "{broken",
        json.dumps({"t": "2026-01-01T10:00:15", "aircraft": [craft("b", alt_baro="ground")]}),
    ]))
    log = feeds.snapshot_log(spark, str(tmp_path))
    rows = {r.hex: r for r in feeds.aircraft(log.select("t", "aircraft")).collect()}
    assert set(rows) == {"a", "b"} and (rows["a"].flight, rows["a"].alt_ft, rows["a"].on_ground) == ("KLM1", 1000.0, False) and rows["b"].on_ground
    assert [r.hex for r in feeds.current_aircraft(feeds.aircraft(log.select("t", "aircraft"))).collect()] == ["b"]
    assert feeds.snapshot_log(spark, str(tmp_path), "2026-01-01T10:00:10", "2026-01-01T11:00:00").count() == 1
    with pytest.raises(Exception, match="no list of aircraft"):
        feeds.aircraft(log.selectExpr("t", "if(t IS NULL, aircraft, NULL) AS aircraft")).collect()


def test_last_heartbeat_is_the_newest_readable_one(spark):
    rows = lines(spark, {"type": "heartbeat", "t": "1"}, {"type": "heartbeat", "t": "3"}, {"type": "start", "t": "9"}, "torn {")
    assert feeds.last_heartbeat(rows).collect()[0].t == "3" and feeds.last_heartbeat(rows.limit(0)).count() == 0


def test_capture_index_and_replay(spark, tmp_path):
    path = tmp_path / "index.jsonl"
    row = lambda i, text, t="2026-01-01T10:00:00+02:00": json.dumps({"index": i, "timestamp": t, "channel": "c", "text": text})
    path.write_bytes(("﻿" + "\r\n".join([row(1, "[ALFA/TANKER] hello"), "bad", row(2, "first"), row(2, "second"), row(3, " "), row(4, "x", "no time")])).encode())
    got = {r.clip: r for r in files.capture_index(spark, str(path)).collect()}
    assert set(got) == {"0001", "0002", "0003"} and got["0002"].text == "second" and str(got["0001"].stamp) == "2026-01-01 10:00:00"
    said = files.replay_chunks(files.capture_index(spark, str(path))).orderBy("place").collect()
    assert [(r.clip, r.text) for r in said] == [("0001", "hello"), ("0002", "second")]


def test_labels_references_worksheet_and_results(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    labels = files.labels(spark, write("labels.tsv", "# head\n2026-01-01 10:00:00\t2026-01-01 10:01:00\t244\tnote\n2026-01-01 11:00:00\t2026-01-01 11:01:00\t-\n\n")).orderBy("start").collect()
    assert [(r.mmsi, r.note, r.channel) for r in labels] == [("244", "note", "160,650"), (None, None, "160,650")]
    with pytest.raises(Exception, match="malformed label"):
        files.labels(spark, write("bad.tsv", "only one field")).collect()
    refs = {r.clip: r.reference for r in files.references(spark, write("refs.txt", "0001\tone: two\n0002: b\nneither\n0001\tlast\n")).collect()}
    assert refs == {"0001": "last", "0002": "b"}
    sheet = {r.clip: r.fields for r in files.worksheet(spark, write("sheet.txt", "head\n--- 0001 ---\nHEARD: a\nHEARD: b\nFLIGHT: KLM1\n--- 0002 ---\nHEARD:\n")).collect()}
    assert sheet == {"0001": {"HEARD": "b", "FLIGHT": "KLM1"}, "0002": {"HEARD": ""}}
    body = json.dumps({"results": {"x": [{"clip_id": "1", "text": "a"}, {"clip_id": "1", "text": "b"}], "y": [{"clip_id": "1", "error": "e"}]}})
    assert sorted((r.config, r.text, r.error) for r in files.results(spark, write("r.json", body)).collect()) == [("x", "b", None), ("y", None, "e")]


def test_cut_list_round_trip(spark, tmp_path):
    files.write_cut_list(spark.createDataFrame([(0.5, 1.25), (2.0, 3.0004)], "start_s double, end_s double"), str(tmp_path / "cuts"))
    assert sorted(map(tuple, files.cut_list(spark, str(tmp_path / "cuts")).collect())) == [(0.5, 1.25), (2.0, 3.0)]


def test_dump_times_and_batch_settings(spark):
    names = lines(spark, "gpucore-20260101-101112.dmp", "gpucore-20260101-101112.dmp", "gpucore-20260301-000000.dmp", "other")
    assert [str(r.t) for r in files.dump_times(names, "value", "2026-01-01", "2026-02-01").collect()] == ["2026-01-01 10:11:12"]
    got = files.batch_settings(lines(spark, "set MODEL=large", 'SET "PORT=1"', "set OTHER=2", "rem"), ["MODEL", "PORT"]).collect()
    assert sorted(map(tuple, got)) == [("MODEL", "large"), ("PORT", "1")]


def test_baseband_blocks_and_wavs(spark, tmp_path):
    frames = np.arange(20, dtype="<i2")  # ten frames of two channels
    body = frames.tobytes() + b"\0\0\0"  # and a torn one
    head = b"RIFF" + b"\0\0\0\0" + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\2\0" + (48000).to_bytes(4, "little") + (192000).to_bytes(4, "little") + b"\4\0\x10\0"
    (tmp_path / "x_145500000Hz.wav").write_bytes(head + b"data" + len(body).to_bytes(4, "little") + body)
    rows = files.baseband_blocks(spark, str(tmp_path), 4).orderBy("block").collect()
    assert [len(r.re) for r in rows] == [4, 4, 2] and rows[0].centre_hz == 145500000 and rows[0].rate == 48000
    assert np.allclose(np.concatenate([r.im for r in rows]) * 32768, np.arange(1, 20, 2))
    clips = spark.createDataFrame([("a.wav", [0.0, 1.0, -2.0]), ("b.wav", [])], "name string, samples array<double>")
    for _ in range(2):
        files.write_wavs(clips, "name", "samples", 8000, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]
    wavs = {n: (tmp_path / "out" / f"{n}.wav").read_bytes() for n in "ab"}
    assert np.frombuffer(wavs["a"][44:], "<i2").tolist() == [0, 32767, -32768] and len(wavs["b"]) == 44 + 2 * 160


def test_a_recording_over_four_gigabytes_is_planned_from_its_header(spark, tmp_path):
    """A sparse RF64 file of 5 GB: the tail's block is read without what lies before it."""
    frames, number = 5 * 2**30 // 4, lambda n, k=4: n.to_bytes(k, "little")
    head = b"RF64\xff\xff\xff\xffWAVEds64" + number(28) + number(4 * frames + 72, 8) + number(4 * frames, 8) + number(frames, 8) + number(0)
    head += b"fmt " + number(16) + b"\1\0\2\0" + number(2_400_000) + number(9_600_000) + b"\4\0\x10\0data\xff\xff\xff\xff"
    with open(tmp_path / "big.wav", "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * frames)
        f.seek(len(head) + 4 * (frames - 1))
        f.write(b"\0\x40\0\xc0")
    reader = files.BasebandReader({"path": str(tmp_path / "big.wav"), "block_frames": "65536", "task_blocks": "64"})
    parts = reader.partitions()
    assert len(parts) == frames // 65536 // 64 and parts[-1].last == frames // 65536
    last = next(reader.read(files.BlockRange(**{**vars(parts[-1]), "first": parts[-1].last - 1})))
    assert last.column("re")[0][-1].as_py() == 0.5 and last.column("im")[0][-1].as_py() == -0.5
