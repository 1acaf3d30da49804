"""Lines of growing files and the order of lines over files."""

import json
import random

import pytest

from voxlake.sources import files, logs


def test_the_last_line_counts_over_files_of_any_size(spark, tmp_path):
    """A small early file and a large late one: Spark packs the larger one first."""
    folder = tmp_path / "index"
    folder.mkdir()
    row = lambda i, text: json.dumps({"index": i, "timestamp": "2026-01-01T10:00:00", "channel": "c", "text": text})
    (folder / "a.jsonl").write_text("﻿" + row(1, "old") + "\r\n" + row(2, "only a") + "\r\n")
    (folder / "b.jsonl").write_text("".join(row(1000 + i, "x" * 50) + "\n" for i in range(400)) + row(1, "new") + "\n")
    (folder / "c.jsonl").write_text(row(3, "first") + "\n" + row(3, "second"))
    for size in ("64", "4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r.clip: r.text for r in files.capture_index(spark, str(folder)).collect()}
        assert (got["0001"], got["0002"], got["0003"], len(got)) == ("new", "only a", "second", 403)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (folder / "a.jsonl").unlink()
    refs = tmp_path / "refs"
    refs.mkdir()
    (refs / "1.txt").write_text("0001\told\n# 0001\tcomment\n")
    (refs / "2.txt").write_text("0002: x\n" * 500 + "0001\tnew\n")
    assert {r.clip: r.reference for r in files.references(spark, str(refs)).collect()} == {"0001": "new", "0002": "x"}


@pytest.mark.parametrize("seed", range(4))
def test_ranges_cut_anywhere_give_each_line_once(tmp_path, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(logs, "LOOK", r.choice([1, 3, 64]))
    lines = ["".join(r.choice("abä\t") for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(30)]
    path = tmp_path / "x.log"
    path.write_bytes("".join(x + r.choice(["\n", "\r\n"]) for x in lines).encode())
    size = path.stat().st_size
    for width in (1, 2, 7, 1000):
        got = []
        for at in range(0, size, width):
            for batch in logs._read(str(path), logs.ByteRange(str(path), 0, at, min(size, at + width), size, False)):
                got += zip(batch.column("offset").to_pylist(), batch.column("line").to_pylist(), strict=True)
        assert [line for _, line in sorted(got)] == lines and len({o for o, _ in got}) == len(lines)


def test_a_tail_is_bounded_and_restarts_when_the_file_shrinks(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"\xef\xbb\xbfone\r\ntwo\nthr\xffee\nfour")
    read = lambda **o: [(r.offset, r.line, r.restarted) for r in logs.tail(spark, str(path), **o).orderBy("offset").collect()]
    assert read() == [(0, "one", False), (8, "two", False), (12, "thr�ee", False), (19, "four", False)]
    assert read(offset=8, limit=4) == [(8, "two", False)]
    assert read(limit=6) == [(17, "e", False), (19, "four", False)]
    assert read(offset=23) == [] and read(offset=99)[0] == (0, "one", True)
    path.unlink()
    assert read() == []


def step(spark, folder, tmp_path, got):
    """One run of the stream from its checkpoint."""
    def keep(batch, _):
        got.extend((r.file.rsplit("/", 1)[-1], r.offset, r.line, r.restarted) for r in batch.collect())

    logs.follow(spark, str(folder)).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()


def test_a_growing_file_is_followed_line_by_line(spark, tmp_path):
    folder, got = tmp_path / "logs", []
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\r\ntwo\npart")
    step(spark, folder, tmp_path, got)
    assert sorted(got) == [("a.log", 0, "one", False), ("a.log", 5, "two", False)]  # the last line isn't whole
    got.clear()
    with open(folder / "a.log", "ab") as f:
        f.write(b"ly\nthree\nrest")
    (folder / "b.log").write_bytes(b"other\n")
    step(spark, folder, tmp_path, got)
    assert sorted(got) == [("a.log", 9, "partly", False), ("a.log", 16, "three", False), ("b.log", 0, "other", False)]
    got.clear()
    step(spark, folder, tmp_path, got)
    assert got == []
    (folder / "a.log").write_bytes(b"anew\n")  # rotated: shorter than what was read
    step(spark, folder, tmp_path, got)
    assert got == [("a.log", 0, "anew", True)]
