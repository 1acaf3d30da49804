"""Lines with their place: of files at rest, in an order that no split changes (S19, S20, S23), and of growing files as a stream or a bounded tail (S34, S10's framing)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a tail that is asked for without a limit, and the most it may have.
TAIL, MOST_TAIL = 65_536, 262_144
#: Bytes that a task reads of a growing file, and that are looked through at once for the end of a line.
RANGE, LOOK = 16 << 20, 1 << 16
_SCHEMA = "file string, offset long, line string, restarted boolean"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (without a byte order mark or carriage return) and place: files by path, then their splits, then lines. A split's lines are read in order by one task, so the
    order stands whatever Spark packs into a task."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF|\\r$", "").alias("value"), place.alias("place"))


def tail(spark: SparkSession, path: str, offset: int | None = None, limit: int = TAIL) -> DataFrame:
    """File, offset, line, restarted of a bounded part of a file: from an offset, or the end of the file. A file that has become shorter than the offset is read from
    its start; one that isn't there has no lines. The last line may be a part of one."""
    spark.dataSource.register(GrowingLog)
    options = {"path": path, "limit": str(max(1, min(limit, MOST_TAIL)))} | ({} if offset is None else {"offset": str(offset)})
    return spark.read.format("voxlake_log").options(**options).load()


def follow(spark: SparkSession, path: str) -> DataFrame:
    """S34 as a stream: whole lines of a file, or of the files in a folder, as they are appended; a line comes when it ends. A file that has become shorter starts anew."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("voxlake_log").option("path", path).load()


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that begin in [first, last); what is read begins at start and ends at end."""

    file: str
    start: int
    first: int
    last: int
    end: int
    restarted: bool


class GrowingLog(DataSource):
    """Text files that Arrow's file systems open (local paths and URIs)."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_log"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FollowReader(self.options["path"])


def _sizes(path: str) -> tuple[fs.FileSystem, dict[str, int]]:
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return system, {}
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))]
    return system, {f.path: f.size for f in found}


def _read(path: str, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
    """A line belongs to the range in which it begins; the part's own start is a line's beginning, or as good as one. Without any file there is no range."""
    if part is None:
        return
    system, _ = fs.FileSystem.from_uri(path)
    with system.open_input_file(part.file) as f:
        at = part.first
        if at > part.start:
            f.seek(at - 1)
            at += _to_line_end(f, at - 1, part.end) - 1
        f.seek(at)
        rest, lines, places = b"", [], []
        while at < part.last or rest:
            chunk = f.read(min(LOOK, part.end - at - len(rest)))
            held = rest + chunk
            *whole, rest = held.split(b"\n")
            if not chunk and rest:
                whole, rest = [rest], b""
            for line in whole:
                if at >= part.last:
                    rest = b""
                    break
                text = line.removesuffix(b"\r")
                lines.append((text[3:] if at == 0 and text[:3] == b"\xef\xbb\xbf" else text).decode("utf-8", "replace"))
                places.append(at)
                at += len(line) + 1
            else:
                if chunk:
                    continue
            break
    names, n = ["file", "offset", "line", "restarted"], len(lines)
    yield pa.RecordBatch.from_arrays([pa.array([part.file] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string()), pa.array([part.restarted] * n, pa.bool_())], names=names)


def _to_line_end(f, at: int, end: int) -> int:
    """Bytes from a place up to and with the next line's end, or the file's."""
    f.seek(at)
    seen = 0
    while at + seen < end and (chunk := f.read(min(LOOK, end - at - seen))):
        found = chunk.find(b"\n")
        if found >= 0:
            return seen + found + 1
        seen += len(chunk)
    return end - at + 1


class TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"], int(options.get("limit", TAIL))
        self.offset = int(options["offset"]) if "offset" in options else None

    def partitions(self) -> list[ByteRange]:
        parts = []
        for file, size in _sizes(self.path)[1].items():
            restarted = self.offset is not None and self.offset > size
            start = max(0, size - self.limit) if self.offset is None else 0 if restarted else self.offset
            end = min(size, start + self.limit)
            parts.append(ByteRange(file, start, start, end, end, restarted))
        return parts

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, part)


class FollowReader(DataSourceStreamReader):
    """An offset holds for each file the byte behind the last whole line."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, sizes = _sizes(self.path)
        for file, size in sizes.items():
            self.known[file] = self._last_line_end(system, file, size)
        return {"files": json.dumps(self.known, sort_keys=True)}

    def _last_line_end(self, system: fs.FileSystem, file: str, size: int) -> int:
        """Looks backwards from the end of the file, no farther than to what is known."""
        known = self.known.get(file, 0)
        floor = known if known <= size else 0
        with system.open_input_file(file) as f:
            at = size
            while at > floor:
                begin = max(floor, at - LOOK)
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return floor

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**now, **self.known}
        parts = []
        for file, last in now.items():
            first = before.get(file, 0)
            restarted = first > last
            first = 0 if restarted else first
            parts += [ByteRange(file, first, at, min(last, at + RANGE), last, restarted) for at in range(first, last, RANGE)]
        return parts

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, part)

    def commit(self, end: dict) -> None:
        pass
