"""File sources: capture indexes (S19-S21), labels (S22), references (S23), worksheets (S24), results (S25, S26), cut lists (S32), dumps (S36), settings (S38),
basebands (S28-S31)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from .. import schemas
from ..functions.text import strip_tag
from ..functions.time import stamp
from .logs import ordered_lines


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines (a byte order mark and CRLF are fine, bad rows go): clip (four digits or more), stamp (offset dropped), channel, text; of equal
    clips the last line counts, in the order of the files' paths and of their lines."""
    lines = ordered_lines(spark, path)
    rows = lines.select(F.col("place").alias("line"), F.from_json("value", schemas.CAPTURE).alias("c")).filter("c.index IS NOT NULL")
    named = rows.select(F.format_string("%04d", "c.index").alias("clip"), stamp(F.col("c.timestamp")).alias("stamp"), "c.channel", "c.text", "line").filter("stamp IS NOT NULL")
    return named.groupBy("clip").agg(F.max_by(F.struct("stamp", "channel", "text"), "line").alias("c")).select("clip", "c.*")


def replay_chunks(captures: DataFrame) -> DataFrame:
    """Texts without display tags, empty ones left out, with their place in time; those of one second lie by their clips' numbers, which may have more than four digits."""
    said = captures.withColumn("text", F.trim(strip_tag(F.col("text")))).filter("text <> ''")
    return said.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy("stamp", F.length("clip"), "clip")))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Start, end, mmsi (null for '-'), note. '#' starts a comment line; a line with fewer than three fields raises."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.split("value", "\t").alias("f"), "value")
    checked = F.when(F.size("f") < 3, F.raise_error(F.concat(F.lit("malformed label: "), F.col("value")))).otherwise(F.col("f"))
    rows = lines.select(checked.alias("f"))
    field = lambda i: F.nullif(F.trim(F.get("f", F.lit(i))), F.lit(""))
    return rows.select(stamp(field(0)).alias("start"), stamp(field(1)).alias("end"), F.nullif(field(2), F.lit("-")).alias("mmsi"), field(3).alias("note"), F.coalesce(field(4), F.lit("160,650")).alias("channel"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """Clip and reference, parted by the first tab, else the first colon; lines with neither and those that start with '#' go, of equal clips the last line counts."""
    lines = ordered_lines(spark, path).select(F.trim("value").alias("value"), F.col("place").alias("line")).filter("NOT startswith(value, '#')")
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t", 2)).when(F.col("value").contains(":"), F.split("value", ":", 2))
    rows = lines.select(F.trim(parts[0]).alias("clip"), F.trim(parts[1]).alias("reference"), "line").filter("clip IS NOT NULL AND clip <> ''")
    return rows.groupBy("clip").agg(F.max_by("reference", "line").alias("reference"))


def worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Blocks headed '--- 0001 ---' of 'FIELD: value' lines, as clip and a map of fields; the last value of a field counts."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"(?m)^(?=--- \d+ ---)")).alias("block")).select(F.regexp_extract("block", r"^--- (\d+) ---", 1).alias("clip"), "block").filter("clip <> ''")
    lines = blocks.select("clip", F.posexplode(F.split("block", r"\r?\n")).alias("place", "line"))
    fields = lines.select("clip", "place", F.regexp_extract("line", r"^([A-Z]+):", 1).alias("field"), F.trim(F.regexp_replace("line", r"^[A-Z]+:", "")).alias("value")).filter("field <> ''")
    last = fields.groupBy("clip", "field").agg(F.max_by("value", "place").alias("value"))
    return last.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """A results file, or a folder of them, {results: {config: [row]}} as rows with their config; of equal clips in a config the last of the last file counts."""
    row = "ARRAY<STRUCT<clip_id: STRING, text: STRING, reference: STRING, elapsed: DOUBLE, wer: DOUBLE, error: STRING>>"
    rows = spark.read.schema(f"results MAP<STRING, {row}>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "results")
    flat = rows.select("file", F.explode("results").alias("config", "rows")).select("file", "config", F.posexplode("rows").alias("n", "r"))
    flat = flat.select("config", "r", F.struct("file", "n").alias("place"))
    return flat.groupBy("config", F.col("r.clip_id").alias("clip_id")).agg(F.max_by("r", "place").alias("r")).select("config", "r.*")


def cut_list(spark: SparkSession, path: str) -> DataFrame:
    """S32."""
    return spark.read.schema("start_s DOUBLE, end_s DOUBLE").csv(path, sep="\t", comment="#")


def write_cut_list(segments: DataFrame, path: str) -> None:
    """Tab-separated, three decimals."""
    segments.select(F.format_string("%.3f\t%.3f", "start_s", "end_s").alias("value")).write.text(path)


def dump_times(names: DataFrame, column: str, since: str, until: str) -> DataFrame:
    """The different times in dump names 'name-YYYYMMDD-HHMMSS' of a range."""
    found = names.select(F.explode(F.regexp_extract_all(column, F.lit(r"(\d{8}-\d{6})"), F.lit(1))).alias("raw")).distinct()
    return found.select(F.try_to_timestamp("raw", F.lit("yyyyMMdd-HHmmss")).alias("t")).filter(F.col("t").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def batch_settings(lines: DataFrame, known: list[str], column: str = "value") -> DataFrame:
    """S38: 'set KEY=value' lines of known keys."""
    m = lambda i: F.regexp_extract(column, r"(?i)^\s*set\s+\"?([A-Z_]+)=(.*?)\"?\s*$", i)
    return lines.select(m(1).alias("key"), m(2).alias("value")).filter(F.col("key").isin(known))


def baseband_blocks(spark: SparkSession, path: str, block_frames: int = 1 << 16, task_blocks: int = 64) -> DataFrame:
    """RIFF or RF64 recordings of two channels as blocks: capture, centre_hz, rate, block, re, im (arrays of float).

    Only headers are read for the plan, whatever the files' size; a task reads so many blocks of one file, 16 MB at 16 bits, block by block.
    """
    spark.dataSource.register(Baseband)
    options = {"path": path, "block_frames": str(block_frames), "task_blocks": str(task_blocks)}
    return spark.read.format("voxlake_baseband").options(**options).load()


@dataclass
class BlockRange(InputPartition):
    """Blocks first to last (exclusive) of a file whose samples start at a byte and have so many frames."""

    file: str
    rate: int
    bits: int
    start: int
    frames: int
    first: int
    last: int


class Baseband(DataSource):
    """Recordings in a file or folder that Arrow's file systems open (local paths and URIs)."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_baseband"

    def schema(self) -> str:
        return "capture string, centre_hz long, rate int, block long, re array<float>, im array<float>"

    def reader(self, schema) -> DataSourceReader:
        return BasebandReader(self.options)


class BasebandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.per_task = options["path"], int(options["block_frames"]), int(options["task_blocks"])

    def partitions(self) -> list[BlockRange]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file]
        out = []
        for file in found:
            with system.open_input_file(file.path) as f:
                rate, bits, start, size = _header(lambda at, n: (f.seek(at), f.read(n))[1], file.size)  # noqa: B023
            frames = min(size, file.size - start) // (2 * bits // 8)  # a torn tail is cut to whole frames
            blocks = -(-frames // self.block)
            out += [BlockRange(file.path, rate, bits, start, frames, k, min(blocks, k + self.per_task)) for k in range(0, blocks, self.per_task)]
        return out

    def read(self, part: BlockRange) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        capture = part.file.rsplit("/", 1)[-1]
        centre = re.search(r"_(\d+)Hz", capture)
        width = 2 * part.bits // 8
        with system.open_input_file(part.file) as f:
            for k in range(part.first, part.last):
                f.seek(part.start + k * self.block * width)
                x = _samples(f.read(min(self.block, part.frames - k * self.block) * width), part.bits)
                side = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([capture]), pa.array([int(centre[1]) if centre else None], pa.int64()), pa.array([part.rate], pa.int32()), pa.array([k], pa.int64()), side(x[0::2]), side(x[1::2])],
                    names=["capture", "centre_hz", "rate", "block", "re", "im"],
                )


def _header(read: Callable[[int, int], bytes], file_size: int) -> tuple[int, int, int, int]:
    """Rate, bits, start and size of the samples. The header is walked chunk by chunk; a 64-bit size stands in 'ds64'."""
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("neither RIFF nor RF64")
    number = lambda raw: int.from_bytes(raw, "little")
    at, long_size, rate, bits = 12, None, 0, 0
    while at + 8 <= file_size:
        chunk = read(at, 8)
        kind, size, body = chunk[:4], number(chunk[4:]), at + 8
        if kind == b"ds64":
            long_size = number(read(body + 8, 8))
        elif kind == b"fmt ":
            form = read(body, 16)
            channels, rate, bits = number(form[2:4]), number(form[4:8]), number(form[14:16])
            if channels != 2 or bits not in (8, 16, 32):
                raise ValueError(f"{channels} channels of {bits} bits")
        elif kind == b"data":
            return rate, bits, body, long_size if size == 0xFFFFFFFF and long_size is not None else size
        at = body + size + size % 2
    raise ValueError("no samples")


def _samples(raw: bytes, bits: int) -> np.ndarray:
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    return np.frombuffer(raw, "<i2").astype(np.float32) / 32768 if bits == 16 else np.frombuffer(raw, "<f4")


def wav_bytes(samples: Column, rate: int) -> Column:
    """A WAV file (16 bits, one channel) of the samples; an empty clip becomes 20 ms of silence."""
    @F.pandas_udf("binary")
    def encoded(samples: pd.Series) -> pd.Series:
        def one(x) -> bytes:
            data = np.zeros(rate // 50) if x is None or not len(x) else np.asarray(x, float)
            body = np.clip(np.round(data * 32767), -32768, 32767).astype("<i2").tobytes()
            size = lambda n: n.to_bytes(4, "little")
            head = b"RIFF" + size(36 + len(body)) + b"WAVEfmt " + size(16) + b"\1\0\1\0" + size(rate) + size(2 * rate) + b"\2\0\x10\0data" + size(len(body))
            return head + body

        return samples.map(one)

    return encoded(samples)


def write_wavs(clips: DataFrame, name_col: str, samples_col: str, rate: int, folder: str) -> None:
    """Writes a file per row into a folder that Arrow's file systems open; a name may lie in folders below it. A file appears whole, under its name, when its row
    is done; a task that runs again writes the same files."""
    clips.sparkSession.dataSource.register(WavFiles)
    rows = clips.select(F.col(name_col).cast("string").alias("name"), wav_bytes(F.col(samples_col), rate).alias("content"))
    rows.write.format("voxlake_wav").option("folder", folder).mode("append").save()


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxlake_wav"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options["folder"])


class WavWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        for row in rows:
            below, _, name = row["name"].rpartition("/")
            if not name or any(part in ("", ".", "..") for part in below.split("/") if below):
                raise ValueError(f"no file name: {row['name']}")
            place = f"{root}/{below}" if below else root
            system.create_dir(place, recursive=True)
            part = f"{place}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(bytes(row["content"]))
            system.move(part, f"{place}/{name}")
        return WriterCommitMessage()
