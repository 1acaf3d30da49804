"""Frames of power or level: channel power (D12), noise floor (D13), segments (W7), squelch (W8), voice activity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def channel_power(samples: DataFrame, capture: str, n: str, re: str, im: str, frame: int) -> DataFrame:
    """Mean square per frame of so many samples on the absolute timeline, in decibels."""
    power = F.avg(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    return samples.groupBy(capture, F.floor(F.col(n) / frame).alias("frame")).agg((10 * F.log10(F.greatest(power, F.lit(1e-12)))).alias("power_db"))


def noise_floor(frames: DataFrame, capture: str, power: str, share: float = 0.2) -> DataFrame:
    """An interpolated percentile per capture. Of the two values beside it, the first's part is multiplied and added in one rounding, as in the SQL: a frame may lie
    on a bar above the floor to the last bit."""
    whole = Window.partitionBy(capture)
    ranked = frames.withColumn("__n", F.count(power).over(whole)).withColumn("__rank", F.row_number().over(whole.orderBy(F.col(power).asc_nulls_last())))
    at = (F.col("__n") - 1) * F.lit(float(share))
    value = lambda rank: F.max(F.when(F.col("__rank") == rank + 1, F.col(power).cast("double")))
    beside = ranked.groupBy(capture).agg(value(F.floor(at)).alias("__low"), value(F.ceil(at)).alias("__high"), F.max(at - F.floor(at)).alias("__part"), F.count("*").alias("n_frames"))
    known = [F.coalesce(c, F.lit(0.0)) for c in (F.col("__low"), 1 - F.col("__part"), F.col("__high") * F.col("__part"))]
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *known).cast("double")
    floor = F.when(F.col("__low").isNull() | (F.col("__part") == 0), F.col("__low")).otherwise(between)
    return beside.select(capture, floor.alias("floor"), "n_frames")


def segments(
    frames: DataFrame, capture: str, frame: str, power: str, rate: float, *, margin: float = 10.0, hang_ms: float = 600, least_ms: float = 400, pad_ms: float = 300
) -> DataFrame:
    """Capture, start_s, end_s of runs of frames at or above the noise floor plus the margin. Gaps shorter than the hang time are bridged,
    short runs left out, the others padded within the capture. Frames are numbered from 0 without holes."""
    floors = noise_floor(frames, capture, power)
    active = frames.join(floors, capture).filter(F.col(power) >= F.col("floor") + margin)
    hang = max(1, round(hang_ms / 1000 * rate))
    order = Window.partitionBy(capture).orderBy(frame)
    opened = F.coalesce((F.col(frame) - F.lag(frame).over(order) > hang).cast("int"), F.lit(0))
    runs = active.withColumn("__opened", opened).withColumn("__run", F.sum("__opened").over(order))
    found = runs.groupBy(capture, "__run").agg(F.min(frame).alias("first"), (F.max(frame) + 1).alias("last"), F.first("n_frames").alias("n_frames"))
    start, end = F.col("first") / rate, F.col("last") / rate
    kept = found.filter(F.col("last") - F.col("first") >= least_ms / 1000 * rate - 1e-9)  # in frames: seconds far from 0 are too coarse
    return kept.select(capture, F.greatest(F.lit(0.0), start - pad_ms / 1000).alias("start_s"), F.least(F.col("n_frames") / rate, end + pad_ms / 1000).alias("end_s"))


def duty_warning(found: DataFrame, capture: str, seconds: DataFrame) -> DataFrame:
    """seconds (capture, total_s) with none, implausible (more than half of the time) or ok."""
    used = found.groupBy(capture).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("used_s"))
    share = F.coalesce(F.col("used_s"), F.lit(0.0)) / F.col("total_s")
    return seconds.join(used, capture, "left").select(capture, F.when(F.col("used_s").isNull(), "none").when(share > 0.5, "implausible").otherwise("ok").alias("warning"))


def _in_order(rows: DataFrame, capture: str, frame: str) -> DataFrame:
    """Each capture whole in one partition, its frames in order; Spark's sort spills, so that nothing holds a capture."""
    return rows.repartition(capture).sortWithinPartitions(F.col(capture), F.col(frame).asc_nulls_last())


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bool]]]:
    """Each batch, and for each of its rows whether a capture (the first column) begins there. Null and NaN are captures of their own."""
    last = _begins  # no capture
    for batch in batches:
        begins = []
        for here in batch.column(0).to_pylist():
            begins.append(not (here == last or (here != here and last != last)))
            last = here
        yield batch, begins


def squelch(frames: DataFrame, capture: str, frame: str, power: str, threshold: float, rate: float, attack_ms: float = 5.0, release_ms: float = 100.0) -> DataFrame:
    """Frames with level (a follower with fast attack and slow release) and open. The coefficient depends on the level itself, so each capture is
    followed in order, in one task, which holds a batch and the level."""
    rise, fall = (float(np.exp(-1 / max(1.0, rate * ms / 1000))) for ms in (attack_ms, release_ms))
    rows = frames.select(capture, frame, power)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = 0.0
        for batch, begins in _begins(batches):
            values, out = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False), np.empty(batch.num_rows)
            for i, p in enumerate(values):
                if begins[i]:
                    level = p
                keep = rise if p > level else fall
                out[i] = level = keep * level + (1 - keep) * p
            columns = [*batch.columns, pa.array(out, from_pandas=True), pa.array(out >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "level", "open"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _in_order(rows, capture, frame).mapInArrow(follow, f"{fields}, level double, open boolean")


@dataclass(frozen=True)
class Vad:
    """Fixed values of the detector, in frames of 20 ms: onset 3 of 5, pre-roll 20, hang 30, kept tail 12, longest 1500, least active 15,
    floor over 150 frames."""

    onset: int = 3
    onset_of: int = 5
    pre_roll: int = 20
    hang: int = 30
    tail: int = 12
    longest: int = 1500
    least_active: int = 15
    least_ratio: float = 0.2
    floor: float = 0.010
    open_ratio: float = 3.0
    close_ratio: float = 1.5
    window: int = 150
    share: float = 0.2


def _noise(recent: list[float], share: float) -> float:
    return sorted(recent)[int(share * (len(recent) - 1))] if recent else 0.0


class Detector:
    """The detector's state within a capture. The floor learns from quiet frames only, and decides what is quiet."""

    def __init__(self, v: Vad):
        self.v, self.at, self.begun, self.silent, self.n_active, self.total = v, 0, None, 0, 0, 0
        self.quiet, self.recent, self.active = [], [], []

    def push(self, level: float) -> tuple[int, int, int, int] | None:
        """Takes the next frame; first frame, end frame (exclusive), active and all frames of the chunk that ends with it."""
        v, i = self.v, self.at
        self.at += 1
        if self.begun is None:
            loud = level >= max(v.floor, _noise(self.quiet, v.share) * v.open_ratio)
            if not loud:
                self.quiet = (self.quiet + [level])[-v.window :]
            self.active, self.recent = (self.active + [loud])[-v.onset_of :], (self.recent + [i])[-v.pre_roll :] if v.pre_roll else []
            if sum(self.active) >= v.onset:
                self.begun, self.total = (self.recent[0] if self.recent else i + 1), len(self.recent)
                self.n_active, self.silent, self.active, self.recent = sum(self.active), 0, [], []
            return None
        self.total += 1
        loud = level >= max(v.floor, _noise(self.quiet, v.share) * v.close_ratio)
        self.n_active, self.silent = (self.n_active + 1, 0) if loud else (self.n_active, self.silent + 1)
        found = None
        if self.silent >= v.hang:
            if self.n_active >= v.least_active and self.n_active / self.total >= v.least_ratio:
                found = (self.begun, i + 1 - max(0, v.hang - v.tail), self.n_active, self.total)
            self.quiet = (self.quiet + [level])[-v.window :]
            self.begun, self.silent = None, 0
        elif i + 1 - self.begun >= v.longest:
            found = (self.begun, i + 1, self.n_active, self.total)
            self.begun, self.silent, self.n_active, self.total = i + 1, 0, 0, 0
        return found


def speech_chunks(levels: Iterable[float], v: Vad = Vad()) -> list[tuple[int, int, int, int]]:
    """First frame, end frame (exclusive), active and all frames of each chunk."""
    detector = Detector(v)
    return [found for level in levels if (found := detector.push(level)) is not None]


def voice_activity(frames: DataFrame, capture: str, frame: str, level: str, config: Vad = Vad()) -> DataFrame:
    """Capture, chunk, first, end, active, total. Sequential within a capture, of which a task holds a batch and the detector's state; captures
    run in parallel."""
    names = [capture, "chunk", "first", "end", "active", "total"]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector, chunk = Detector(config), 0
        for batch, begins in _begins(batches):
            values, at, chunks = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist(), [], []
            for i, value in enumerate(values):
                if begins[i]:
                    detector, chunk = Detector(config), 0
                if (found := detector.push(value)) is not None:
                    at.append(i)
                    chunks.append((chunk, *found))
                    chunk += 1
            if chunks:
                columns = [pa.array(c, pa.int64()) for c in zip(*chunks, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    kind = frames.schema[capture].dataType.simpleString()
    rows = _in_order(frames.select(capture, frame, level), capture, frame)
    return rows.mapInArrow(detect, f"`{capture}` {kind}, chunk long, first long, end long, active long, total long")
