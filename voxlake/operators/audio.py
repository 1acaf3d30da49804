"""Audio in blocks: gates at the audio's rate (W9), cuts along a list (D14), the plan of a reference arm (D19) and an arm's clips.

A capture lies in blocks (capture, block, samples) of ``size`` samples, the last one shorter, so that an hour spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import conditioned
from . import signal


def _length(blocks: DataFrame, size: int) -> DataFrame:
    """capture, n: its samples."""
    return blocks.groupBy("capture").agg(F.max(F.col("block") * size + F.size("samples")).alias("n"))


def gated(blocks: DataFrame, frames: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks with the samples of closed frames zeroed. frames: capture, frame, open. Frame f covers the samples from int(f * scale) up to those of
    the next; where the last frame is closed, the rest of the audio is too."""
    last = frames.groupBy("capture").agg(F.max("frame").alias("last"))
    closed = frames.filter(~F.col("open")).join(last, "capture").join(_length(blocks, size), "capture")
    start = F.floor(F.col("frame") * scale)
    end = F.when(F.col("frame") == F.col("last"), F.col("n")).otherwise(F.least(F.floor((F.col("frame") + 1) * scale), F.col("n")))
    spans = closed.select("capture", start.alias("start"), end.alias("end")).filter("start < end")
    laid = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    gates = laid.groupBy("capture", "block").agg(F.collect_list(F.struct("start", "end")).alias("closed"))  # at most size spans a block
    joined = blocks.join(gates, ["capture", "block"], "left")
    place = lambda i: F.col("block") * size + i
    silent = lambda i: F.exists("closed", lambda s: (place(i) >= s["start"]) & (place(i) < s["end"]))
    samples = F.when(F.col("closed").isNull(), F.col("samples")).otherwise(F.transform("samples", lambda x, i: F.when(silent(i), 0.0).otherwise(x)))
    return joined.select("capture", "block", samples.alias("samples"))


def cut(blocks: DataFrame, segments: DataFrame, rate: float, size: int) -> DataFrame:
    """A row per segment (capture, segment, start_s, end_s) with its samples: ends beyond the capture are clipped, a segment past its end is empty."""
    n = F.coalesce("n", F.lit(0))
    first = F.least(n, F.greatest(F.lit(0), F.floor(F.col("start_s") * rate)))
    placed = segments.join(_length(blocks, size), "capture", "left").withColumn("first", first)
    placed = placed.withColumn("last", F.least(n, F.greatest("first", F.floor(F.col("end_s") * rate)))).select("capture", "segment", "first", "last")
    laid = placed.filter("first < last").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("last") - 1) / size))))
    part = F.slice("samples", F.greatest(F.lit(0), F.col("first") - F.col("block") * size) + 1, F.least(F.col("last"), (F.col("block") + 1) * size) - F.greatest("first", F.col("block") * size))
    parts = laid.join(blocks, ["capture", "block"]).groupBy("capture", "segment").agg(F.array_sort(F.collect_list(F.struct("block", part.alias("part")))).alias("parts"))
    joined = placed.join(parts, ["capture", "segment"], "left")
    samples = F.coalesce(F.flatten(F.transform("parts", lambda p: p["part"])), F.array().cast(blocks.schema["samples"].dataType))
    return joined.select("capture", "segment", samples.alias("samples"))


def planned(levels: DataFrame, rate: float, **options) -> DataFrame:
    """The cut list of all arms, from the power (arm, bandwidth, capture, frame, power) of the widest arm of each capture."""
    widest = levels.groupBy("capture").agg(F.max_by("arm", F.struct("bandwidth", "arm")).alias("arm"))
    reference = levels.join(widest, ["capture", "arm"])
    return signal.segments(reference, "capture", "frame", "power", rate, **options)


def arm_clips(blocks: DataFrame, frames: DataFrame | None, segments: DataFrame, rate: float, scale: float, size: int) -> DataFrame:
    """An arm's clips, conditioned for the decoder: cut along the list of all arms, gated (where frames are given) after the cuts were planned. Each
    segment gives one clip, if an empty one, so that numbers agree across arms."""
    audio = blocks if frames is None else gated(blocks, frames, scale, size)
    return conditioned(cut(audio, segments, rate, size), "samples", rate)


def clip_path(root: str, day: Column, clip: Column) -> Column:
    """X11: the file of a clip inside the root; null unless day and clip have exactly their forms."""
    fits = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}\z") & clip.rlike(r"^\d{4}\z"), F.lit(False))
    return F.when(fits, F.concat_ws("/", F.lit(root.rstrip("/")), day, F.concat(clip, F.lit("_sent.wav"))))
