"""Clips of turns: the recording that was made at a turn's time, if its file is still there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import turn_time
from . import temporal


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """Day and clip of every recording below a root. Only names are read, not the files."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*_sent.wav").option("recursiveFileLookup", True).load(root).select("path")
    return names.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("day"), F.regexp_extract("path", r"([^/]+)_sent\.wav$", 1).alias("clip"))


def of_turns(turns: DataFrame, index: DataFrame, files: DataFrame, within: int = 2) -> DataFrame:
    """Turns (turn_id, start, time) with clip and clip_day, both null unless a clip of the index (day, clip, at in seconds) lies within so many
    seconds of the turn, on its day, and is among the files (day, clip)."""
    moment = turn_time(F.col("start").cast("timestamp"), F.col("time"))
    timed = turns.withColumn("__at", F.unix_timestamp(moment)).withColumn("__day", F.date_format(moment, "yyyy-MM-dd"))
    asked = timed.filter("__at IS NOT NULL").select("turn_id", F.col("__at").alias("at"), F.col("__day").alias("day"))
    near = temporal.nearest_within(asked, index.select("day", "clip", "at"), "turn_id", "at", within, "clip", ["day"])
    there = near.filter("found IS NOT NULL").select("turn_id", F.col("found.clip").alias("clip"), F.col("found.day").alias("day")).join(files.select("day", "clip").distinct(), ["day", "clip"])
    return timed.drop("__at", "__day").join(there.select("turn_id", "clip", F.col("day").alias("clip_day")), "turn_id", "left")
