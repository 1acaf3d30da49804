"""State of feeds: lamps (R13, X29, X42), scope published after a good poll (R4, S6), sampled failures (X30, X31), quota steps (R18), fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.feeds import hub_ships

#: Fixed value: a station without a heartbeat for so many seconds is red.
STATION_STALE_SEC = 150


def station_lamp(beat_age: Column, connected: Column, poll_ok: Column) -> Column:
    """Red without a fresh heartbeat, amber when not connected or the last poll failed, else green."""
    return (
        F.when(beat_age.isNull() | (beat_age > STATION_STALE_SEC), "red").when(~F.coalesce(connected, F.lit(False)), "amber")
        .when(~F.coalesce(poll_ok, F.lit(True)), "amber").otherwise("green")
    )


def hub_lamp(failures: Column, since_ok: Column, poll_sec: Column) -> Column:
    """Red while polls fail, unlit before the first good one, amber when a poll is overdue by two periods."""
    return (
        F.when(F.coalesce(failures, F.lit(0)) > 0, "red").when(since_ok.isNull(), "unlit")
        .when(since_ok > 2 * F.coalesce(poll_sec, F.lit(900)), "amber").otherwise("green")
    )


def feed_status(polls: DataFrame, feed: str, at: str) -> DataFrame:
    """Per feed the last good poll, its count, the last error (which outlives a recovery) and the failures since the last good poll. polls: feed, at, ok, n, error."""
    ok = F.col("ok")
    last_ok = F.max(F.when(ok, F.col(at))).alias("last_ok_at")
    base = polls.groupBy(feed).agg(last_ok, F.max_by("n", F.when(ok, F.col(at))).alias("last_count"), F.max_by("error", F.when(~ok, F.col(at))).alias("last_error"))
    since = polls.filter(~ok).join(base.select(feed, "last_ok_at"), feed).filter(F.col("last_ok_at").isNull() | (F.col(at) > F.col("last_ok_at")))
    return base.join(since.groupBy(feed).agg(F.count("*").alias("consecutive_failures")), feed, "left").fillna(0, ["consecutive_failures"])


def logged_failures(failures: DataFrame, feed: str, at: str, first: int = 3, every: int = 20) -> DataFrame:
    """The failures that are logged: the first few of a feed, then every so many."""
    n = F.row_number().over(Window.partitionBy(feed).orderBy(at))
    return failures.withColumn("n", n).filter((F.col("n") <= first) | (F.col("n") % every == 0))


def quota_warnings(readings: DataFrame, key: str, at: str, left: str, step: int = 50, rearm: int = 200) -> DataFrame:
    """Readings at which the quota left first falls into a lower step of 50, since it last stood above 200."""
    low = F.when(F.col(left) <= rearm, F.floor(F.col(left) / step))
    order = Window.partitionBy(key).orderBy(at)
    runs = readings.withColumn("__step", low).withColumn("__run", F.sum(F.col("__step").isNull().cast("int")).over(order))
    before = Window.partitionBy(key, "__run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("__step").over(before)
    return runs.withColumn("__least", least).filter(F.col("__step").isNotNull() & (F.col("__least").isNull() | (F.col("__step") < F.col("__least")))).drop("__step", "__run", "__least")


def tumbling(samples: DataFrame, capture: str, index: str, rate: int, seconds: int = 5) -> DataFrame:
    """Fixed windows by sample number: first and last sample, and how many."""
    return samples.groupBy(capture, F.floor(F.col(index) / (seconds * rate)).alias("window")).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))


def hub_sink(path: str):
    """S6, R4 for foreachBatch: a poll's payloads are validated as a whole, then written, and its scope (the numbers in the box and the batch) last: a reader
    that joins on the newest scope never sees half a poll. A bad payload fails the batch and leaves the last scope in force."""
    def write(batch: DataFrame, number: int) -> None:
        ships = hub_ships(batch).withColumn("batch", F.lit(number))
        ships.write.mode("overwrite").parquet(f"{path}/ships/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{path}/ships/batch={number}")
        stored.select("mmsi").distinct().withColumn("poll", F.lit(number)).write.mode("overwrite").parquet(f"{path}/scope/poll={number}")

    return write
