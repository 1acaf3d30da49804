"""Receiving-station analytics: distinct vessels per hour and rolling (A3-A6), sector records (A10), heartbeats (R14, K27) and silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import bearing_deg, great_circle_km

MAX_PLAUSIBLE_KM = 150.0


def hourly(messages: DataFrame, hour: str, key: str) -> DataFrame:
    """A3, A5: hour, vessels, messages. Spark splits the distinct count into partial sums per (hour, key)."""
    per_key = messages.groupBy(hour, key).agg(F.count("*").alias("messages"))
    return per_key.groupBy(hour).agg(F.count("*").alias("vessels"), F.sum("messages").alias("messages"))


def rolling_distinct(messages: DataFrame, hour: str, key: str, hours: int) -> DataFrame:
    """A4: per hour with a message, the distinct keys of the last ``hours`` clock hours, that one included.

    A key seen in hour h counts in hours h to h + hours - 1; it is counted once where its own runs overlap, so no set is ever held: each
    (key, hour) adds the hours up to its next sighting, and a difference array sums them.
    """
    seen = messages.select(hour, key).distinct()
    following = F.lead(hour).over(Window.partitionBy(key).orderBy(hour))
    until = F.least(F.col(hour) + hours, F.coalesce(following, F.col(hour) + hours))
    spans = seen.select(F.col(hour).alias("from"), until.alias("until"))
    steps = spans.groupBy(F.col("from").alias(hour)).agg(F.count("*").alias("step")).unionByName(
        spans.groupBy(F.col("until").alias(hour)).agg((-F.count("*")).alias("step"))
    ).groupBy(hour).agg(F.sum("step").alias("step"))
    # One row per hour from here on.
    counted = steps.withColumn("distinct_keys", F.sum("step").over(Window.orderBy(hour)))
    return counted.join(messages.select(hour).distinct(), hour, "left_semi").select(hour, "distinct_keys")


def station_verdict(hours: DataFrame, hour: str, least_mean: float) -> DataFrame:
    """Mean and min of vessels over whole hours (the first and the last are left out), and the verdict. One row."""
    ends = hours.agg(F.min(hour).alias("__first"), F.max(hour).alias("__last"))
    whole = hours.crossJoin(F.broadcast(ends)).filter((F.col(hour) > F.col("__first")) & (F.col(hour) < F.col("__last")))
    mean = F.avg("vessels")
    verdict = F.when(F.count("*") == 0, "no_data").when(mean >= least_mean, "pass").otherwise("fail")
    return whole.agg(F.count("*").alias("hours"), F.round(mean, 6).alias("mean_vessels"), F.min("vessels").alias("min_vessels"), verdict.alias("verdict"))


def sector_records(fixes: DataFrame, lat: float, lon: float, detail: list[str], ordinal: str, sectors: int = 8) -> DataFrame:
    """A10: per 45 degree sector (centred on north) the farthest fix with its detail (ties to the first), and the counts of rejects by reason.

    fixes: latitude, longitude and the detail columns. Rows: sector degrees or null, reason or null, n, km and the detail of the record.
    """
    km = great_circle_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    width = 360 // sectors
    sector = (F.floor(F.pmod(bearing_deg(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")) + width / 2, F.lit(360.0)) / width) * width).cast("int")
    rows = fixes.withColumn("km", km)
    reason = F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), "no_position").when(F.col("km") > MAX_PLAUSIBLE_KM, "implausible")
    rows = rows.withColumn("reason", reason).withColumn("sector", F.when(F.col("reason").isNull(), sector))
    best = F.max_by(F.struct(*detail, "km"), F.when(F.col("reason").isNull(), F.struct("km", (-F.col(ordinal)).alias("first"))))
    out = rows.groupBy("sector", "reason").agg(F.count("*").alias("n"), best.alias("__best"))
    return out.select("sector", "reason", "n", F.round("__best.km", 6).alias("km"), *[F.col(f"__best.{c}").alias(c) for c in detail])


def minute_beats(messages: DataFrame, minute: str, first: int, last: int) -> DataFrame:
    """A heartbeat for every minute from first to last, with the messages heard in it: one without any still counts, so that a gap is a dead
    station and not a quiet sea."""
    minutes = messages.sparkSession.range(first, last + 1).withColumnRenamed("id", minute)
    heard = messages.groupBy(minute).agg(F.count("*").alias("messages"))
    return minutes.join(heard, minute, "left").select(minute, F.coalesce("messages", F.lit(0)).alias("messages"))


def silent_minutes(beats: DataFrame, minute: str, after: int) -> DataFrame:
    """Heartbeats at which nothing was heard for so many minutes and again after each further so many: the watch repeats while it is silent."""
    heard = F.max(F.when(F.col("messages") > 0, F.col(minute))).over(Window.orderBy(minute))  # one row per minute
    quiet = beats.withColumn("silent", F.col(minute) - heard)
    return quiet.filter((F.col("silent") > 0) & (F.col("silent") % after == 0))
