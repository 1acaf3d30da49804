"""Structured Streaming forms: sessions (R8), hourly counts (A3, R15), late enrichment (R10), insert-if-absent sinks (K4), snapshot log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import archive


#: Fixed value: rows of a full session.
FULL = 40


def quiet_sessions(chunks: DataFrame, gap: int = 60, late: str = "10 minutes", cap: int = FULL) -> DataFrame:
    """A session per channel closes when it has been quiet longer than the gap (events exactly the gap apart stay together) or is full. The state of a
    channel is its open session's start, last time, count and ids."""
    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = list(state.get) if state.exists else None, []
        for row in () if state.hasTimedOut else pd.concat(list(batches)).sort_values(["time", "id"]).itertuples():
            if held is not None and ((row.time - held[1]).total_seconds() > gap or held[2] >= cap):
                out.append(held)
                held = None
            held = [row.time, row.time, 1, row.id, row.id] if held is None else [held[0], max(held[1], row.time), held[2] + 1, min(held[3], row.id), max(held[4], row.id)]
        over = int(held[1].timestamp() * 1000) + gap * 1000 + 1
        if held[2] >= cap or state.hasTimedOut or over <= state.getCurrentWatermarkMs():
            out.append(held)
            state.remove() if state.exists else None
        else:
            state.update(tuple(held))
            state.setTimeoutTimestamp(over)
        if out:
            yield pd.DataFrame([(key[0], h[0], *h[2:]) for h in out], columns=["channel", "start", "n", "first_id", "last_id"])

    rows = chunks.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    kind = "start timestamp, last timestamp, n long, first_id long, last_id long"
    found = "channel string, start timestamp, n long, first_id long, last_id long"
    return rows.select("channel", "time", "id").groupBy("channel").applyInPandasWithState(close, found, kind, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(messages: DataFrame, late: str = "2 hours") -> DataFrame:
    """Messages and different vessels per hour, exactly: counted per hour and vessel first, then per hour. State leaves with the watermark."""
    rows = messages.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late)
    per_vessel = rows.groupBy(F.window("t", "1 hour").alias("w"), "mmsi").agg(F.count("*").alias("messages"))
    hours = per_vessel.groupBy(F.window("w", "1 hour").alias("hour")).agg(F.sum("messages").alias("messages"), F.count("mmsi").alias("vessels"))
    return hours.select(F.col("hour.start").alias("hour"), "messages", "vessels")


def late_enrichment(transmissions: DataFrame, snapshots: DataFrame, after: int = 60, late: str = "75 seconds") -> DataFrame:
    """Each transmission with the snapshots that came up to ``after`` seconds later; once, with nulls, when the watermark passed without one.

    transmissions: id, t. snapshots: snap_t, hex. Both meet in buckets of ``after`` seconds: a transmission lies in its own, a snapshot in its own and
    the one before, so that a pair meets once and a hot time spreads over the buckets.
    """
    bucket = lambda t: F.floor(F.unix_timestamp(t) / after)
    left = transmissions.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late).withColumn("bucket", bucket(F.col("t")))
    right = snapshots.withColumn("snap_t", F.col("snap_t").cast("timestamp")).withWatermark("snap_t", late)
    right = right.withColumn("snap_bucket", F.explode(F.array(bucket(F.col("snap_t")), bucket(F.col("snap_t")) - 1)))
    within = (F.col("snap_t") > F.col("t")) & (F.col("snap_t") <= F.col("t") + F.expr(f"INTERVAL {after} SECONDS"))
    return left.join(right, (F.col("bucket") == F.col("snap_bucket")) & within, "left_outer").select("id", "t", "snap_t", "hex")


def archive_sink(path: str, key: str, ordinal: str):
    """K4 for foreachBatch: appends what the archive at path doesn't hold, each batch in a folder of its own. A batch that is run again replaces what it
    wrote before, whole or in part."""
    def write(batch: DataFrame, number: int) -> None:
        try:
            stored = batch.sparkSession.read.parquet(path).filter(F.col("batch") != number)
        except AnalysisException as error:  # the first batch finds no archive
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = batch.limit(0)
        archive.insert_if_absent(stored, batch, key, ordinal).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def snapshot_log(snapshots: DataFrame, path: str, checkpoint: str):
    """Snapshots appended as JSON lines, a folder per day."""
    day = F.date_format(F.try_to_timestamp("t"), "yyyy-MM-dd")
    return snapshots.withColumn("day", day).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
