"""R10, the second look at a transmission: once the polls after it are in, the aircraft that acted on a spoken number, the outcome of both clues, and the state that goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import temporal, views


def second_look(stored: DataFrame, snapshots: DataFrame, *, before: int = 10, after: int = 60, poll: int = 15, echo: bool = True, **tolerances) -> DataFrame:
    """stored rows with echo_status, echo_hex, echo_delay, outcome (kind, key, badge) and state.

    stored: id, t (seconds), numbers, candidate, call_hex, outcome_key (of the first look), state (a struct, or null). snapshots: t, hex, on_ground, selected_altitude,
    selected_heading, state (the same struct). The stored state stays unless the outcome names another flight than before: then it is that aircraft's in the last
    snapshot at or before the transmission, no older than the look back of the polls, or still the stored one if the aircraft isn't in it. echo=False leaves the seen clue out.
    """
    found = temporal.change_echo(stored.select("id", "t", "numbers"), snapshots, before=before, after=after, **tolerances)
    found = found.select("id", F.col("status").alias("echo_status"), F.col("hex").alias("echo_hex"), F.col("delay").alias("echo_delay"))
    seen = F.col("echo_hex") if echo else F.lit(None).cast("string")
    rows = stored.join(found, "id", "left").withColumn("outcome", views.combine_clues(F.col("candidate"), F.col("call_hex"), seen))
    moved = (F.col("outcome.kind") == "flight") & ~F.col("outcome.key").eqNullSafe(F.col("outcome_key"))
    asked = rows.filter(moved).select("id", F.col("outcome.key").alias("hex"), (F.col("t") - before - 2 * poll).alias("from"), F.col("t").alias("to"))
    times = snapshots.select(F.col("t").alias("snap_t")).distinct()
    last = temporal.within_intervals(asked, times, [], "from", "to", "snap_t", before + 2 * poll).groupBy("id", "hex").agg(F.max("snap_t").alias("t"))
    there = last.join(snapshots.select("t", "hex", F.col("state").alias("new_state")), ["t", "hex"]).select("id", "new_state")
    return rows.join(there, "id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")


def second_look_sink(path: str, snapshots, **options):
    """For foreachBatch over transmissions that fell due: each batch's result in a folder of its own, written over when the batch is run again. snapshots() reads the log as it is
    by then."""
    def write(batch: DataFrame, number: int) -> None:
        second_look(batch, snapshots(), **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
