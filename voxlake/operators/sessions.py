"""Gap sessions with a size cap (W5) and their closure.

Sessions are cut within (channel, block of time); what a block takes over from the ones before it (how many sessions opened, how many rows the open one
has) comes from one row per channel and block. A channel that holds a third of all rows so spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gaps of time in a block.
BLOCK = 4096


def gap_sessions(rows: DataFrame, channel: str, at: str, order: str, gap: int, cap: int, block: int = BLOCK) -> DataFrame:
    """rows with session (0-based in the channel) and window (0-based in the session): a new session after a gap above ``gap``, a new
    window after ``cap`` rows. The row after a full window is still compared with the row before it. Rows without a time come first, in one block."""
    key = F.coalesce(F.concat(F.lit("+"), F.col(channel).cast("string")), F.lit("-"))
    rows = rows.withColumns({"__channel": key, "__block": F.coalesce(F.floor(F.col(at) / (gap * block)).cast("long"), F.lit(-(2**63)))})
    in_block = Window.partitionBy("__channel", "__block").orderBy(at, order)
    opened = F.coalesce((F.col(at) - F.lag(at).over(in_block) > gap).cast("long"), F.lit(0))
    # One order serves all: a row's place in its session is counted from where the session opened.
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__opened": opened, "__row": F.row_number().over(in_block)})
    rows = rows.withColumns({"__inner": F.sum("__opened").over(upto), "__place": F.col("__row") + 1 - F.coalesce(F.max(F.when(F.col("__opened") == 1, F.col("__row"))).over(upto), F.lit(1))})
    blocks = rows.groupBy("__channel", "__block").agg(
        F.min(at).alias("low"), F.max(at).alias("high"), F.max("__inner").alias("inner"), F.count("*").alias("n"), F.max(F.struct("__inner", "__place"))["__place"].alias("tail"),
    )
    ordered = Window.partitionBy("__channel").orderBy("__block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("low") - F.lag("high").over(ordered) > gap).cast("long"), F.lit(0))
    blocks = blocks.withColumn("fresh", fresh).withColumn("base", F.coalesce(F.sum(F.col("fresh") + F.col("inner")).over(before), F.lit(0)) + F.col("fresh"))
    # Rows of the session that is open at a block's end, summed over the blocks since it opened.
    blocks = blocks.withColumn("since", F.sum(((F.col("fresh") + F.col("inner")) > 0).cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("__channel", "since").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("held", F.sum(F.when(F.col("inner") > 0, F.col("tail")).otherwise(F.col("n"))).over(run))
    blocks = blocks.withColumn("taken", F.when(F.col("fresh") == 1, 0).otherwise(F.coalesce(F.lag("held").over(ordered), F.lit(0))))
    joined = rows.join(blocks.select("__channel", "__block", "base", "taken"), ["__channel", "__block"])
    number = F.col("__place") + F.when(F.col("__inner") == 0, F.col("taken")).otherwise(0)
    return joined.select(*[c for c in rows.columns if not c.startswith("__")], (F.col("base") + F.col("__inner")).cast("long").alias("session"), F.floor((number - 1) / cap).cast("long").alias("window"))


def windows(rows: DataFrame, channel: str, at: str, order: str, gap: int, cap: int, *measures) -> DataFrame:
    """One row per window: n, first, last and the measures."""
    return gap_sessions(rows, channel, at, order, gap, cap).groupBy(channel, "session", "window").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), *measures
    )


def closed_windows(found: DataFrame, channel: str, now, gap: int, cap: int) -> DataFrame:
    """windows with closed: a later window exists on the channel, or it is full, or the channel has been quiet longer than the gap."""
    newest = found.groupBy(F.col(channel).alias("__channel")).agg(F.max(F.struct("session", "window")).alias("__newest"))
    joined = found.join(newest, F.col(channel).eqNullSafe(F.col("__channel")))
    superseded = F.struct("session", "window") < F.col("__newest")
    return joined.withColumn("closed", superseded | (F.col("n") >= cap) | (now - F.col("last") > gap)).drop("__channel", "__newest")
