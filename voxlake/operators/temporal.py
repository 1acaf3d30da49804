"""Joins in time: as-of (J3), nearest within a tolerance (J4), interval containment (J6), change echo.

All of them carry an equi key beside the range (a block or bucket of time), so that the work shuffles on (key, block) and a channel that
holds a third of the rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _columns(prefix: str, df: DataFrame) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in df.columns]


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: int, ordinal: str, blocks_of: int = 64) -> DataFrame:
    """left with struct column 'found': the right row of the same keys with the greatest time at or before left's, no older than the
    tolerance (inclusive); of equal times the one with the greatest ordinal. Null where there is none.

    One shuffle: both sides are laid in blocks of time of 64 tolerances, right rows also in the next block when they reach into it.
    """
    width = max(1, tolerance) * blocks_of
    block = lambda t: F.floor(t / width)
    values = F.struct(*[F.col(c) for c in right.columns])
    rows = right.select(
        *keys, F.col(at).alias("__at"), F.col(ordinal).alias("__ordinal"), values.alias("__right"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__left"),
        F.explode(F.array_distinct(F.array(block(F.col(at)), block(F.col(at) + tolerance)))).alias("__block"),
    )
    asked = left.select(
        *keys, F.col(at).alias("__at"), F.lit(None).cast(right.schema[ordinal].dataType).alias("__ordinal"), F.lit(None).cast(rows.schema["__right"].dataType).alias("__right"),
        F.struct("*").alias("__left"), block(F.col(at)).alias("__block"),
    )
    # At one time right rows come first, so that "at or before" holds.
    order = Window.partitionBy(*keys, "__block").orderBy("__at", F.col("__left").isNotNull(), "__ordinal")
    found = rows.unionByName(asked).withColumn("__found", F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("__at") - F.col(f"__found.{at}") <= tolerance, F.col("__found"))
    return found.filter("__left IS NOT NULL").select("__left.*", kept.alias("found"))


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, at: str, tolerance: int, ordinal: str, keys: list[str] | None = None, blocks_of: int = 8) -> DataFrame:
    """left with 'found' (the right row nearest in time, at most the tolerance away, ties to the smallest ordinal) and 'delta'.

    No pairs are made: of right rows of one time the smallest ordinal stays, and in blocks of time of 8 tolerances (right rows also where they reach into)
    each left row takes the last one before it and the first one after it.
    """
    keys = keys or []
    width = max(1, tolerance) * blocks_of
    block = lambda t: F.floor(t / width)
    known = right.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, at]))
    rows = known.groupBy(*keys, F.col(at).alias("__at")).agg(F.min_by(F.struct(*right.columns), F.col(ordinal)).alias("__right"), F.min(ordinal).alias("__ordinal"))
    reach = F.array_distinct(F.array(block(F.col("__at") - tolerance), block(F.col("__at")), block(F.col("__at") + tolerance)))
    rows = rows.select(*keys, "__at", F.struct("__at", "__ordinal", "__right").alias("__near"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__left"), F.explode(reach).alias("__block"))
    asked = left.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(rows.schema["__near"].dataType).alias("__near"), F.struct("*").alias("__left"), block(F.col(at)).alias("__block"))
    # Both ways right rows come first at their time, and the frame only grows.
    way = lambda order: F.last("__near", ignorenulls=True).over(Window.partitionBy(*keys, "__block").orderBy(order, F.col("__left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(asked).withColumn("__before", way(F.col("__at").asc())).withColumn("__after", way(F.col("__at").desc())).filter("__left IS NOT NULL")
    far = lambda c: F.abs(F.col("__at") - F.col(f"{c}.__at"))
    near = lambda c: F.when(far(c) <= tolerance, F.struct(far(c).alias("delta"), F.col(f"{c}.__ordinal").alias("ordinal"), F.col(f"{c}.__right").alias("found")))
    before, after = near("__before"), near("__after")
    first = (before["delta"] < after["delta"]) | (before["delta"] == after["delta"]) & (before["ordinal"] <= after["ordinal"])
    best = F.when(before.isNull(), after).when(after.isNull() | first, before).otherwise(after)
    return both.select("__left.*", best.alias("__best")).select(*left.columns, "__best.found", "__best.delta")


def within_intervals(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, width: int) -> DataFrame:
    """Pairs of an interval and a point of the same keys with start <= at <= end. A point may lie in several intervals.

    width: of the buckets that an interval is laid over; about the usual length of an interval.
    """
    laid = intervals.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("__bucket", F.floor(F.col(at) / width))
    met = laid.join(placed, [*keys, "__bucket"])
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bucket")


def angle_close(value: Column, wanted: Column, tolerance: float) -> Column:
    """Whether two headings differ by no more than the tolerance, around the circle."""
    return F.abs(F.pmod(value - wanted + 180.0, F.lit(360.0)) - 180.0) <= tolerance


def change_echo(
    spoken: DataFrame, snapshots: DataFrame, *, before: int = 10, after: int = 60, altitude: float = 100.0, heading: float = 5.0
) -> DataFrame:
    """J7, one row per transmission: which aircraft changed its selected value to a spoken number around the time it was said.

    spoken: id, t, numbers array<struct<kind, value>>. snapshots: t, hex, on_ground, selected_altitude, selected_heading (a row per aircraft).
    Result: id, status (no_numbers, no_snapshots, none, match, ambiguous), hex, delay, candidates.
    A snapshot is the set of rows of one t; the baseline is the last snapshot at or before t - before, as a whole, and an aircraft must be in it
    with a known value that was not yet close.
    """
    times = snapshots.select(F.col("t").alias("snap_t")).distinct()
    span = before + after
    # Of each transmission the last snapshot at or before its window's start, which may lie far back, and the first one after: as-of, over times only.
    asked = spoken.select("id", "t", "numbers", (F.col("t") - before).alias("__limit"))
    tagged = times.select(F.lit(None).cast(spoken.schema["id"].dataType).alias("id"), F.col("snap_t").alias("at"), "snap_t", F.lit(0).alias("side")).unionByName(
        asked.select("id", F.col("__limit").alias("at"), F.lit(None).cast("long").alias("snap_t"), F.lit(1).alias("side"))
    )
    # Blocks of the time axis; a block without a snapshot takes the last one of earlier blocks, and the first one of later blocks.
    tagged = tagged.withColumn("block", F.floor(F.col("at") / (span * 8)))
    ends = tagged.groupBy("block").agg(F.min("snap_t").alias("begin"), F.max("snap_t").alias("end"))
    carry = ends.select(
        "block", F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.last("begin", ignorenulls=True).over(Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("to_come"),
    )
    last = lambda *order: F.last("snap_t", ignorenulls=True).over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    base = tagged.withColumn("own", last("at", "side")).withColumn("next", last(F.col("at").desc(), F.col("side").desc())).filter("side = 1").join(carry, "block")
    base = base.select("id", F.coalesce("own", "carried").alias("base_t"), F.coalesce("next", "to_come").alias("next_t"))
    asked = asked.join(base, "id", "left").withColumn("later", F.when(F.col("next_t") <= F.col("t") + after, True))
    # A change is an aircraft's value in a baseline and another one of its in a snapshot that some transmission with that baseline looks at.
    bucket = lambda t: F.floor(t / span)
    heard = asked.filter("later AND base_t IS NOT NULL AND size(numbers) > 0")
    bases = heard.groupBy("base_t").agg((F.min("t") - before).alias("from"), (F.max("t") + after).alias("to"))
    bases = bases.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("from")), bucket(F.col("to"))))).join(times.select(bucket(F.col("snap_t")).alias("__bucket")).distinct(), "__bucket", "left_semi")
    old = snapshots.select(F.col("t").alias("base_t"), "hex", F.col("selected_altitude").alias("old_altitude"), F.col("selected_heading").alias("old_heading")).join(bases, "base_t")
    new = snapshots.filter(~F.coalesce(F.col("on_ground"), F.lit(False))).select(F.col("t").alias("snap_t"), "hex", "selected_altitude", "selected_heading", bucket(F.col("t")).alias("__bucket"))
    met = new.join(old, ["hex", "__bucket"]).filter((F.col("snap_t") > F.col("from")) & (F.col("snap_t") <= F.col("to")))
    change = lambda a, kind: F.struct(F.lit(a).alias("is_altitude"), F.col(f"old_{kind}").cast("double").alias("old"), F.col(f"selected_{kind}").cast("double").alias("new"))
    changes = met.select("base_t", "hex", "snap_t", F.inline(F.array(change(True, "altitude"), change(False, "heading")))).filter("old <> new")
    # A change and a number meet by the baseline and by the number's size, in steps of two tolerances: a number lies in at most three of them.
    rise, sectors = max(2 * altitude, 1.0), max(1, int(360 // max(2 * heading, 1.0)))
    step = lambda v, is_altitude: F.when(is_altitude, F.floor(v / rise)).otherwise(F.floor(F.pmod(v, F.lit(360.0)) * (sectors / 360.0)) % sectors)
    is_altitude, wanted = F.coalesce(F.col("number.kind") == "altitude", F.lit(False)), F.col("number.value").cast("double")
    edge = F.when(F.col("is_altitude"), altitude).otherwise(heading) * (1 + 1e-9) + F.abs("wanted") * 1e-9
    numbers = heard.select("id", "t", "base_t", F.posexplode("numbers").alias("pos", "number")).select("id", "t", "base_t", "pos", is_altitude.alias("is_altitude"), wanted.alias("wanted"))
    steps = F.array_distinct(F.array(*[step(v, F.col("is_altitude")) for v in (F.col("wanted") - edge, F.col("wanted"), F.col("wanted") + edge)]))
    numbers = numbers.filter("wanted IS NOT NULL").withColumn("__step", F.explode(steps))
    close = lambda v: F.when(F.col("is_altitude"), F.abs(v - F.col("wanted")) <= altitude).otherwise(angle_close(v, F.col("wanted"), heading))
    inside = (F.col("snap_t") > F.col("t") - before) & (F.col("snap_t") <= F.col("t") + after)
    seen = numbers.join(changes.withColumn("__step", step(F.col("new"), F.col("is_altitude"))), ["base_t", "is_altitude", "__step"]).filter(inside & close(F.col("new")) & ~close(F.col("old")))
    hits = seen.groupBy("id").agg(F.array_sort(F.collect_set("hex")).alias("candidates"), F.min(F.struct("hex", "pos", (F.col("snap_t") - F.col("t")).alias("delay"))).alias("first"))
    hits = hits.select("id", "candidates", F.col("first.hex").alias("__hex"), F.col("first.delay").alias("__delay"))
    joined = asked.join(hits, "id", "left")
    n = F.size("candidates")
    status = (
        F.when(F.coalesce(F.size("numbers"), F.lit(0)) <= 0, "no_numbers").when(F.col("base_t").isNull() | F.col("later").isNull(), "no_snapshots")
        .when(F.col("candidates").isNull(), "none").when(n == 1, "match").otherwise("ambiguous")
    )
    is_match = status == "match"
    none = F.array().cast("array<string>")
    return joined.select(
        "id", status.alias("status"), F.when(is_match, F.col("__hex")).alias("hex"), F.when(is_match, F.col("__delay")).alias("delay"),
        F.when(status.isin("match", "ambiguous"), F.col("candidates")).otherwise(none).alias("candidates"),
    )
