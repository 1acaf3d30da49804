"""Replays: the registry as it stood at a moment, candidates of labelled windows under several settings (M17), the resolver's answers to them, and chunks under filter settings.

The speech decoder, the extractor and the resolver are outside: their answers are tables. Everything around them runs once for all arms, the switches being columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.display import vessel_tag
from ..functions.text import prompt_echo
from . import candidates, conversations, linking

STATIC = ("name", "callsign", "type", "destination")


@dataclass(frozen=True)
class Arm:
    """Settings of a replay: minutes that a candidate may be old (0: no bound), and whether live matches and partial call signs count."""

    max_age_min: int = 0
    live: bool = True
    partial: bool = True


def registry_as_of(observations: DataFrame, asked: DataFrame, static: tuple[str, ...] = STATIC) -> DataFrame:
    """asked (label, mmsi, reference_at) with the vessel's static fields, position, position_at and last_seen as observations made up to reference_at, that moment included, left them.

    observations: mmsi, arrival, observed_at, latitude, longitude and the static fields. Static fields keep their last value that isn't empty, positions move as a pair. Both
    sides go through one window per vessel in the order of time: work in proportion to rows, however many labels ask for a vessel. Unknown vessels give nulls.
    """
    fixed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    seen = observations.filter("mmsi IS NOT NULL AND observed_at IS NOT NULL").select(
        "mmsi", F.col("observed_at").alias("at"), F.lit(0).alias("side"), "arrival", F.lit(None).cast(asked.schema["label"].dataType).alias("label"),
        *[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c) for c in static], F.when(fixed, F.struct("latitude", "longitude", F.col("observed_at").alias("position_at"))).alias("fix"),
    )
    points = asked.select("mmsi", F.col("reference_at").alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("arrival"), "label")
    both = seen.unionByName(points, allowMissingColumns=True)
    upto = Window.partitionBy("mmsi").orderBy("at", "side", "arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    state = both.select("label", "mmsi", "at", "side", *[last(c).alias(c) for c in static], last("fix").alias("fix"), F.max(F.when(F.col("side") == 0, F.col("at"))).over(upto).alias("last_seen"))
    return state.filter("side = 1").select("label", "mmsi", F.col("at").alias("reference_at"), *static, "fix.latitude", "fix.longitude", "fix.position_at", "last_seen")


def replay_candidates(windows: DataFrame, observations: DataFrame, arms: dict[str, Arm]) -> DataFrame:
    """Arm, label, mmsi, name, callsign, source, last_seen: whom the chunks of a labelled window may mean, by the registry as of the label's start.

    windows: rows of rebuilt_windows (label, reference_at, text, live_mmsi). A ship is offered by a call sign spoken whole or in part, or as the live match of a chunk; it counts if it
    bore that call sign then, and was heard of by then, recently enough for the arm.
    """
    said = windows.select(F.col("label").alias("window"), "text", "live_mmsi")
    borne = observations.filter("mmsi IS NOT NULL").select("mmsi", F.trim("name").alias("name"), F.upper(F.trim("callsign")).alias("callsign"))
    known = borne.groupBy("mmsi", "callsign").agg(F.max("name").alias("name"))
    named = borne.groupBy("mmsi").agg(F.max("name").alias("any_name"))
    known = known.join(named, "mmsi").select("mmsi", F.coalesce("name", "any_name").alias("name"), "callsign").filter("callsign <> ''")
    spoken = linking.spoken_callsigns(said, known, "window").select("window", "mmsi", "callsign")
    partial = linking.partial_callsigns(said, known, "window").join(known.select("mmsi", "callsign"), "mmsi").select("window", "mmsi", "callsign")
    live = said.filter("live_mmsi IS NOT NULL").select("window", F.col("live_mmsi").alias("mmsi"), F.lit(None).cast("string").alias("callsign")).distinct()
    offered = spoken.withColumn("source", F.lit("spoken_callsign")).unionByName(partial.withColumn("source", F.lit("partial_callsign"))).unionByName(live.withColumn("source", F.lit("live_match")))
    starts = windows.select(F.col("label").alias("window"), "reference_at").distinct()
    asked = offered.select("window", "mmsi").distinct().join(starts, "window").withColumnRenamed("window", "label")
    then = registry_as_of(observations, asked)
    met = offered.withColumnRenamed("callsign", "by").join(then.withColumnRenamed("label", "window"), ["window", "mmsi"])
    met = met.filter(F.col("last_seen").isNotNull() & (F.col("by").isNull() | (F.col("by") == F.upper(F.trim("callsign")))))
    told = F.array(*[F.struct(F.lit(n).alias("arm"), F.lit(a.max_age_min).alias("age"), F.lit(a.live).alias("live"), F.lit(a.partial).alias("partial")) for n, a in arms.items()])
    every = met.withColumn("a", F.explode(told)).filter(
        ((F.col("a.age") <= 0) | (F.unix_timestamp("last_seen") >= F.unix_timestamp("reference_at") - F.col("a.age") * 60))
        & (F.col("a.live") | (F.col("source") != "live_match")) & (F.col("a.partial") | (F.col("source") != "partial_callsign"))
    )
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(candidates.PRECEDENCE) for x in (s, i)])[F.col("source")]
    best = every.groupBy(F.col("a.arm").alias("arm"), F.col("window").alias("label"), "mmsi").agg(F.min(F.struct(rank.alias("rank"), "source", "name", "callsign", "last_seen")).alias("b"))
    return best.select("arm", "label", "mmsi", "b.name", "b.callsign", "b.source", "b.last_seen")


def resolved_again(windows: DataFrame, offered: DataFrame, replies: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """The resolver's replies (arm, label, reply) to each arm's windows as exchanges: window ('arm|label'), exchange, vessel, turns, failed. offered: rows of replay_candidates."""
    key = F.concat_ws("|", "arm", F.col("label").cast("string"))
    arms = replies.select("arm").unionByName(offered.select("arm")).distinct()  # a handful
    chunks = windows.crossJoin(F.broadcast(arms)).select(key.alias("window"), F.col("place").cast("long").alias("place"), "at", "text")
    chunks = chunks.select("window", F.xxhash64("window", "place").alias("id"), F.col("place").alias("time"), "text", "place")
    read = F.from_json("reply", conversations.REPLY)
    # A reply speaks of places; ids are unique over all windows.
    told = replies.select(key.alias("window"), read.alias("r"))
    placed = F.transform("r.exchanges", lambda e: F.struct(F.transform(e["chunk_ids"], lambda i: F.xxhash64("window", i.cast("long"))).alias("chunk_ids"), e["vessel"].alias("vessel")))
    renamed = told.select("window", F.when(F.col("r.exchanges").isNull(), "").otherwise(F.to_json(F.struct(placed.alias("exchanges")))).alias("reply"))
    names = offered.select(key.alias("window"), F.upper(F.trim("name")).alias("name")).filter("name IS NOT NULL").distinct()
    if rewritten is None:
        rewritten = chunks.select("window", F.lit(0).cast("long").alias("exchange"), "id", "text", F.lit(0).alias("n_changes")).limit(0)
    return conversations.resolved_windows(chunks.drop("place"), renamed, names, rewritten, "window")


def replayed_chunks(chunks: DataFrame, extracted: DataFrame, ships: DataFrame, prompt: Column, arms: dict[str, tuple[bool, bool]]) -> DataFrame:
    """Arm, id, time, channel, text, echo, vessel, mmsi, display of each chunk under an arm's (hints, echo) filters.

    chunks: id, time, channel, text. extracted: id, hints, vessel, callsign: what the extractor made of a text with and without the hint filter. ships: mmsi, name, callsign. With the echo
    filter a text that only echoes the prompt has no vessel and an empty display; everything else is enriched and displayed as it was live.
    """
    told = F.array(*[F.struct(F.lit(n).alias("arm"), F.lit(h).alias("hints"), F.lit(e).alias("filter")) for n, (h, e) in arms.items()])
    rows = chunks.withColumn("is_echo", F.coalesce(prompt_echo(F.col("text"), prompt), F.lit(False))).withColumn("a", F.explode(told)).select("*", "a.*").drop("a")
    rows = rows.withColumn("echo", F.col("filter") & F.col("is_echo")).join(extracted, ["id", "hints"], "left")
    key = F.struct("arm", "id")
    found = linking.enriched(rows.filter("NOT echo").select(key.alias("id"), "callsign", "vessel", "text"), ships)
    found = found.select(F.col("id.arm").alias("arm"), F.col("id.id").alias("id"), "vessel", "mmsi", "callsign")
    joined = rows.drop("vessel", "callsign", "hints", "filter", "is_echo").join(found, ["arm", "id"], "left")
    shown = F.when(F.col("echo"), "").otherwise(vessel_tag(F.col("vessel"), F.lit(None).cast("string"), F.col("mmsi"), F.col("callsign"), F.col("text")))
    return joined.select("arm", "id", "time", "channel", "text", "echo", "vessel", "mmsi", shown.alias("display"))


def replay_changes(replayed: DataFrame, before: str, after: str) -> DataFrame:
    """Chunks whose vessel or echo differ between two arms, with the kind of change: dropped, added, swapped, or an echo alone."""
    side = lambda arm, p: replayed.filter(F.col("arm") == arm).select("id", F.col("vessel").alias(f"{p}_vessel"), F.col("echo").alias(f"{p}_echo"))
    both = side(before, "before").join(side(after, "after"), "id")
    changed = both.filter(~F.col("before_vessel").eqNullSafe(F.col("after_vessel")) | (F.col("before_echo") != F.col("after_echo")))
    kind = (
        F.when(F.col("before_vessel").isNotNull() & F.col("after_vessel").isNull(), "dropped").when(F.col("before_vessel").isNull() & F.col("after_vessel").isNotNull(), "added")
        .when(F.col("before_vessel") != F.col("after_vessel"), "swapped").otherwise("echo")
    )
    return changed.withColumn("change", kind)
