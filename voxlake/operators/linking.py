"""Who said it: freshness (F4-F6), call signs and names in order of trust (J11, P10), candidates of a window (J20-J22, F11), renaming of earlier guesses
(J27, X8), lookups (J8, J31, X38, X43), replays (J33), free chunks (U4), snapshots (S33, O9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import any_similar, indel_ratio, token_set_ratio
from ..functions.text import callsign_supported, hint_probes, partial_pattern, phonetic_probes, spelled_runs
from ..scratch import written
from . import registry, temporal

#: Least length of a spelt call sign (J20), least score of a name that corroborates one.
RUN_LENGTH, NAME_SCORE = 4, 60.0


def is_recent(last_seen: Column, reference: Column, minutes: int) -> Column:
    """Seen within so many minutes before the reference clock (the last good poll), that moment included. An unknown time is not recent;
    0 minutes or fewer mean no bound."""
    return F.lit(True) if minutes <= 0 else F.coalesce(last_seen >= reference - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))


def fresh_pool(entries: DataFrame, last_seen: str, reference: Column, minutes: int) -> DataFrame:
    """entries recent enough to be matched."""
    return entries.filter(is_recent(F.col(last_seen), reference, minutes))


def enriched(rows: DataFrame, ships: DataFrame) -> DataFrame:
    """Rows (id, callsign, vessel, text) with the ship of ships (mmsi, name, callsign) they mean: by call sign where the text supports it, else by name, else by call
    sign where there is no text to check. One ship per call sign and name is expected (best_per_name); a spoken call sign is never overwritten."""
    key = lambda c: F.upper(F.trim(F.col(c)))
    by = lambda c, p: ships.filter(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull()).groupBy(key(c).alias(f"__{p}")).agg(F.min(F.struct("mmsi", "name", "callsign")).alias(p))
    spoken = F.nullif(F.trim("callsign"), F.lit(""))
    bare = F.coalesce(F.col("text"), F.lit("")) == ""
    # Rows without a key find nothing: they are dealt by their ids, else one task would get them all.
    dealt = lambda c: F.when(key(c).isNull(), F.xxhash64("id")).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    called, named = by("callsign", "called").withColumn("__called_deal", none), by("name", "named").withColumn("__named_deal", none)
    joined = rows.join(called, (key("callsign") == F.col("__called")) & (dealt("callsign") == F.col("__called_deal")), "left")
    joined = joined.join(named, (key("vessel") == F.col("__named")) & (dealt("vessel") == F.col("__named_deal")), "left")
    verified = F.coalesce(spoken.isNotNull() & callsign_supported(F.col("callsign"), F.col("text")), F.lit(False))
    choice = (
        F.when(verified & F.col("called").isNotNull(), F.struct(F.col("called").alias("ship"), F.lit("callsign").alias("method")))
        .when(F.col("named").isNotNull(), F.struct(F.col("named").alias("ship"), F.lit("name").alias("method")))
        .when(bare & F.col("called").isNotNull(), F.struct(F.col("called").alias("ship"), F.lit("callsign").alias("method")))
    )
    found = joined.withColumn("__found", choice)
    return found.select(
        "id", F.coalesce("__found.ship.name", "vessel").alias("vessel"), F.col("__found.ship.mmsi").alias("mmsi"), F.coalesce(spoken, F.col("__found.ship.callsign")).alias("callsign"),
        F.col("__found.method").alias("match_method"), "text",
    )


def spoken_callsigns(chunks: DataFrame, ships: DataFrame, window: str) -> DataFrame:
    """Window and ship for each whole run of spelt characters (four or more, not digits only) that is a call sign."""
    runs = chunks.select(window, F.explode(spelled_runs(F.col("text"))).alias("run")).filter((F.length("run") >= RUN_LENGTH) & ~F.col("run").rlike("^[0-9]+$")).distinct()
    keyed = ships.withColumn("run", F.upper(F.trim("callsign"))).filter("mmsi IS NOT NULL")
    return runs.join(keyed, "run").drop("run").dropDuplicates([window, "mmsi"])


def corroborated(pairs: DataFrame, chunks: DataFrame, window: str, name: str, cutoff: float = NAME_SCORE) -> DataFrame:
    """the pairs (window, name) of which some probe of the window's texts resembles the name."""
    names = pairs.select(window, F.col(name), F.upper(F.col(name)).alias("__upper")).distinct()
    said = chunks.join(names.select(window).distinct(), window, "left_semi").select(window, hint_probes(F.col("text")).alias("__probes"))
    near = said.join(names, window).filter(any_similar(F.col("__probes"), F.col("__upper"), cutoff))
    return pairs.join(near.select(window, name).distinct(), [window, name], "left_semi")


def partial_callsigns(chunks: DataFrame, ships: DataFrame, window: str) -> DataFrame:
    """Window and ship where a spelt pattern with gaps (J17), else a spelt tail (J18), is borne by one ship only and its name was said, about,
    anywhere in the window (F11)."""
    known = ships.filter("callsign IS NOT NULL AND mmsi IS NOT NULL").select(F.upper(F.trim("callsign")).alias("callsign"), "mmsi", "name")
    runs = F.filter(spelled_runs(F.col("text")), lambda r: (F.length(r) >= RUN_LENGTH) & ~r.rlike("^[0-9]+$"))
    # Read once, asked for often.
    read = written(chunks.select(window, F.upper(partial_pattern(F.col("text"))).alias("pattern"), F.array_union(phonetic_probes(F.col("text")), runs).alias("tails")), "spelt")
    gapped = read.select(window, "pattern").filter("pattern IS NOT NULL").distinct()
    fits = registry.unique_pattern(gapped, known, "pattern", "callsign").filter("key IS NOT NULL").withColumnRenamed("key", "callsign")
    by_pattern = gapped.join(fits, "pattern").select(window, "callsign", F.col("pattern").alias("partial_pattern"), F.lit(0).alias("__rank"))
    tails = read.select(window, F.explode("tails").alias("suffix")).distinct()
    one = registry.unique_suffix(tails, known, "suffix", "callsign").filter("key IS NOT NULL").withColumnRenamed("key", "callsign")
    whole = known.select(F.col("callsign").alias("suffix"))  # a whole call sign is J20's
    by_tail = tails.join(one, "suffix").join(whole, "suffix", "left_anti").select(window, "callsign", F.col("suffix").alias("partial_pattern"), F.lit(1).alias("__rank"))
    met = corroborated(by_pattern.unionByName(by_tail).join(known, "callsign"), chunks, window, "name")
    best = met.groupBy(window, "mmsi").agg(F.min_by(F.struct("name", "partial_pattern"), F.struct("__rank", "partial_pattern", "name")).alias("best"))
    return best.select(window, "mmsi", "best.name", "best.partial_pattern")


def live_candidates(chunks: DataFrame, ships: DataFrame, window: str, reference: Column, minutes: int = 360) -> DataFrame:
    """Ships that single transmissions of the window were matched to, if seen recently enough."""
    wanted = chunks.filter("live_mmsi IS NOT NULL").select(window, F.col("live_mmsi").alias("mmsi")).distinct()
    return wanted.join(ships, "mmsi").filter(is_recent(F.col("last_seen"), reference, minutes))


def renamed_guesses(entries: DataFrame, channel: str, at: str, ttl: int = 120, cutoff: float = 50.0) -> DataFrame:
    """For each named entry the newest earlier guess (fuzzy) of another, similar name less than ``ttl`` seconds before; guess id and the name it
    should bear. Entries meet in buckets of ``ttl``."""
    bucket = F.floor(F.col(at) / ttl)
    new = entries.filter("vessel IS NOT NULL").select(channel, F.col("id").alias("new_id"), F.col("vessel").alias("new_vessel"), F.col(at).alias("new_at"), F.explode(F.array(bucket, bucket - 1)).alias("__bucket"))
    old = entries.filter("fuzzy AND vessel IS NOT NULL").select(channel, "id", "vessel", at, bucket.alias("__bucket"))
    near = new.join(old, [channel, "__bucket"]).filter((F.col(at) < F.col("new_at")) & (F.col(at) > F.col("new_at") - ttl) & (F.lower("vessel") != F.lower("new_vessel")))
    near = near.filter(token_set_ratio(F.lower("vessel"), F.lower("new_vessel")) >= cutoff)
    return near.groupBy("new_id").agg(F.max_by(F.struct("id", "vessel", "new_vessel"), F.struct(at, "id")).alias("g")).select("new_id", "g.*")


def comments_of(ids: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """The comments of a page of ids; ids without one are absent."""
    return comments.join(ids.select(key).distinct(), key, "left_semi")


def conversations_of(records: DataFrame, mmsi: Column) -> DataFrame:
    """By number, never by name; newest first."""
    return records.filter(F.col("mmsi") == mmsi).orderBy(F.col("start").desc())


def unassigned(valid: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """What nobody claimed."""
    return valid.join(seen.select(*keys).distinct(), keys, "left_anti")


def replay_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value a replay changed: removed, added or replaced."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    change = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("replaced")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def nearest_snapshot(asked: DataFrame, snapshots: DataFrame, key: str, at: str, most: int = 30) -> DataFrame:
    """For each row the snapshot nearest in time, at most so many seconds away."""
    return temporal.nearest_within(asked, snapshots, key, at, most, at)


def sightings(snapshots: DataFrame) -> DataFrame:
    """Per call sign the first and last snapshot with it and their number."""
    rows = snapshots.select("t", F.explode("aircraft").alias("a")).select("t", F.trim("a.flight").alias("flight")).filter("flight <> ''")
    return rows.groupBy("flight").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def find_vessels(ships: DataFrame, query: str, most: int = 12, cutoff: float = 65.0) -> DataFrame:
    """Ships whose name contains the query, else those that resemble it; a dozen at most, which is the feature."""
    q = query.strip().upper()
    scored = ships.withColumn("score", indel_ratio(F.lit(q), F.upper(F.coalesce("name", F.lit(""))))).withColumn("holds", F.upper(F.coalesce("name", F.lit(""))).contains(q))
    some = scored.agg(F.max("holds").alias("any_holds"))
    pool = scored.crossJoin(F.broadcast(some)).filter(F.when(F.col("any_holds"), F.col("holds")).otherwise(F.col("score") >= cutoff))
    rank = F.when(F.col("any_holds"), F.lit(0.0)).otherwise(-F.col("score"))
    return (pool if q else pool.limit(0)).orderBy(rank, "name", "mmsi").limit(most).drop("holds", "any_holds")
