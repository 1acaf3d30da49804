"""The vessel registry: merging observations (R2 in batch), ranking (W1-W4), names (A1, J2), lookups (J1, J17, J18), duplicates.

Observations carry ``arrival``, their order of processing. Everything is a pure function from DataFrames to the new state of the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import plausibility

#: Characters that mark a name as a decoding artefact.
ARTEFACT = "@#?\\<>[]$%=\"^*;:"


def looks_like_artefact(name: Column) -> Column:
    return F.coalesce(F.translate(name, ARTEFACT, "") != name, F.lit(False))


def merge_observations(
    observations: DataFrame, key: str, static: list[str], position: list[str], when: str, arrival: str, name: str = "name"
) -> DataFrame:
    """R2: one row per key. Each static field keeps its last processed non-empty value; the position fields move together and the newest
    ``when`` wins (on a tie the later arrival), late static data still counts. Keys that never had a name are left out (pending)."""
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    fixed = [F.max_by(F.col(c), F.when(filled(c).isNotNull(), F.col(arrival))).alias(c) for c in static]
    known = F.lit(True)
    for c in position[:2]:
        known = known & F.col(c).isNotNull()
    moved = F.max_by(F.struct(*position, F.col(when).alias("position_at")), F.when(known, F.struct(when, arrival)))
    merged = observations.groupBy(key).agg(*fixed, moved.alias("__moved"), F.max(when).alias("last_seen"))
    out = merged.select(key, *static, *[F.col(f"__moved.{c}").alias(c) for c in position], F.col("__moved.position_at").alias("position_at"), "last_seen")
    return out.filter(F.nullif(F.trim(F.col(name)), F.lit("")).isNotNull())


def pending(observations: DataFrame, key: str, name: str, arrival: str, most: int = 2000) -> DataFrame:
    """Keys still waiting for a name: the ``most`` that were touched last (a bounded waiting room, as specified; of a stream see streaming.registry)."""
    waiting = observations.groupBy(key).agg(F.max(arrival).alias("touched"), F.max(F.nullif(F.trim(F.col(name)), F.lit(""))).alias("__name"))
    return waiting.filter("__name IS NULL").select(key, "touched").orderBy(F.col("touched").desc(), key).limit(most)


def best_claim(entries: DataFrame, key: str, name: str, static: list[str], ordinal: str) -> DataFrame:
    """Of rows that claim one key, artefact names last, then the fuller record, then file order."""
    fullness = sum((F.when(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("0")) == "0", 0).otherwise(1) for c in static), F.lit(0))
    rank = F.struct(looks_like_artefact(F.col(name)).cast("int"), -fullness, F.col(ordinal))
    row = F.struct(*entries.columns)
    return entries.groupBy(key).agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def candidate_order(in_scope: Column, km: Column, type_name: Column, position_at: Column) -> list[Column]:
    """In scope first, then nearest (unknown last), then the likelier type, then the newer fix."""
    return [(~in_scope).cast("int"), km.asc_nulls_last(), -plausibility(type_name), position_at.desc_nulls_last()]


def ranked_by_name(entries: DataFrame, name: str, order: list, tie: str) -> DataFrame:
    """Entries with rank, 1 the best claim to the upper-cased, trimmed name. A name with very many ships is one sort within its own window."""
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(F.upper(F.trim(F.col(name)))).orderBy(*order, tie)))


def best_per_name(entries: DataFrame, name: str, order: list, tie: str) -> DataFrame:
    """Spark keeps one row per name before it shuffles (a window group limit)."""
    return ranked_by_name(entries, name, order, tie).filter("rank = 1").drop("rank")


def duplicate_names(entries: DataFrame, name: str, key: str) -> DataFrame:
    """A1: names that more than one key bears, with their keys."""
    shared = entries.groupBy(F.upper(F.trim(F.col(name))).alias("shared_name")).agg(F.collect_set(key).alias("keys"))
    return shared.filter(F.size("keys") > 1).select("shared_name", F.array_sort("keys").alias("keys"))


def match_key(asked: DataFrame, registry: DataFrame, left: str, right: str) -> DataFrame:
    """Equi lookup on the upper-cased, trimmed key; no match gives nulls."""
    lookup = registry.withColumn("__key", F.upper(F.trim(F.col(right))))
    return asked.withColumn("__key", F.upper(F.trim(F.col(left)))).join(lookup, "__key", "left").drop("__key")


def unique_suffix(asked: DataFrame, registry: DataFrame, suffix: str, key: str, least: int = 3) -> DataFrame:
    """Suffixes of ``least`` characters or more with the one key that ends in them; null when none or several do.

    Suffixes meet keys by equality: each key offers its tails of the lengths that are asked for (a handful, taken from the data).
    """
    wanted = asked.select(F.upper(F.col(suffix)).alias("suffix")).filter(F.length("suffix") >= least).distinct()
    lengths = F.broadcast(wanted.agg(F.collect_set(F.length("suffix")).alias("__lengths")))  # one row
    tails = registry.select(F.upper(F.col(key)).alias("key")).filter(F.length("key") >= least).distinct().crossJoin(lengths)
    tails = tails.select("key", F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length("key")), lambda n: F.right(F.col("key"), n))).alias("suffix"))
    one = tails.join(wanted, "suffix").groupBy("suffix").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    return wanted.join(one.filter("n = 1").select("suffix", "key"), "suffix", "left")


def unique_pattern(asked: DataFrame, registry: DataFrame, pattern: str, key: str) -> DataFrame:
    """Patterns in which '.' is one unknown character, with the one key they fit; null when none or several do.

    A pattern and a key meet by equality: each key offers itself under every different mask of unknown places that patterns of its length have (a handful,
    taken from the data, where patterns have a gap or two; never more than there are patterns).
    """
    wanted = asked.select(F.upper(F.col(pattern)).alias("pattern")).filter("pattern IS NOT NULL").distinct()
    masks = wanted.select(F.regexp_replace("pattern", r"[^.]", "#").alias("__mask")).distinct().withColumn("__length", F.length("__mask"))
    masks = masks.select("__length", F.filter(F.sequence(F.lit(1), F.greatest("__length", F.lit(1))), lambda i: F.substring("__mask", i, F.lit(1)) == ".").alias("__gaps"))
    keys = registry.select(F.upper(F.col(key)).alias("key")).filter("key <> ''").distinct().withColumn("__length", F.length("key"))
    offered = keys.join(masks, "__length").select("key", F.aggregate("__gaps", F.col("key"), lambda s, i: F.overlay(s, F.lit("."), i, F.lit(1))).alias("pattern"))
    one = offered.join(wanted, "pattern").groupBy("pattern").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").select("pattern", "key")
    return asked.select(F.upper(F.col(pattern)).alias("pattern")).distinct().join(one, "pattern", "left")
