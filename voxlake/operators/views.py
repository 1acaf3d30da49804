"""Read side: paging and search (F13-F15, O1), labels and live-match states (P4-P6), strips (A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import with_ship_type


def wildcard(text: str, whole: bool = False) -> str:
    """a search pattern with '?' and '*' as a regular expression; everything else is literal. Search, unless whole."""
    special = "\\.[]{}()+-^$|"
    body = "".join({"?": ".", "*": ".*"}.get(ch, f"\\{ch}" if ch in special else ch) for ch in text)
    return f"(?is)^{body}$" if whole else f"(?is){body}"


def haystack(*fields: Column) -> Column:
    """what a text search looks through."""
    return F.lower(F.concat_ws(" ", *fields))


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """O1: a stable page; the limit is clamped to 1..200, the offset to 0 or more. The page is the feature."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def vessel_search(entries: DataFrame, text: str | None = None, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of vessels (mmsi, name, callsign, type, destination, draught, last_seen, source), last heard first and never heard last, with the type's full reading, whether
    the name is borne by another entry too (of all entries, found or not), and the total of all found. text: a part of number, name, call sign or destination; '?' and '*' are wildcards."""
    found = entries
    if text:
        needle = text.strip().lower()
        fields = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("mmsi", "name", "callsign", "destination")]
        fits = [f.rlike(wildcard(needle)) if set(needle) & set("?*") else f.contains(needle) for f in fields]
        found = found.filter(fits[0] | fits[1] | fits[2] | fits[3])
    order = [F.coalesce(F.col("last_seen").cast("string"), F.lit("")).desc(), F.col("mmsi").asc_nulls_first(), "name"]
    rows = page(found, order, limit, offset).withColumn("__name", F.nullif(F.upper(F.trim("name")), F.lit("")))
    total = found.agg(F.count("*").alias("total"))  # one row
    # A page has 200 names at most: only their bearers are counted.
    names = F.broadcast(rows.select("__name").filter("__name IS NOT NULL").distinct())
    borne = entries.select(F.upper(F.trim("name")).alias("__name")).join(names, "__name").groupBy("__name").agg((F.count("*") > 1).alias("shared"))
    read = with_ship_type(rows.join(F.broadcast(borne), "__name", "left"), "type").withColumnRenamed("type_reading", "type_detail")
    told = ("mmsi", "name", "callsign", "type", "type_detail", "destination", "draught", "last_seen", "source")
    return read.crossJoin(F.broadcast(total)).select(*told, F.coalesce("shared", F.lit(False)).alias("name_shared"), "total")


def age_hours(start: Column, seen: Column) -> Column:
    """Never negative, null where a time is unknown."""
    hours = (start.cast("double") - seen.cast("double")) / 3600
    return F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours))


def live_match_state(vessel: Column, mmsi: Column, age: Column, bound: float) -> Column:
    """P5."""
    return (
        F.when(F.coalesce(vessel, F.lit("")) == "", None).when(F.coalesce(mmsi, F.lit("")) == "", "heard-only").when(age.isNull(), "ais-matched")
        .when(age <= bound, "ais-confirmed").otherwise("ais-stale")
    )


def label(vessel: Column, mmsi: Column) -> Column:
    """Never the bare name where a number is known; empty is unknown."""
    name, number = F.nullif(vessel, F.lit("")), F.nullif(mmsi, F.lit(""))
    return F.coalesce(F.concat(name, F.lit(" ("), number, F.lit(")")), name, number, F.lit("unidentified"))


def key_kind(key: Column) -> Column:
    """P19."""
    return F.when(key == "unassigned", "unassigned").when(key == "review", "review").when(key.startswith("heard:"), "unknown").otherwise("flight")


def strips(rows: DataFrame, key: str, at: str, order: str, state: str, moved: str, since: Column | None = None) -> DataFrame:
    """Per key count, last time and last known state; a moved row lends only its move's state (X40). With since, only live keys."""
    lent = F.when(F.col(moved).isNotNull(), F.col(moved)).otherwise(F.col(state))
    found = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.max(at).alias("last_at"), F.max_by(lent, F.when(lent.isNotNull(), F.struct(F.col(at), F.col(order)))).alias("state")
    )
    return found.filter(F.col("last_at") >= since) if since is not None else found


def combine_clues(candidate: Column, call_hex: Column, echo_hex: Column) -> Column:
    """Kind, key and badge of a transmission from what was heard and what was seen."""
    made = lambda kind, key, badge: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(badge).alias("badge"))
    heard = F.concat(F.lit("heard:"), F.substring(F.regexp_replace(F.upper(candidate), "[^A-Z0-9]", ""), 1, 12))
    both = call_hex.isNotNull() & echo_hex.isNotNull()
    return (
        F.when(candidate.isNotNull() & call_hex.isNull(), made("unknown", heard, "unknown")).when(both & (call_hex != echo_hex), made("review", F.lit("review"), "conflict"))
        .when(both, made("flight", call_hex, "confirmed")).when(call_hex.isNotNull(), made("flight", call_hex, "callsign"))
        .when(echo_hex.isNotNull(), made("flight", echo_hex, "echo")).otherwise(made("unassigned", F.lit("unassigned"), "none"))
    )


def move_targets(rows: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """For each row's time the other flight keys heard within so many seconds: an equi join on time buckets, summed per pair."""
    flights = rows.filter(key_kind(F.col(key)) == "flight")
    left = rows.select(F.col(key).alias("own"), F.col(at).alias("own_at"), F.explode(F.sequence(F.floor(F.col(at) / within) - 1, F.floor(F.col(at) / within) + 1)).alias("__bucket"))
    right = flights.select(F.col(key).alias("target"), F.col(at).alias("target_at"), F.floor(F.col(at) / within).alias("__bucket")).distinct()
    met = left.join(right, "__bucket").filter((F.abs(F.col("own_at") - F.col("target_at")) <= within) & (F.col("own") != F.col("target")))
    return met.groupBy("own", "target").agg(F.count("*").alias("n"))
