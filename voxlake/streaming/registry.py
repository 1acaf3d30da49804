"""The registry as a stream of observations: merged per MMSI in keyed state, or as the versions of a table that also adopts, renames and forgets.

A vessel is held back until it has a name. Static fields keep the last processed non-empty value; the position moves as a group and the newest
observation wins, on a tie the later one. Late positions are ignored, late static data is not, so nothing is dropped by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import VersionedTable

STATIC = ("name", "callsign", "type", "imo", "length", "beam", "draught", "destination")
POSITION = ("latitude", "longitude", "sog", "cog", "heading")
_KINDS = {"type": "int", "imo": "long", "name": "string", "callsign": "string", "destination": "string"}
STATE = ", ".join(f"{c} {_KINDS.get(c, 'double')}" for c in STATIC + POSITION) + ", position_at timestamp, last_seen timestamp"
OUTPUT = f"mmsi string, {STATE}"


def _known(value) -> bool:
    return not (value is None or value is pd.NaT or value != value or isinstance(value, str) and not value.strip())


def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State update of one vessel: its rows of a micro-batch in the order of arrival."""
    names = STATIC + POSITION + ("position_at", "last_seen")
    held = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names)
    for row in pd.concat(list(batches)).sort_values("arrival").to_dict("records"):
        held.update({c: row[c] for c in STATIC if _known(row.get(c))})
        when = row["observed_at"]
        if _known(row["latitude"]) and _known(row["longitude"]) and _known(when) and (not _known(held["position_at"]) or when >= held["position_at"]):
            held.update({c: row[c] for c in POSITION}, position_at=when)
        if _known(when) and (not _known(held["last_seen"]) or when > held["last_seen"]):
            held["last_seen"] = when
    plain = {c: v if _known(v) else None for c, v in held.items()}
    plain |= {c: int(plain[c]) for c in ("type", "imo") if plain[c] is not None}
    state.update(tuple(plain[c] for c in names))
    if plain["name"]:
        yield pd.DataFrame([{"mmsi": key[0], **plain}])


def vessels(observations: DataFrame) -> DataFrame:
    """The current row of each named vessel, again whenever it changes (update mode)."""
    return observations.groupBy("mmsi").applyInPandasWithState(merge, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


#: Fixed value: vessels without a name that are kept waiting for one.
WAITING = 2000
ENTRY = f"mmsi string, {STATE}, touched timestamp"


def _text(column: str):
    return F.nullif(F.trim(column), F.lit(""))


def next_entries(entries: DataFrame, observations: DataFrame, most: int = WAITING) -> DataFrame:
    """The registry after a batch of observations (schemas.OBSERVATION), which are taken in the order of arrival.

    entries (ENTRY): vessels with a number and a name; vessels with a number that wait for a name; names without a number. A number that is named for the first time
    adopts an entry of that name without a number: of several in a batch the first. Then what waited under the number counts, then the observations: static fields keep the last
    value that isn't empty, positions go by their own time. A vessel bears its last name only. Of those that wait, the ones touched last stay, `most` of them.
    """
    seen = observations.withColumn("mmsi", _text("mmsi")).filter("mmsi IS NOT NULL")
    numbered, nameless = entries.filter("mmsi IS NOT NULL"), entries.filter("mmsi IS NULL")
    unknown = seen.join(numbered.filter(_text("name").isNotNull()).select("mmsi"), "mmsi", "left_anti")
    claims = unknown.filter(_text("name").isNotNull()).groupBy("mmsi").agg(F.min(F.struct("arrival", F.upper(F.trim("name")).alias("key"))).alias("c")).select("mmsi", "c.*")
    claims = claims.groupBy("key").agg(F.min(F.struct("arrival", "mmsi")).alias("c")).select("key", F.col("c.mmsi").alias("claimed"))
    by_name = nameless.withColumn("key", F.upper(_text("name")))
    adopted = by_name.join(claims, "key").drop("key", "mmsi").withColumnRenamed("claimed", "mmsi")
    rest = by_name.join(claims, "key", "left_anti").drop("key")
    fields = [*STATIC, *POSITION]
    row = lambda df, place, at, last: df.select("mmsi", place.alias("place"), *fields, at.alias("at"), last.alias("last"), F.col("touched"))
    old = lambda df, n: row(df, F.lit(n).cast("long"), F.col("position_at"), F.col("last_seen"))
    new = row(seen.withColumn("touched", F.col("observed_at")), F.col("arrival"), F.col("observed_at"), F.col("observed_at"))
    every = old(adopted, -2**62).unionByName(old(numbered, -2**61)).unionByName(new)
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    static = [F.max_by(F.col(c), F.when(filled(c).isNotNull(), F.col("place"))).alias(c) for c in STATIC]
    fixed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("at").isNotNull()
    moved = F.max_by(F.struct(*POSITION, F.col("at").alias("position_at")), F.when(fixed, F.struct("at", "place")))
    merged = every.groupBy("mmsi").agg(*static, moved.alias("m"), F.max("last").alias("last_seen"), F.max_by("touched", "place").alias("touched"))
    merged = merged.select("mmsi", *STATIC, *[F.col(f"m.{c}").alias(c) for c in POSITION], F.col("m.position_at").alias("position_at"), "last_seen", "touched")
    named, waiting = merged.filter(_text("name").isNotNull()), merged.filter(_text("name").isNull())
    kept = waiting.orderBy(F.col("touched").desc_nulls_last(), F.desc("mmsi")).limit(most)
    return named.unionByName(kept).unionByName(rest.select(*named.columns))


def registry_sink(path: str, most: int = WAITING):
    """R1 for foreachBatch: each batch makes the next version of the table at path; a batch that is run again makes the same version from the one before it."""
    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        entries = table.read(before=number + 1)
        if entries is None:
            entries = batch.sparkSession.createDataFrame([], ENTRY)
        table.publish(next_entries(entries, batch, most), number + 1)

    return write


def load_registry(path: str, rows: DataFrame) -> None:
    """The entries of a saved cache as the table's first version. rows: ENTRY; touched may be null."""
    VersionedTable(rows.sparkSession, path).publish(rows, 0)
