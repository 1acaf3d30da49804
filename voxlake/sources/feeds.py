"""Position feeds: two AIS shapes (S3-S5), aircraft snapshots (S7-S9, S16-S18), station heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_destination
from ..functions.time import gmt


def _filled(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _length(near: Column, far: Column) -> Column:
    """Two half dimensions together; 0 is unknown."""
    return F.nullif(F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)), F.lit(0)).cast("double")


def ais_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """S3: JSON frames of two message types as observations of one shape; frames of other types or without a number go (see unknown_frames)."""
    m = lines.select(F.from_json(column, schemas.POSITION_REPORT).alias("m")).select("m.*").filter(F.col("MetaData.MMSI").isNotNull())
    fix, ship = F.col("Message.PositionReport"), F.col("Message.ShipStaticData")
    static = m["MessageType"] == "ShipStaticData"
    name = F.nullif(F.trim(F.coalesce(ship["Name"], F.col("MetaData.ShipName"))), F.lit(""))
    return m.filter(F.col("MessageType").isin("PositionReport", "ShipStaticData")).select(
        F.col("MetaData.MMSI").cast("string").alias("mmsi"), name.alias("name"), F.nullif(F.trim(ship["CallSign"]), F.lit("")).alias("callsign"), ship["Type"].alias("type"),
        F.nullif(ship["ImoNumber"], F.lit(0)).alias("imo"), _length(ship["Dimension"]["A"], ship["Dimension"]["B"]).alias("length"),
        _length(ship["Dimension"]["C"], ship["Dimension"]["D"]).alias("beam"), F.nullif(ship["MaximumStaticDraught"], F.lit(0.0)).alias("draught"),
        clean_destination(ship["Destination"]).alias("destination"), F.when(~static, fix["Latitude"]).alias("latitude"), F.when(~static, fix["Longitude"]).alias("longitude"),
        fix["Sog"].alias("sog"), fix["Cog"].alias("cog"), fix["TrueHeading"].alias("heading"),
        F.try_to_timestamp(F.substring("MetaData.time_utc", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("observed_at"), F.lit("stream").alias("source"),
    )


def unknown_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """Frames that ais_messages can't use, for a dead-letter table."""
    kind = F.get_json_object(column, "$.MessageType")
    return lines.filter(kind.isNull() | ~kind.isin("PositionReport", "ShipStaticData") | F.get_json_object(column, "$.MetaData.MMSI").isNull())


def hub_ships(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One '[envelope, ships]' payload per row. A payload that reports an error or has another shape raises: it isn't an empty box."""
    envelope = F.get_json_object(column, "$[0].ERROR")
    ships = F.from_json(F.get_json_object(column, "$[1]"), f"ARRAY<STRUCT<{', '.join(f'{c.split()[0]}: STRING' for c in schemas.HUB_SHIP.split(', '))}>>")
    bad = envelope.isNull() | (F.lower(envelope) == "true") | ships.isNull()
    checked = payloads.select(F.when(bad, F.raise_error(F.lit("the hub's answer is an error or has no list of ships"))).otherwise(ships).alias("ships"))
    s = checked.select(F.inline("ships")).filter(_filled("MMSI").isNotNull())
    number = lambda c: F.col(c).try_cast("double")
    return s.select(
        _filled("MMSI").alias("mmsi"), _filled("NAME").alias("name"), _filled("CALLSIGN").alias("callsign"), F.col("TYPE").try_cast("int").alias("type"),
        F.nullif(F.col("IMO").try_cast("long"), F.lit(0)).alias("imo"), _length(F.col("A").try_cast("int"), F.col("B").try_cast("int")).alias("length"),
        _length(F.col("C").try_cast("int"), F.col("D").try_cast("int")).alias("beam"), F.nullif(number("DRAUGHT"), F.lit(0.0)).alias("draught"),
        clean_destination(F.col("DEST")).alias("destination"), number("LATITUDE").alias("latitude"), number("LONGITUDE").alias("longitude"), number("SOG").alias("sog"),
        number("COG").alias("cog"), number("HEADING").alias("heading"), gmt(F.col("TIME")).alias("observed_at"), F.lit("hub").alias("source"),
    )


def aircraft(snapshots: DataFrame) -> DataFrame:
    """Snapshots (t, aircraft) as rows: a hex is required, flights are trimmed, 'ground' becomes on_ground, the type
    code (t in a snapshot's list) type_code. A snapshot without a list raises."""
    listed = F.when(F.col("aircraft").isNull(), F.raise_error(F.lit("the snapshot has no list of aircraft"))).otherwise(F.col("aircraft"))
    rows = snapshots.select(F.col("t").alias("__t"), F.inline(listed)).withColumnsRenamed({"t": "type_code", "__t": "t"})
    rows = rows.filter(F.coalesce(F.trim("hex"), F.lit("")) != "")
    return rows.withColumns({
        "flight": _filled("flight"), "alt_ft": F.col("alt_baro").try_cast("double"), "on_ground": F.coalesce(F.col("alt_baro") == "ground", F.lit(False)),
    }).drop("alt_baro")


def current_aircraft(rows: DataFrame) -> DataFrame:
    """The rows of the last snapshot, which replaces all before it."""
    last = rows.agg(F.max("t").alias("t"))
    return rows.join(F.broadcast(last), "t")


def snapshot_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The day-partitioned log of snapshots, corrupt lines left out; of a time range only its days are opened."""
    rows = spark.read.schema(schemas.SNAPSHOT).option("mode", "DROPMALFORMED").option("basePath", path).json(path)
    if start:
        rows = rows.filter((F.col("day") >= start[:10]) & (F.col("t") >= start))
    if end:
        rows = rows.filter((F.col("day") <= end[:10]) & (F.col("t") <= end))
    return rows


def last_heartbeat(lines: DataFrame, column: str = "value") -> DataFrame:
    """The newest readable line of type heartbeat, one row or none."""
    parsed = lines.select(F.get_json_object(column, "$.type").alias("type"), F.get_json_object(column, "$.t").alias("t"), F.col(column).alias("line"))
    return parsed.filter("type = 'heartbeat' AND t IS NOT NULL").agg(F.max_by("line", "t").alias("line"), F.max("t").alias("t")).filter("t IS NOT NULL")
