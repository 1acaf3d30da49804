"""Distances and bearings (N1-N3) and ship types (P17, P18) as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Fixed value: the port's approach centre, latitude and longitude.
CENTRE = (52.02, 3.88)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; null if a coordinate is."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def km_from_centre(lat: Column, lon: Column) -> Column:
    """N1."""
    return great_circle_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), lat, lon)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """0 to 360, clockwise from north."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0))


#: Readings of AIS ship type codes that follow no block rule, (coarse, full).
SPECIFIC_TYPES = {
    0: ("Not available", "Not available (default)"), 29: ("SAR aircraft", "Search and rescue aircraft"), 30: ("Fishing", "Fishing vessel"),
    31: ("Towing", "Towing vessel"), 32: ("Towing", "Towing vessel, longer than 200 m or wider than 25 m"),
    33: ("Dredging/underwater ops", "Dredging or underwater operations"), 34: ("Diving ops", "Diving operations"), 35: ("Military ops", "Military operations"),
    36: ("Sailing", "Sailing vessel"), 37: ("Pleasure craft", "Pleasure craft"), 50: ("Pilot vessel", "Pilot vessel"),
    51: ("Search & rescue", "Search and rescue vessel"), 52: ("Tug", "Tug"), 53: ("Port tender", "Port tender"),
    54: ("Anti-pollution", "Vessel with anti-pollution equipment"), 55: ("Law enforcement", "Law enforcement vessel"),
    56: ("Local vessel", "Local vessel (assigned by a local authority)"), 57: ("Local vessel", "Local vessel (assigned by a local authority)"),
    58: ("Medical transport", "Medical transport"), 59: ("Noncombatant", "Noncombatant vessel, per RR Resolution No. 18"),
}
#: First digit of the other codes, (coarse, full).
TYPE_BLOCKS = {
    2: ("Wing in ground", "Wing in ground (WIG) craft"), 4: ("High-speed craft", "High-speed craft (HSC)"), 6: ("Passenger", "Passenger ship"),
    7: ("Cargo", "Cargo ship"), 8: ("Tanker", "Tanker"), 9: ("Other", "Other type of ship"),
}


#: Second digit of those codes.
QUALIFIERS = {
    0: "all ships of this type", 1: "carrying hazardous material, category A", 2: "carrying hazardous material, category B",
    3: "carrying hazardous material, category C", 4: "carrying hazardous material, category D", 5: "reserved for future use", 6: "reserved for future use",
    7: "reserved for future use", 8: "reserved for future use", 9: "no additional information",
}


def _qualifier(digit: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in QUALIFIERS.items() for x in pair])[digit]


def ship_types(spark: SparkSession) -> DataFrame:
    """code 0 to 99, coarse, reading: a dimension of 100 rows."""
    code = F.col("id").cast("int")
    block, digit = F.floor(code / 10).cast("int"), (code % 10).cast("int")
    coarse, reading = F.lit("Reserved"), F.lit("Reserved for future use")
    for b, (short, full) in TYPE_BLOCKS.items():
        coarse = F.when(block == b, short).otherwise(coarse)
        reading = F.when(block == b, F.concat(F.lit(full + " — "), _qualifier(digit))).otherwise(reading)
    for c, (short, full) in SPECIFIC_TYPES.items():
        coarse, reading = F.when(code == c, short).otherwise(coarse), F.when(code == c, full).otherwise(reading)
    return spark.range(100).select(code.alias("code"), coarse.alias("coarse"), reading.alias("reading"))


def with_ship_type(rows: DataFrame, code_col: str) -> DataFrame:
    """rows with type_name (P17) and type_reading (P18): a code outside the table is spelt out, null stays null, what is no number is unknown."""
    types = F.broadcast(ship_types(rows.sparkSession))  # 100 rows
    raw = F.col(code_col).cast("string")
    joined = rows.withColumn("__code", raw.try_cast("int")).join(types, F.col("__code") == F.col("code"), "left")
    name = F.when(raw.isNotNull(), F.coalesce("coarse", F.concat(F.lit("Type "), raw)))
    known = F.concat("reading", F.lit(" (AIS type "), F.col("__code").cast("string"), F.lit(")"))
    reading = F.when(raw.isNotNull(), F.coalesce(known, F.concat(F.lit("Unknown AIS ship type code "), raw)))
    return joined.select(*rows.columns, name.alias("type_name"), reading.alias("type_reading"))


def plausibility(type_name: Column) -> Column:
    """How likely a ship of this type is the one that calls."""
    return F.when(type_name.isin("Cargo", "Tanker", "Passenger"), 3).when(type_name.isin("Sailing", "Pleasure craft"), 1).otherwise(2)


def mmsi_class(mmsi: Column) -> Column:
    """what kind of station an MMSI is, by its zero-padded prefix; the first rule that fits."""
    number = mmsi.cast("string").try_cast("long")
    digits = F.when(number >= 0, F.lpad(number.cast("string"), 9, "0"))
    rule = F.when(digits.isNull() | (number > 999_999_999), "invalid")
    for prefix, name in (
        ("111", "sar-aircraft"), ("970", "ais-sart"), ("972", "mob"), ("974", "epirb"), ("99", "aton"), ("98", "craft"), ("00", "coast-station"), ("0", "ship-group"),
    ):
        rule = rule.when(digits.startswith(prefix), name)
    return rule.when(F.substring(digits, 1, 1).between("2", "7"), "ship").otherwise("invalid")
