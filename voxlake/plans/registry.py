"""Registry, archive and station queries: parts as shared names, customers as call signs, orders as an archive, events as feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..functions import geo
from ..functions.time import micros, seconds
from ..operators import archive, registry, station
from ..scratch import new_folder, written
from ..streaming import registry as vessels


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_merge_latest(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        "event_id", "user_id", micros("ts").alias("t"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("name"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("destination"), F.when(F.col("value") > 10, F.col("value")).alias("latitude"),
        F.col("value").alias("longitude"),
    )
    # Observation times run behind arrival for every third event: late positions lose, late static data wins.
    rows = rows.withColumn("t", F.col("t") - F.when(F.col("event_id") % 3 == 0, 86_400_000_000).otherwise(0))
    merged = registry.merge_observations(rows, "user_id", ["name", "destination"], ["latitude", "longitude"], "t", "event_id")
    return merged.select("user_id", "name", "destination", "latitude", "longitude", F.col("position_at").alias("position_us"), F.col("last_seen").alias("seen_us"))


def q_registry_versions(spark, sf_dir):
    """The same observations as a stream in three batches, each a version of the registry's table."""
    k, t = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = _table(spark, sf_dir, "events").select(
        k.alias("arrival"), F.col("user_id").cast("string").alias("mmsi"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("callsign"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("type", "int"), ("imo", "long"), ("length", "double"), ("beam", "double"), ("draught", "double"))],
        F.when(F.col("event_type") == "error", F.col("props")).alias("destination"), F.when(F.col("value") > 10, F.col("value")).alias("latitude"), F.col("value").alias("longitude"),
        *[F.lit(None).cast("double").alias(c) for c in ("sog", "cog", "heading")], (t - F.when(k % 3 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("observed_at"),
    )
    third = F.expr("ntile(3) OVER (ORDER BY day)")
    days = rows.groupBy(F.floor(F.col("arrival") / 1000).alias("day")).count().withColumn("batch", third).select("day", "batch")  # one row per thousand
    dealt = written(rows.join(days, F.floor(F.col("arrival") / 1000) == F.col("day")).drop("day"), "observations")
    path = new_folder(spark, "registry")
    write = vessels.registry_sink(path)
    for number in range(3):
        write(dealt.filter(F.col("batch") == number + 1).drop("batch"), number)
    entries = store.VersionedTable(spark, path).read().filter("name IS NOT NULL")
    return entries.select(F.col("mmsi").cast("long").alias("user_id"), "name", "destination", "latitude", "longitude", micros("position_at").alias("position_us"), micros("last_seen").alias("seen_us"))


def q_duplicate_names(spark, sf_dir):
    found = registry.duplicate_names(_table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")
    return found.select("shared_name", F.size("keys").cast("long").alias("n"), F.array_join("keys", ",").alias("keys"))


def _parts(spark, sf_dir):
    """Parts as ships: size as type code, price as a position."""
    parts = _table(spark, sf_dir, "part")
    lat = F.lit(52.0) + F.col("p_size") / 50.0
    lon = F.lit(3.0) + (F.col("p_partkey") % 97) / 50.0
    return geo.with_ship_type(parts.select("p_partkey", "p_name", (F.col("p_size") * 2).alias("type_code"), lat.alias("lat"), lon.alias("lon"), "p_retailprice"), "type_code")


def q_best_per_name(spark, sf_dir):
    ships = _parts(spark, sf_dir).withColumn("km", F.round(geo.km_from_centre(F.col("lat"), F.col("lon")), 3))
    order = registry.candidate_order(F.col("p_partkey") % 4 != 0, F.col("km"), F.col("type_name"), F.col("p_retailprice"))
    return registry.best_per_name(ships, "p_name", order, "p_partkey").select("p_name", "p_partkey", "type_name", "km")


def q_ship_types(spark, sf_dir):
    return _parts(spark, sf_dir).groupBy("type_code", "type_name", "type_reading").agg(F.count("*").alias("n"))


def q_best_claim(spark, sf_dir):
    """Customers of one nation and segment claim one number."""
    rows = _table(spark, sf_dir, "customer").select(
        F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("mmsi"), F.when(F.col("c_custkey") % 5 == 0, F.translate("c_name", "#", "_")).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("length"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("destination"), "c_custkey",
    )
    return registry.best_claim(rows, "mmsi", "name", ["length", "destination"], "c_custkey").select("mmsi", "c_custkey", "name")


def q_mmsi_class(spark, sf_dir):
    number = F.col("c_custkey") * 7_654_321 % 1_200_000_000
    return _table(spark, sf_dir, "customer").select("c_custkey", geo.mmsi_class(number).alias("station"))


def _suffixes(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.right(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(3) + F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("suffix"))


def q_unique_suffix(spark, sf_dir):
    return registry.unique_suffix(_suffixes(spark, sf_dir), _table(spark, sf_dir, "customer"), "suffix", "c_name")


def q_unique_pattern(spark, sf_dir):
    digits = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    gap = 7 + F.pmod(F.col("o_orderkey"), F.lit(3)).cast("int")
    pattern = F.concat(F.lit("CUSTOMER#"), F.substring(digits, F.lit(1), gap - 1), F.lit("."), F.substring(digits, gap + 1, F.lit(9)))
    asked = _table(spark, sf_dir, "orders").select(pattern.alias("pattern"))
    return registry.unique_pattern(asked, _table(spark, sf_dir, "customer"), "pattern", "c_name")


def q_latest_override(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    moves = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").select((F.col("user_id") * 13).alias("order"), "event_id", F.col("props").alias("to_key"))
    joined = archive.latest_override(orders, moves, "o_orderkey", "order", "event_id", ["to_key", "event_id"])
    return joined.select("o_orderkey", F.coalesce("moved_to_key", "o_orderstatus").alias("effective_key"), F.col("moved_event_id").alias("move_id"))


def _archive_rows(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(archive.conversation_id(start, F.col("o_orderpriority")).alias("id"), "o_orderkey", "o_custkey", "o_totalprice")


def q_insert_if_absent(spark, sf_dir):
    rows = _archive_rows(spark, sf_dir)
    stored = archive.first_in_batch(rows.filter("o_custkey % 3 = 0"), "id", "o_orderkey")
    return archive.insert_if_absent(stored, rows.filter("o_custkey % 3 <> 0"), "id", "o_orderkey").select("id", "o_orderkey", "o_totalprice")


def q_upsert_comments(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    stored = orders.filter("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("conversation_id"), F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.col("o_orderstatus")).alias("truth"),
        F.col("o_orderpriority").alias("note"), F.lit(100).alias("created_at"), F.lit(100).alias("updated_at"),
    )
    edits = orders.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("conversation_id"), F.when(F.col("o_orderkey") % 8 == 0, "").otherwise(F.concat(F.lit("new\n"), F.col("o_orderstatus"))).alias("truth"),
        F.when(F.col("o_orderkey") % 16 == 0, "").otherwise(F.lit("seen\ntwice")).alias("note"), (F.lit(200) + F.col("o_custkey") % 10).cast("int").alias("at"),
    )
    return archive.upsert_comments(stored, edits, "conversation_id")


def q_merge_days(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    per_day = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus").agg(F.count("*").alias("n"))
    stored = per_day.filter("o_orderstatus = 'O'").select("day", "n")
    fetched = per_day.filter("o_orderstatus = 'F'").select("day", "n")
    return archive.merge_days(stored, fetched, ["day"], ["n"])


def q_labels_text(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    conversations = orders.select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("end"),
    )
    comments = orders.select(
        F.col("o_orderkey").alias("conversation_id"), F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.concat("o_orderstatus", F.lit("\r\n"), "o_orderpriority")).alias("truth"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.lit(" a\nb ")).alias("note"),
    )
    return archive.labels_text(conversations, comments).withColumn("line", F.regexp_replace("line", "\t", "|"))


def q_hourly_distinct(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.floor(seconds("ts") / 3600).alias("hour"), "user_id")
    return station.hourly(rows, "hour", "user_id")


def q_rolling_distinct_24h(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.floor(seconds("ts") / 3600).alias("hour"), "user_id")
    return station.rolling_distinct(rows, "hour", "user_id", 24)


def q_station_verdict(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.floor(seconds("ts") / 3600).alias("hour"), "user_id")
    return station.station_verdict(station.hourly(rows, "hour", "user_id"), "hour", 10.0)


def q_sector_argmax(spark, sf_dir):
    fixes = _table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 50 != 0, 51.0 + F.pmod("event_id", F.lit(211)) / 100.0).alias("latitude"),
        (2.5 + F.pmod(F.col("event_id") * 7, F.lit(283)) / 100.0).alias("longitude"),
    )
    return station.sector_records(fixes, *geo.CENTRE, ["event_id", "user_id"], "event_id")


QUERIES = {f.__name__: f for f in (
    q_merge_latest, q_registry_versions, q_duplicate_names, q_best_per_name, q_ship_types, q_best_claim, q_mmsi_class, q_unique_suffix, q_unique_pattern, q_latest_override, q_insert_if_absent,
    q_upsert_comments, q_merge_days, q_labels_text, q_hourly_distinct, q_rolling_distinct_24h, q_station_verdict, q_sector_argmax,
)}

_COARSE = "CASE " + " ".join(f"WHEN code = {c} THEN '{s[0]}'" for c, s in geo.SPECIFIC_TYPES.items()) + " " + " ".join(
    f"WHEN code // 10 = {b} THEN '{s[0]}'" for b, s in geo.TYPE_BLOCKS.items()) + " WHEN code < 100 THEN 'Reserved' ELSE 'Type ' || code END"
_FULL = "CASE " + " ".join(f"WHEN code = {c} THEN '{s[1]}'" for c, s in geo.SPECIFIC_TYPES.items()) + " " + " ".join(
    f"WHEN code // 10 = {b} THEN '{s[1]} — ' || q" for b, s in geo.TYPE_BLOCKS.items()) + " ELSE 'Reserved for future use' END"
_KM = "round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 52.02) / 2), 2) + cos(radians(52.02)) * cos(radians(lat)) * pow(sin(radians(lon - 3.88) / 2), 2))), 3)"
_SHIPS = f"""ships AS (
  SELECT p_partkey, p_name, p_size * 2 AS code, 52.0::DOUBLE + p_size / 50.0::DOUBLE AS lat, 3.0::DOUBLE + (p_partkey % 97) / 50.0::DOUBLE AS lon, p_retailprice FROM part
), typed AS (
  SELECT *, {_COARSE} AS type_name, {_KM} AS km,
         CASE WHEN code % 10 = 0 THEN 'all ships of this type' WHEN code % 10 <= 4 THEN 'carrying hazardous material, category ' || chr(CAST(64 + code % 10 AS INTEGER))
              WHEN code % 10 <= 8 THEN 'reserved for future use' ELSE 'no additional information' END AS q
  FROM ships
)"""
_HOUR = "(epoch_us(ts) // 3600000000)"

_MERGED = """
WITH o AS (
  SELECT event_id, user_id, epoch_us(ts) - CASE WHEN event_id % 3 = 0 THEN 86400000000 ELSE 0 END AS t, CASE WHEN event_type <> 'view' THEN event_type END AS name,
         CASE WHEN event_type = 'error' THEN props END AS destination, CASE WHEN value > 10 THEN value END AS latitude, value AS longitude FROM events
)
SELECT user_id, arg_max(name, event_id) FILTER (name IS NOT NULL) AS name, arg_max(destination, event_id) FILTER (destination IS NOT NULL) AS destination,
       arg_max(latitude, (t, event_id)) FILTER (latitude IS NOT NULL) AS latitude, arg_max(longitude, (t, event_id)) FILTER (latitude IS NOT NULL) AS longitude,
       max(t) FILTER (latitude IS NOT NULL) AS position_us, max(t) AS seen_us
FROM o GROUP BY user_id HAVING count(name) > 0"""

ORACLES = {
    "q_registry_versions": _MERGED,
    "q_merge_latest": _MERGED,
    "q_duplicate_names": """
SELECT upper(trim(p_name)) AS shared_name, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS keys
FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""",
    "q_best_per_name": f"""
WITH {_SHIPS}
SELECT p_name, p_partkey, type_name, km FROM (
  SELECT *, row_number() OVER (PARTITION BY upper(trim(p_name)) ORDER BY CASE WHEN p_partkey % 4 <> 0 THEN 0 ELSE 1 END, km,
    -(CASE WHEN type_name IN ('Cargo', 'Tanker', 'Passenger') THEN 3 WHEN type_name IN ('Sailing', 'Pleasure craft') THEN 1 ELSE 2 END), p_retailprice DESC, p_partkey) AS k
  FROM typed) WHERE k = 1""",
    "q_ship_types": f"""
WITH {_SHIPS}
SELECT code AS type_code, type_name, CASE WHEN code < 100 THEN {_FULL} || ' (AIS type ' || code || ')' ELSE 'Unknown AIS ship type code ' || code END AS type_reading, count(*) AS n
FROM typed GROUP BY ALL""",
    "q_best_claim": """
SELECT mmsi, c_custkey, name FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY CASE WHEN regexp_matches(name, '[@#?\\\\<>\\[\\]$%="^*;:]') THEN 1 ELSE 0 END,
                               -((CASE WHEN acct > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END)), c_custkey) AS k
  FROM (SELECT c_nationkey || '-' || c_mktsegment AS mmsi, CASE WHEN c_custkey % 5 = 0 THEN replace(c_name, '#', '_') ELSE c_name END AS name, c_acctbal AS acct, c_custkey FROM customer)
) WHERE k = 1""",
    "q_mmsi_class": """
SELECT c_custkey, CASE WHEN m > 999999999 THEN 'invalid' WHEN s LIKE '111%' THEN 'sar-aircraft' WHEN s LIKE '970%' THEN 'ais-sart' WHEN s LIKE '972%' THEN 'mob'
  WHEN s LIKE '974%' THEN 'epirb' WHEN s LIKE '99%' THEN 'aton' WHEN s LIKE '98%' THEN 'craft' WHEN s LIKE '00%' THEN 'coast-station' WHEN s LIKE '0%' THEN 'ship-group'
  WHEN s[1] BETWEEN '2' AND '7' THEN 'ship' ELSE 'invalid' END AS station
FROM (SELECT c_custkey, m, lpad(m::VARCHAR, 9, '0') AS s FROM (SELECT c_custkey, c_custkey * 7654321 % 1200000000 AS m FROM customer))""",
    "q_unique_suffix": """
WITH w AS (SELECT DISTINCT right(lpad(o_custkey::VARCHAR, 6, '0'), CAST(3 + o_orderkey % 3 AS INTEGER)) AS suffix FROM orders),
m AS (SELECT suffix, count(*) AS n, min(upper(c_name)) AS key FROM w JOIN (SELECT DISTINCT c_name FROM customer) ON ends_with(upper(c_name), suffix) GROUP BY suffix)
SELECT w.suffix, CASE WHEN n = 1 THEN key END AS key FROM w LEFT JOIN m USING (suffix)""",
    "q_unique_pattern": """
WITH o AS (SELECT lpad(o_custkey::VARCHAR, 9, '0') AS d, CAST(7 + o_orderkey % 3 AS INTEGER) AS g FROM orders),
w AS (SELECT DISTINCT 'CUSTOMER#' || substr(d, 1, g - 1) || '.' || substr(d, g + 1) AS pattern FROM o),
m AS (SELECT pattern, count(*) AS n, min(upper(c_name)) AS key FROM w JOIN (SELECT DISTINCT c_name FROM customer) ON upper(c_name) LIKE replace(pattern, '.', '_') GROUP BY pattern)
SELECT w.pattern, CASE WHEN n = 1 THEN key END AS key FROM w LEFT JOIN m USING (pattern)""",
    "q_latest_override": """
SELECT o_orderkey, coalesce(to_key, o_orderstatus) AS effective_key, move_id
FROM orders LEFT JOIN (SELECT user_id * 13 AS o_orderkey, arg_max(props, event_id) AS to_key, max(event_id) AS move_id FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (o_orderkey)""",
    "q_insert_if_absent": """
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority AS id, o_orderkey, o_custkey, o_totalprice FROM orders)
SELECT id, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM r
WHERE o_custkey % 3 <> 0 AND id NOT IN (SELECT id FROM r WHERE o_custkey % 3 = 0) GROUP BY id""",
    "q_upsert_comments": """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE o_orderstatus END AS truth, o_orderpriority AS note FROM orders WHERE o_orderkey % 3 <> 0),
e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'new ' || o_orderstatus END AS truth,
             CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE 'seen' || chr(10) || 'twice' END AS note, CAST(200 + o_custkey % 10 AS INTEGER) AS t FROM orders WHERE o_orderkey % 2 = 0)
SELECT k AS conversation_id, CASE WHEN e.t IS NOT NULL THEN e.truth ELSE s.truth END AS truth, CASE WHEN e.t IS NOT NULL THEN e.note ELSE s.note END AS note,
       CASE WHEN s.k IS NOT NULL THEN 100 ELSE e.t END AS created_at, coalesce(e.t, 100) AS updated_at
FROM s FULL JOIN e USING (k) WHERE e.t IS NULL OR e.truth IS NOT NULL OR e.note IS NOT NULL""",
    "q_merge_days": """
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT day, coalesce(f.n, s.n) AS n, CASE WHEN s.n IS NULL THEN 'added' WHEN f.n IS NULL THEN 'kept' ELSE 'updated' END AS change
FROM (SELECT * FROM d WHERE o_orderstatus = 'O') s FULL JOIN (SELECT * FROM d WHERE o_orderstatus = 'F') f USING (day)""",
    "q_labels_text": """
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || o_orderstatus || ' ' || o_orderpriority
       || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '|a b' END AS line
FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0""",
    "q_hourly_distinct": f"SELECT {_HOUR} AS hour, count(DISTINCT user_id) AS vessels, count(*) AS messages FROM events GROUP BY 1",
    "q_rolling_distinct_24h": f"""
WITH h AS (SELECT DISTINCT {_HOUR} AS hour, user_id FROM events)
SELECT a.hour, count(DISTINCT b.user_id) AS distinct_keys FROM (SELECT DISTINCT hour FROM h) a JOIN h b ON b.hour BETWEEN a.hour - 23 AND a.hour GROUP BY a.hour""",
    "q_station_verdict": f"""
WITH h AS (SELECT {_HOUR} AS hour, count(DISTINCT user_id) AS vessels FROM events GROUP BY 1)
SELECT count(*) AS hours, round(avg(vessels), 6) AS mean_vessels, min(vessels) AS min_vessels,
       CASE WHEN count(*) = 0 THEN 'no_data' WHEN avg(vessels) >= 10 THEN 'pass' ELSE 'fail' END AS verdict
FROM h WHERE hour > (SELECT min(hour) FROM h) AND hour < (SELECT max(hour) FROM h)""",
    "q_sector_argmax": """
WITH f AS (SELECT event_id, user_id, CASE WHEN event_id % 50 <> 0 THEN 51.0::DOUBLE + (event_id % 211) / 100.0::DOUBLE END AS lat, 2.5::DOUBLE + (event_id * 7 % 283) / 100.0::DOUBLE AS lon FROM events),
g AS (
  SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 52.02) / 2), 2) + cos(radians(52.02)) * cos(radians(lat)) * pow(sin(radians(lon - 3.88) / 2), 2))) AS km,
         degrees(atan2(sin(radians(lon - 3.88)) * cos(radians(lat)), cos(radians(52.02)) * sin(radians(lat)) - sin(radians(52.02)) * cos(radians(lat)) * cos(radians(lon - 3.88)))) AS b
  FROM f
), r AS (SELECT *, CASE WHEN lat IS NULL THEN 'no_position' WHEN km > 150 THEN 'implausible' END AS reason FROM g),
s AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(floor((((b + 360 + 22.5) % 360)) / 45) * 45 AS INTEGER) END AS sector FROM r),
x AS (SELECT *, row_number() OVER (PARTITION BY sector, reason ORDER BY km DESC, event_id) AS k, count(*) OVER (PARTITION BY sector, reason) AS n FROM s)
SELECT sector, reason, n, CASE WHEN reason IS NULL THEN round(km, 6) END AS km, CASE WHEN reason IS NULL THEN event_id END AS event_id, CASE WHEN reason IS NULL THEN user_id END AS user_id
FROM x WHERE k = 1""",
}
