"""Linking, report and feed-state queries: parts and customers as ships, events as trials, polls and quota readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import linking, reports
from ..streaming import health

WORDS = ["the", "of", "and", "que", "der"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_word_production(spark, sf_dir):
    return reports.word_production(_table(spark, sf_dir, "conversations"), "text", WORDS)


def q_draught_partition(spark, sf_dir):
    c, key = F.col("c_acctbal"), F.col("c_custkey")
    said = F.when(key % 5 == 0, F.array().cast("array<double>")).otherwise(F.array((key % 19 + 1).cast("double"), (key % 7 + 1).cast("double")))
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey", said.alias("draughts"), F.when(key % 11 != 0, F.col("c_name")).alias("vessel"), F.when(c > 0, F.floor(c / 50).cast("double")).alias("length")
    )
    found = reports.draught_partition(rows, "draughts", "vessel", "length")
    return found.select("c_custkey", "bucket", "said", F.round("ratio", 6).alias("ratio"))


def q_error_kinds(spark, sf_dir):
    found = reports.per_hundred(_table(spark, sf_dir, "events"), "event_type")
    return found.select("event_type", "n", F.round("per_100", 6).alias("per_100"))


def q_trial_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("label"), F.when(F.col("event_type") == "error", "timeout").otherwise("ok").alias("outcome"), F.col("value").alias("elapsed")
    )
    found = reports.trial_summary(rows, "label", "outcome", "elapsed")
    numbers = ("ok_min", "ok_median", "ok_max", "fail_min", "fail_median", "fail_max", "failure_rate")
    return found.select("label", "runs", "failures", "verdict", *[F.round(n, 6).alias(n) for n in numbers])


def q_language_census(spark, sf_dir):
    found = reports.language_census(_table(spark, sf_dir, "documents"), "lang")
    return found.select("language", "n", F.round("share", 8).alias("share"))


def q_antenna_report(spark, sf_dir):
    found = reports.antenna_report(_table(spark, sf_dir, "events"), "user_id", "value")
    return found.select("user_id", *[F.round(c, 6).alias(c) for c in ("floor_db", "peak_db", "max_snr_db")])


def q_contract_census(spark, sf_dir):
    return reports.contract_census(_table(spark, sf_dir, "customer"), ["c_acctbal", "c_name", "c_mktsegment"], "c_custkey")


def q_label_status(spark, sf_dir):
    labels = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 30 == 0, "nobody").otherwise(F.col("p_name")).alias("name"))
    # Half of the names are borne by one ship only.
    some = F.when(F.length("p_name") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    ships = _table(spark, sf_dir, "part").select(some.alias("name"), F.col("p_partkey").alias("mmsi"))
    return reports.resolved_labels(labels, ships, "name").select("p_partkey", "name", "status", "mmsi")


def q_feed_status(spark, sf_dir):
    polls = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("feed"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("n"), F.col("props").alias("error")
    )
    found = health.feed_status(polls, "feed", "at")
    lamp = health.hub_lamp(F.col("consecutive_failures"), F.lit(10_000) - F.col("last_ok_at"), F.lit(100))
    return found.select("feed", "last_ok_at", "last_count", "last_error", "consecutive_failures", lamp.alias("lamp"))


def q_logged_failures(spark, sf_dir):
    failures = _table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id")
    return health.logged_failures(failures, "user_id", "event_id", every=5).select("user_id", "event_id", F.col("n").cast("long").alias("n"))


def q_quota_warnings(spark, sf_dir):
    readings = _table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("left"))
    return health.quota_warnings(readings, "user_id", "event_id", "left").select("user_id", "event_id", "left")


def q_tumbling(spark, sf_dir):
    samples = _table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("capture"), "event_id")
    return health.tumbling(samples, "capture", "event_id", 10)


def q_replay_diff(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    before = orders.filter("o_orderkey % 10 <> 1").select("o_orderkey", F.col("o_orderpriority").alias("vessel"))
    changed = F.when(F.col("o_orderkey") % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    after = orders.filter("o_orderkey % 10 <> 2").select("o_orderkey", changed.alias("vessel"))
    return linking.replay_diff(before, after, "o_orderkey", "vessel")


def q_display_tags(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    some = lambda n, v: F.when(F.col("c_custkey") % n != 0, v)
    tag = display.vessel_tag(some(3, F.col("c_name")), some(2, F.col("c_mktsegment")), some(5, F.col("c_custkey").cast("string")), some(7, F.lit("PA12")), F.lit("hello"))
    channel = F.format_string("%d,%03d", F.lit(110) + F.col("c_custkey") % 40, F.col("c_nationkey"))
    return c.select("c_custkey", tag.alias("tag"), display.is_airband(channel).alias("airband"), display.strip_enrichment(tag).alias("text"))


#: Names as they are heard, well and badly.
_HEARD = ("Santa Isabel Maersk", "Santa Isabel", "Isabel Santa Maersk", "Northern Light", "Northern Lights of Bergen", "Stolt Kestrel", "Stolt Kestrl", "MSC Maria Pia")


def q_renamed_guesses(spark, sf_dir):
    heard = F.element_at(F.array(*[F.lit(n) for n in _HEARD]), (F.col("event_id") * 5 % len(_HEARD) + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("channel"), F.col("event_id").alias("id"), (F.col("event_id") * 40).alias("at"), heard.alias("vessel"), (F.col("event_id") % 2 == 0).alias("fuzzy")
    )
    return linking.renamed_guesses(rows, "channel", "at", ttl=900)


def q_enriched(spark, sf_dir):
    ships = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("mmsi"), F.col("c_name").alias("name"), F.format_string("PA%04d", "c_custkey").alias("callsign"))
    o = F.col("o_custkey")
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.format_string("PA%04d", o)).alias("callsign"),
        F.when(F.col("o_orderkey") % 3 == 0, F.format_string("customer#%09d", o + 1)).alias("vessel"), F.when(F.col("o_orderkey") % 4 != 0, F.format_string("this is pa-%04d", o)).alias("text"),
    )
    return linking.enriched(rows, ships).select("id", "vessel", "mmsi", "callsign", "match_method")


QUERIES = {f.__name__: f for f in (
    q_word_production, q_draught_partition, q_error_kinds, q_trial_summary, q_language_census, q_antenna_report, q_contract_census, q_label_status, q_feed_status,
    q_logged_failures, q_quota_warnings, q_tumbling, q_replay_diff, q_display_tags, q_renamed_guesses, q_enriched,
)}

_EDGE = r"[^\p{L}\p{N}_]"
ORACLES = {
    "q_word_production": " UNION ALL ".join(
        f"SELECT '{w}' AS word, count(*) FILTER (WHERE regexp_matches(text, '(^|{_EDGE}){w}($|{_EDGE})', 'i')) AS n_rows FROM conversations" for w in WORDS
    ),
    "q_draught_partition": """
WITH r AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN greatest(c_custkey % 19 + 1, c_custkey % 7 + 1)::DOUBLE END AS said, c_custkey % 11 <> 0 AS named,
         CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 50) ELSE 0 END AS length
  FROM customer
), b AS (
  SELECT *, CASE WHEN said IS NULL THEN 'no_draught' WHEN NOT named THEN 'unnamed' WHEN length = 0 THEN 'no_length' WHEN length / said < 8 THEN 'flagged' ELSE 'plausible' END AS bucket FROM r
)
SELECT c_custkey, bucket, said, CASE WHEN bucket IN ('flagged', 'plausible') THEN round(length / said, 6) END AS ratio FROM b""",
    "q_error_kinds": "SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) AS per_100 FROM events GROUP BY event_type",
    "q_trial_summary": """
WITH t AS (SELECT user_id % 20 AS label, event_type = 'error' AS failed, value FROM events), s AS (
  SELECT label, count(*) AS runs, count(*) FILTER (WHERE failed) AS failures, min(value) FILTER (WHERE NOT failed) AS ok_min, median(value) FILTER (WHERE NOT failed) AS ok_median,
         max(value) FILTER (WHERE NOT failed) AS ok_max, min(value) FILTER (WHERE failed) AS fail_min, median(value) FILTER (WHERE failed) AS fail_median, max(value) FILTER (WHERE failed) AS fail_max
  FROM t GROUP BY label
)
SELECT label, runs, failures, CASE WHEN failures = 0 THEN 'clean' WHEN failures = 1 THEN 'fault present, too few to read' WHEN fail_max - fail_min <= 1 THEN 'fault reproduced'
       ELSE 'failures, but scattered' END AS verdict, round(ok_min, 6) AS ok_min, round(ok_median, 6) AS ok_median, round(ok_max, 6) AS ok_max, round(fail_min, 6) AS fail_min,
       round(fail_median, 6) AS fail_median, round(fail_max, 6) AS fail_max, round(failures / runs, 6) AS failure_rate
FROM s""",
    "q_language_census": "SELECT coalesce(nullif(trim(lang), ''), '(error)') AS language, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 8) AS share FROM documents GROUP BY 1",
    "q_antenna_report": """
SELECT user_id, round(quantile_cont(value, 0.2), 6) AS floor_db, round(max(value), 6) AS peak_db, round(max(value) - quantile_cont(value, 0.2), 6) AS max_snr_db FROM events GROUP BY user_id""",
    "q_contract_census": " UNION ALL ".join(
        f"""SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NOT NULL AND try_cast({f}::VARCHAR AS DOUBLE) IS NULL) AS n_bad,
       min_by({f}::VARCHAR, c_custkey) FILTER (WHERE {f} IS NOT NULL AND try_cast({f}::VARCHAR AS DOUBLE) IS NULL) AS first_bad FROM customer""" for f in ("c_acctbal", "c_name", "c_mktsegment")
    ),
    "q_enriched": """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderkey % 2 = 0 AS called, o_orderkey % 3 = 0 AS named, o_orderkey % 4 <> 0 AS said, printf('PA%04d', o_custkey) AS c, printf('customer#%09d', o_custkey + 1) AS v FROM orders),
m AS (SELECT *, CASE WHEN called AND said THEN 'callsign' WHEN named AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = k + 1) THEN 'name' WHEN called AND NOT said THEN 'callsign' END AS method FROM o),
s AS (SELECT *, CASE method WHEN 'callsign' THEN k WHEN 'name' THEN k + 1 END AS ship FROM m)
SELECT id, coalesce(c_name, CASE WHEN named THEN v END) AS vessel, ship::VARCHAR AS mmsi, CASE WHEN called THEN c ELSE printf('PA%04d', ship) END AS callsign, method AS match_method
FROM s LEFT JOIN customer ON c_custkey = ship""",
    "q_label_status": """
WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 30 = 0 THEN 'nobody' ELSE p_name END AS name FROM part),
s AS (SELECT upper(trim(CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE p_name || ' ' || p_partkey END)) AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS mmsi FROM part GROUP BY 1)
SELECT p_partkey, name, CASE WHEN n = 1 THEN 'scorable' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN n = 1 THEN mmsi END AS mmsi
FROM l LEFT JOIN s ON upper(trim(name)) = k""",
    "q_feed_status": """
WITH p AS (SELECT user_id % 50 AS feed, event_id AS at_id, event_type <> 'error' AS ok, value AS n, props FROM events),
b AS (
  SELECT feed, max(at_id) FILTER (WHERE ok) AS last_ok_at, max_by(n, at_id) FILTER (WHERE ok) AS last_count, max_by(props, at_id) FILTER (WHERE NOT ok) AS last_error FROM p GROUP BY feed
), f AS (
  SELECT b.*, (SELECT count(*) FROM p WHERE p.feed = b.feed AND NOT ok AND (last_ok_at IS NULL OR at_id > last_ok_at)) AS consecutive_failures FROM b
)
SELECT *, CASE WHEN consecutive_failures > 0 THEN 'red' WHEN last_ok_at IS NULL THEN 'unlit' WHEN 10000 - last_ok_at > 200 THEN 'amber' ELSE 'green' END AS lamp FROM f""",
    "q_logged_failures": """
SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 3 OR n % 5 = 0""",
    "q_quota_warnings": """
WITH r AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS "left", CASE WHEN floor(value) <= 200 THEN CAST(floor(floor(value) / 50) AS BIGINT) END AS step FROM events),
g AS (SELECT *, sum((step IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
m AS (SELECT *, min(step) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_step FROM g)
SELECT user_id, event_id, "left" FROM m WHERE step IS NOT NULL AND (least_step IS NULL OR step < least_step)""",
    "q_tumbling": """
SELECT user_id % 10 AS capture, event_id // 50 AS "window", min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM events GROUP BY 1, 2""",
    "q_replay_diff": """
WITH b AS (SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey % 10 <> 1),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 10 <> 2)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.v AS "before", a.v AS "after", CASE WHEN a.v IS NULL THEN 'removed' WHEN b.v IS NULL THEN 'added' ELSE 'replaced' END AS change
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.v IS DISTINCT FROM a.v""",
    "q_display_tags": """
SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN '[' || c_name || CASE WHEN c_custkey % 2 <> 0 THEN '/' || c_mktsegment ELSE '' END || ']' END,
         CASE WHEN c_custkey % 5 <> 0 THEN '(MMSI:' || c_custkey || ')' WHEN c_custkey % 7 <> 0 THEN '(PA12)' END, 'hello') AS tag,
       110 + c_custkey % 40 + c_nationkey / 1000.0 >= 118 AND 110 + c_custkey % 40 + c_nationkey / 1000.0 < 137 AS airband,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN '(PA12) hello' ELSE 'hello' END AS text
FROM customer""",
}
