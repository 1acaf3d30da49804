"""Journal and temporal queries over events (a channel per user, a feed per event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import micros, seconds
from ..operators import second_look, sessions, temporal

SECOND = 1_000_000
GAP, CAP = 6 * 3600 * SECOND, 3


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def q_gap_sessions_capped(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", micros("ts").alias("t"), "value")
    total = F.round(F.sum("value"), 2).alias("total")
    return sessions.windows(rows, "user_id", "t", "event_id", GAP, CAP, total).select(
        F.col("user_id").alias("channel"), "session", "window", "n", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "total"
    )


_WINDOWS = f"""
ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, event_type FROM events),
marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS opened FROM ev),
sessioned AS (SELECT *, CAST(sum(opened) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked),
windowed AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) - 1) // {CAP} AS win FROM sessioned),
w AS (SELECT user_id AS channel, session, win AS "window", count(*) AS n, min(t) AS first_us, max(t) AS last_us, round(sum(value), 2) AS total FROM windowed GROUP BY ALL)"""


def q_closed_windows(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", micros("ts").alias("t"))
    now = rows.agg(F.max("t").alias("now"))  # one row
    found = sessions.windows(rows, "user_id", "t", "event_id", GAP, CAP).crossJoin(F.broadcast(now))
    return sessions.closed_windows(found, "user_id", F.col("now"), GAP, CAP).select(F.col("user_id").alias("channel"), "session", "window", "n", "closed")


def q_session_window(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(
        F.col("user_id").alias("channel"), F.col("s.start").alias("start_ts"), "last_ts", "n"
    )


def q_asof_backward_tol(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", micros("ts").alias("t"))
    left = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("left_id"), "t")
    right = rows.filter("event_type = 'view'").select("user_id", "event_id", "t")
    found = temporal.asof_backward(left, right, ["user_id"], "t", 12 * 3600 * SECOND, "event_id")
    return found.select("left_id", F.col("found.event_id").alias("right_id"), (F.col("t") - F.col("found.t")).alias("age_us"))


def q_nearest_within_tol(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", micros("ts").alias("t"))
    left = rows.filter("event_type = 'error'").select(F.col("event_id").alias("left_id"), "t")
    right = rows.filter("event_type = 'click'").select("event_id", "t")
    found = temporal.nearest_within(left, right, "left_id", "t", 60 * SECOND, "event_id")
    return found.select("left_id", F.col("found.event_id").alias("right_id"), F.col("delta").alias("delta_us"))


def q_interval_join(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", micros("ts").alias("t"))
    found = sessions.windows(rows, "user_id", "t", "event_id", GAP, CAP).select("user_id", "session", "window", "first", "last")
    errors = rows.filter("event_type = 'error'").select("user_id", "event_id", "t")
    met = temporal.within_intervals(found, errors, ["user_id"], "first", "last", "t", GAP)
    return met.groupBy(F.col("user_id").alias("channel"), "session", "window").agg(F.count("*").alias("n_errors"), F.min("event_id").alias("first_error"))


HOUR = 3600


def _snapshots(rows: DataFrame) -> DataFrame:
    """An aircraft per user, its selected altitude the value of its last event in each hour."""
    hour = F.floor(F.col("t") / HOUR) * HOUR
    return rows.groupBy(hour.alias("t"), F.col("user_id").cast("string").alias("hex")).agg(
        F.max_by("value", F.struct("t", "event_id")).alias("selected_altitude"), F.lit(None).cast("double").alias("selected_heading"),
        (F.max_by("event_type", F.struct("t", "event_id")) == "signup").alias("on_ground"),
    )


def q_change_echo(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", seconds("ts").alias("t"))
    number = F.struct(F.lit("altitude").alias("kind"), F.floor("value").cast("int").alias("value"))
    spoken = rows.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), "t", F.when(F.col("event_id") % 7 == 0, F.array().cast("array<struct<kind:string,value:int>>")).otherwise(F.array(number)).alias("numbers")
    )
    found = temporal.change_echo(spoken, _snapshots(rows), before=HOUR, after=6 * HOUR, altitude=0.5)
    return found.select("id", "status", "hex", "delay", F.array_join("candidates", ",").alias("candidates"))


def q_second_look(spark, sf_dir):
    """Purchases by users whose call sign was heard for some: the outcome of both clues, and the state of a newly named aircraft."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", seconds("ts").alias("t"))
    number, k = F.struct(F.lit("altitude").alias("kind"), F.floor("value").cast("int").alias("value")), F.col("event_id")
    heard = F.when(k % 3 == 0, F.concat(F.lit("KLM"), k))
    stored = rows.filter("event_type = 'purchase'").select(
        k.alias("id"), "t", F.array(number).alias("numbers"), heard.alias("candidate"), F.when(k % 6 == 0, F.col("user_id").cast("string")).alias("call_hex"),
        F.when(k % 6 == 0, F.col("user_id").cast("string")).alias("outcome_key"), F.when(k % 6 == 0, F.struct(F.lit(-1.0).alias("altitude"))).alias("state"),
    )
    snapshots = _snapshots(rows).withColumn("state", F.struct(F.col("selected_altitude").alias("altitude")))
    found = second_look.second_look(stored, snapshots, before=HOUR, after=6 * HOUR, poll=HOUR, altitude=0.5)
    return found.select("id", "echo_status", "echo_delay", F.col("outcome.kind").alias("kind"), F.col("outcome.key").alias("key"), F.col("outcome.badge").alias("badge"), F.col("state.altitude").alias("altitude"))


def q_rolling_silence(spark, sf_dir):
    """Channels that never sent an error, against those that went quiet (none in the last day of the feed)."""
    rows = events(spark, sf_dir).select("user_id", "event_type", micros("ts").alias("t"))
    now = F.broadcast(rows.agg(F.max("t").alias("now")))
    last = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("t"))).alias("last_us")).crossJoin(now)
    state = F.when(F.col("last_us").isNull(), "never_sent").when(F.col("now") - F.col("last_us") > 86400 * SECOND, "went_quiet").otherwise("alive")
    return last.select(F.col("user_id").alias("channel"), state.alias("state"))


QUERIES = {f.__name__: f for f in (
    q_gap_sessions_capped, q_closed_windows, q_session_window, q_asof_backward_tol, q_nearest_within_tol, q_interval_join, q_change_echo, q_second_look, q_rolling_silence,
)}

ORACLES = {
    "q_gap_sessions_capped": f"WITH {_WINDOWS} SELECT * FROM w",
    "q_closed_windows": f"""WITH {_WINDOWS}
SELECT channel, session, "window", n,
       lead(n) OVER (PARTITION BY channel ORDER BY session, "window") IS NOT NULL OR n >= {CAP} OR (SELECT max(t) FROM ev) - last_us > {GAP} AS closed
FROM w""",
    "q_session_window": f"""WITH {_WINDOWS}
SELECT user_id AS channel, make_timestamp(min(t)) AS start_ts, make_timestamp(max(t)) AS last_ts, count(*) AS n FROM sessioned GROUP BY user_id, session""",
    "q_asof_backward_tol": f"""
WITH ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events),
found AS (
  SELECT l.event_id AS left_id, l.t, r.event_id AS right_id, r.t AS right_t,
         row_number() OVER (PARTITION BY l.event_id ORDER BY r.t DESC, r.event_id DESC) AS k
  FROM ev l LEFT JOIN ev r ON l.user_id = r.user_id AND r.event_type = 'view' AND r.t <= l.t AND l.t - r.t <= {12 * 3600 * SECOND}
  WHERE l.event_type = 'purchase'
)
SELECT left_id, right_id, t - right_t AS age_us FROM found WHERE k = 1""",
    "q_nearest_within_tol": f"""
WITH ev AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events),
found AS (
  SELECT l.event_id AS left_id, r.event_id AS right_id, abs(l.t - r.t) AS delta_us,
         row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.event_id) AS k
  FROM ev l LEFT JOIN ev r ON r.event_type = 'click' AND r.t BETWEEN l.t - {60 * SECOND} AND l.t + {60 * SECOND}
  WHERE l.event_type = 'error'
)
SELECT left_id, right_id, delta_us FROM found WHERE k = 1""",
    "q_interval_join": f"""WITH {_WINDOWS}
SELECT w.channel, w.session, w."window", count(*) AS n_errors, min(e.event_id) AS first_error
FROM w JOIN ev e ON e.user_id = w.channel AND e.event_type = 'error' AND e.t BETWEEN w.first_us AND w.last_us GROUP BY ALL""",
    "q_change_echo": f"""
WITH ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events),
snap AS (
  SELECT t // {HOUR} * {HOUR} AS t, user_id::VARCHAR AS hex, max_by(value, (t, event_id)) AS v, max_by(event_type, (t, event_id)) = 'signup' AS ground
  FROM ev GROUP BY 1, 2
),
said AS (SELECT event_id AS id, t, floor(value) AS v, event_id % 7 = 0 AS silent FROM ev WHERE event_type = 'purchase'),
times AS (SELECT DISTINCT t FROM snap),
based AS (
  SELECT s.id, s.t, s.v, s.silent, max(CASE WHEN x.t <= s.t - {HOUR} THEN x.t END) AS base_t,
         count(CASE WHEN x.t > s.t - {HOUR} AND x.t <= s.t + {6 * HOUR} THEN 1 END) AS n_later
  FROM said s CROSS JOIN times x GROUP BY ALL
),
hit AS (
  SELECT b.id, a.hex, min(a.t) - b.t AS delay
  FROM based b JOIN snap a ON a.t > b.t - {HOUR} AND a.t <= b.t + {6 * HOUR} AND NOT a.ground AND abs(a.v - b.v) <= 0.5
  JOIN snap o ON o.t = b.base_t AND o.hex = a.hex AND abs(o.v - b.v) > 0.5
  WHERE NOT b.silent GROUP BY b.id, a.hex, b.t
),
hits AS (SELECT id, list_sort(list(hex)) AS candidates, min(hex) AS hex, min_by(delay, hex) AS delay FROM hit GROUP BY id)
SELECT b.id, CASE WHEN silent THEN 'no_numbers' WHEN base_t IS NULL OR n_later = 0 THEN 'no_snapshots' WHEN candidates IS NULL THEN 'none'
                  WHEN len(candidates) = 1 THEN 'match' ELSE 'ambiguous' END AS status,
       CASE WHEN len(candidates) = 1 THEN hex END AS hex, CASE WHEN len(candidates) = 1 THEN delay END AS delay,
       coalesce(array_to_string(candidates, ','), '') AS candidates
FROM based b LEFT JOIN hits USING (id)""",
    "q_second_look": f"""
WITH ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events),
snap AS (
  SELECT t // {HOUR} * {HOUR} AS t, user_id::VARCHAR AS hex, max_by(value, (t, event_id)) AS v, max_by(event_type, (t, event_id)) = 'signup' AS ground
  FROM ev GROUP BY 1, 2
),
said AS (SELECT event_id AS id, t, floor(value) AS v, false AS silent FROM ev WHERE event_type = 'purchase'),
times AS (SELECT DISTINCT t FROM snap),
based AS (
  SELECT s.id, s.t, s.v, s.silent, max(CASE WHEN x.t <= s.t - {HOUR} THEN x.t END) AS base_t,
         count(CASE WHEN x.t > s.t - {HOUR} AND x.t <= s.t + {6 * HOUR} THEN 1 END) AS n_later
  FROM said s CROSS JOIN times x GROUP BY ALL
),
hit AS (
  SELECT b.id, a.hex, min(a.t) - b.t AS delay
  FROM based b JOIN snap a ON a.t > b.t - {HOUR} AND a.t <= b.t + {6 * HOUR} AND NOT a.ground AND abs(a.v - b.v) <= 0.5
  JOIN snap o ON o.t = b.base_t AND o.hex = a.hex AND abs(o.v - b.v) > 0.5
  WHERE NOT b.silent GROUP BY b.id, a.hex, b.t
),
hits AS (SELECT id, list_sort(list(hex)) AS candidates, min(hex) AS hex, min_by(delay, hex) AS delay FROM hit GROUP BY id),
seen AS (SELECT b.id, b.t, CASE WHEN base_t IS NULL OR n_later = 0 THEN 'no_snapshots' WHEN candidates IS NULL THEN 'none' WHEN len(candidates) = 1 THEN 'match' ELSE 'ambiguous' END AS echo_status,
                CASE WHEN len(candidates) = 1 THEN hex END AS e, CASE WHEN len(candidates) = 1 THEN delay END AS echo_delay FROM based b LEFT JOIN hits USING (id)),
clue AS (SELECT seen.*, CASE WHEN id % 6 = 0 THEN ev.user_id::VARCHAR END AS c, id % 3 = 0 AS heard FROM seen JOIN ev ON ev.event_id = id),
made AS (SELECT *, CASE WHEN heard AND c IS NULL THEN 'unknown' WHEN c <> e THEN 'review' WHEN c IS NOT NULL OR e IS NOT NULL THEN 'flight' ELSE 'unassigned' END AS kind FROM clue),
outcome AS (SELECT *, CASE kind WHEN 'unknown' THEN 'heard:' || substr('KLM' || id, 1, 12) WHEN 'flight' THEN coalesce(c, e) ELSE kind END AS key,
                   CASE WHEN kind = 'review' THEN 'conflict' WHEN kind = 'unknown' THEN kind WHEN kind = 'unassigned' THEN 'none' WHEN c = e THEN 'confirmed' WHEN c IS NOT NULL THEN 'callsign' ELSE 'echo' END AS badge FROM made),
last AS (SELECT id, max(x.t) AS t FROM outcome o JOIN times x ON x.t BETWEEN o.t - {3 * HOUR} AND o.t WHERE kind = 'flight' AND c IS NULL GROUP BY id)
SELECT o.id, echo_status, echo_delay, kind, key, badge, coalesce(s.v, CASE WHEN o.id % 6 = 0 THEN -1 END) AS altitude
FROM outcome o LEFT JOIN last ON last.id = o.id LEFT JOIN snap s ON s.t = last.t AND s.hex = o.key AND o.kind = 'flight'""",
    "q_rolling_silence": f"""
WITH ev AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events),
last AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN t END) AS last_us FROM ev GROUP BY user_id)
SELECT user_id AS channel, CASE WHEN last_us IS NULL THEN 'never_sent' WHEN (SELECT max(t) FROM ev) - last_us > {86400 * SECOND} THEN 'went_quiet' ELSE 'alive' END AS state
FROM last""",
}
