"""Airband, candidate and contract queries: conversation turns with some words spoken as airband words, events as feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import airband as A
from ..operators import candidates as C

def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(number, size):
    """A number of so many figures, as it is spelt."""
    table = F.array(*[F.lit(w) for w in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    return F.array_join(F.transform(F.split(F.lpad(number.cast("string"), size, "0"), ""), lambda d: F.element_at(table, d.cast("int") + 1)), " ")


def _phrases(spark, sf_dir):
    """Orders as transmissions, each with a phrase of one of six forms."""
    o, small = F.col("o_orderkey"), F.array(*[F.lit(w) for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    word = lambda n: F.element_at(small, (n % 9 + 1).cast("int"))
    text = (
        F.when(o % 6 == 0, F.concat(F.lit("turn left heading "), _digits(o % 360 + 1, 3))).when(o % 6 == 1, F.concat(F.lit("descend to flight level "), _digits(o % 400 + 10, 3), F.lit(" now")))
        .when(o % 6 == 2, F.concat(word(o), F.lit(" thousand "), word(F.floor(o / 10)), F.lit(" hundred feet"))).when(o % 6 == 3, F.concat(F.lit("our draught is "), word(o), F.lit(" decimal "), word(F.floor(o / 10)), F.lit(" metres")))
        .when(o % 6 == 4, F.concat(F.lit("KLM "), _digits(o % 90 + 10, 2), F.lit(" alfa bravo, good morning"))).otherwise("passing two thousand, speedbird")
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def q_aviation_numbers(spark, sf_dir):
    return _phrases(spark, sf_dir).select("o_orderkey", F.inline(A.numbers(F.col("text")))).select("o_orderkey", "kind", "value")


def q_flight_callsigns(spark, sf_dir):
    return _phrases(spark, sf_dir).select("o_orderkey", A.callsign(F.col("text")).alias("candidate"), F.array_join(A.digit_runs(F.col("text")), "|").alias("runs"))


def q_callsign_clues(spark, sf_dir):
    """Every other 'KLM' misheard as 'QNH'."""
    said = _phrases(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 12 == 4, F.replace("text", F.lit("KLM"), F.lit("QNH"))).otherwise(F.col("text")).alias("text"))
    craft = _table(spark, sf_dir, "customer").filter("c_custkey < 60").select(
        F.concat(F.lit("KLM"), F.col("c_custkey") + 10, F.lit("AB")).alias("flight"), F.col("c_custkey").cast("string").alias("hex"), F.lit("B738").alias("type"), F.lit("PH").alias("reg"),
    )
    return C.callsign_clues(said, craft).select("id", "candidate", "hex", "flight", "type", "repaired_from")


def q_spoken_draughts(spark, sf_dir):
    return _phrases(spark, sf_dir).select("o_orderkey", F.explode(A.draughts(F.col("text"))).alias("metres"))


def _aircraft(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in ("KLM", "KLC", "TRA", "DLH", "BAW", "KLMX", "RYR")]), (F.pmod("c_custkey", F.lit(7)) + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(F.concat(code, F.col("c_custkey") % 400).alias("flight"), F.hex("c_custkey").alias("hex"), (F.col("c_nationkey") % 5 == 0).alias("on_ground"))


def _designators(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in ("KLM", "KLMX", "TRAA", "DLHH", "QTR")]), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select(F.concat(code, F.col("o_custkey") % 500).alias("candidate"))


def q_flight_match(spark, sf_dir):
    found = C.match_flights(_designators(spark, sf_dir), _aircraft(spark, sf_dir), "candidate", "flight")
    return found.select("candidate", "flight", F.round("score", 4).alias("score"))


def q_tail_match(spark, sf_dir):
    tails = _designators(spark, sf_dir).select(A.tail_of(F.col("candidate")).alias("tail"))
    return C.match_by_tail(tails, _aircraft(spark, sf_dir), "tail", "flight", "hex", "on_ground")


def q_near_miss_codes(spark, sf_dir):
    return C.near_miss_codes(_designators(spark, sf_dir), _aircraft(spark, sf_dir), "candidate", "flight")


def q_candidate_precedence(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 6).alias("k"), F.col("event_id").alias("heard_at"))
    mmsi = F.pmod(F.col("user_id") * 31 + F.col("heard_at") % 3, F.lit(50))
    pick = lambda k: rows.filter(F.col("k") == k).groupBy("user_id", mmsi.alias("mmsi")).agg(F.min("heard_at").alias("heard_at"))
    return C.union_by_precedence({name: pick(k) for k, name in enumerate(C.PRECEDENCE)}, ["user_id", "mmsi"])


def q_exchange_validation(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.size(F.split("text", " ")).alias("n"))
    exchanges = turns.groupBy("conv_id", (F.col("n") % 3).alias("exchange")).agg(
        F.array_union(F.collect_set("id"), F.array(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("chunk_ids"), F.concat(F.lit("Ship "), F.max("n") % 4).alias("vessel")
    ).filter("exchange > 0")
    names = turns.select("conv_id", F.concat(F.lit("SHIP "), F.col("n") % 2).alias("name")).distinct()
    found = C.validated_exchanges(exchanges, turns, names, "conv_id")
    return found.select("conv_id", "exchange", F.array_join("chunk_ids", ",").alias("chunk_ids"), "vessel")


def q_reply_contract(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), "text")
    kept = turns.filter("NOT (conv_id % 11 = 3 AND id = 1)")
    new = F.when((F.col("conv_id") % 5 == 0) & (F.col("id") == 0), F.concat("text", F.lit(" over"))).when((F.col("conv_id") % 13 == 4) & (F.col("id") == 1), " ").otherwise(F.col("text"))
    reply = kept.select("conv_id", F.when((F.col("conv_id") % 17 == 5) & (F.col("id") == 0), 99).otherwise(F.col("id")).alias("id"), new.alias("text"),
                        F.when((F.col("conv_id") % 10 == 0) & (F.col("id") == 0), 1).when((F.col("conv_id") % 7 == 2) & (F.col("id") == 1), 2).otherwise(0).alias("n_changes"))
    return C.reply_verdict(reply, turns, "conv_id")


def q_nmea_mmsi(spark, sf_dir):
    k = F.col("c_custkey") * 7919 % 1_000_000_007
    six = lambda i: F.floor(k / F.lit(64 ** (i % 4))) % 64
    armour = lambda c: F.char(F.when(c < 40, c + 48).otherwise(c + 56))
    payload = F.concat(*[armour(six(i)) for i in range(7)])
    head = F.when(F.col("c_custkey") % 9 == 0, "!XXVDM,1,").otherwise("!AIVDM,2,")
    sentence = F.concat(head, F.when(F.col("c_custkey") % 7 == 0, "2").otherwise("1"), F.lit(",,A,"), payload, F.lit("rest,0*00"))
    return _table(spark, sf_dir, "customer").select("c_custkey", C.nmea_mmsi(sentence).alias("mmsi"))


QUERIES = {f.__name__: f for f in (
    q_aviation_numbers, q_flight_callsigns, q_callsign_clues, q_spoken_draughts, q_flight_match, q_tail_match, q_near_miss_codes, q_candidate_precedence, q_exchange_validation, q_reply_contract, q_nmea_mmsi,
)}

_CRAFT = "craft AS (SELECT ['KLM', 'KLC', 'TRA', 'DLH', 'BAW', 'KLMX', 'RYR'][c_custkey % 7 + 1] AS code, (c_custkey % 400)::VARCHAR AS tail, printf('%X', c_custkey) AS hex, c_nationkey % 5 = 0 AS ground FROM customer)"
_ASKED = "asked AS (SELECT DISTINCT ['KLM', 'KLMX', 'TRAA', 'DLHH', 'QTR'][o_orderkey % 5 + 1] AS code, (o_custkey % 500)::VARCHAR AS tail FROM orders)"
#: Ratios of the codes above: one letter added to a code of three gives 600 / 7.
_NEAR = "CASE WHEN a.code = c.code THEN 100.0 WHEN starts_with(a.code, c.code) OR starts_with(c.code, a.code) THEN 600.0 / 7 END"

ORACLES = {
    "q_aviation_numbers": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'heading' ELSE 'altitude' END AS kind,
       CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 360 + 1 WHEN 1 THEN (o_orderkey % 400 + 10) * 100 ELSE (o_orderkey % 9 + 1) * 1000 + (o_orderkey // 10 % 9 + 1) * 100 END AS value
FROM orders WHERE o_orderkey % 6 < 3""",
    "q_flight_callsigns": """
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 4 THEN 'KLM' || (o_orderkey % 90 + 10) || 'AB' END AS candidate,
       CASE k WHEN 0 THEN lpad((o_orderkey % 360 + 1)::VARCHAR, 3, '0') WHEN 1 THEN lpad((o_orderkey % 400 + 10)::VARCHAR, 3, '0') WHEN 2 THEN (o_orderkey // 10 % 9 + 1)::VARCHAR
              WHEN 3 THEN (o_orderkey % 9 + 1) || '|' || (o_orderkey // 10 % 9 + 1) WHEN 4 THEN (o_orderkey % 90 + 10) || 'AB' ELSE '' END AS runs FROM o""",
    "q_callsign_clues": """
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 = 4 AS said, o_orderkey % 12 = 4 AS misheard, o_orderkey % 90 + 10 AS n FROM orders)
SELECT id, CASE WHEN said AND (NOT misheard OR n < 70) THEN 'KLM' || n || 'AB' END AS candidate, CASE WHEN said AND n < 70 THEN (n - 10)::VARCHAR END AS hex, CASE WHEN said AND n < 70 THEN 'KLM' || n || 'AB' END AS flight,
       CASE WHEN said AND n < 70 THEN 'B738' END AS type, CASE WHEN misheard AND n < 70 THEN 'QNH' END AS repaired_from FROM o""",
    "q_spoken_draughts": "SELECT o_orderkey, (o_orderkey % 9 + 1 + (o_orderkey // 10 % 9 + 1) / 10)::DOUBLE AS metres FROM orders WHERE o_orderkey % 6 = 3",
    "q_flight_match": f"""
WITH {_CRAFT}, {_ASKED},
m AS (SELECT DISTINCT a.code || a.tail AS candidate, c.code || c.tail AS flight, {_NEAR}::DOUBLE AS score FROM asked a JOIN craft c ON a.tail = c.tail),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, flight DESC) AS k FROM m WHERE score IS NOT NULL)
SELECT candidate, flight, round(score, 4) AS score FROM r WHERE k = 1""",
    "q_tail_match": f"""
WITH {_CRAFT}, {_ASKED}, one AS (SELECT tail, min(hex) AS hex FROM craft WHERE NOT ground GROUP BY tail HAVING count(DISTINCT hex) = 1)
SELECT DISTINCT tail, hex FROM asked JOIN one USING (tail)""",
    "q_near_miss_codes": f"WITH {_CRAFT}, {_ASKED} SELECT DISTINCT a.code, c.code AS own_code FROM asked a, craft c WHERE ({_NEAR}) IS NOT NULL",
    "q_candidate_precedence": """
WITH r AS (SELECT user_id, event_id % 6 AS k, event_id AS h, (user_id * 31 + event_id % 3) % 50 AS mmsi FROM events WHERE event_id % 6 < 5),
g AS (SELECT user_id, mmsi, k, min(h) AS heard_at FROM r GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, mmsi ORDER BY CASE k WHEN 1 THEN -1 ELSE k END) AS p FROM g)
SELECT user_id, mmsi, heard_at, ['spoken_callsign', 'journal_callsign', 'live_match', 'hint', 'partial_callsign'][k + 1] AS source FROM b WHERE p = 1""",
    "q_exchange_validation": """
WITH t AS (SELECT conv_id, turn AS id, len(string_split(text, ' ')) AS n FROM conversations),
e AS (SELECT conv_id, n % 3 AS exchange, list_distinct(list_concat(list(id), [0, 999])) AS ids, 'Ship ' || (max(n) % 4) AS vessel FROM t WHERE n % 3 > 0 GROUP BY conv_id, n % 3),
c AS (SELECT conv_id, exchange, unnest(ids) AS id FROM e),
o AS (SELECT conv_id, id, min(exchange) AS exchange FROM c JOIN (SELECT conv_id, id FROM t) USING (conv_id, id) GROUP BY ALL),
g AS (SELECT conv_id, exchange, array_to_string(list_sort(list(id)), ',') AS chunk_ids FROM o GROUP BY ALL)
SELECT conv_id, g.exchange::INTEGER AS exchange, chunk_ids,
       CASE WHEN upper(vessel) IN (SELECT 'SHIP ' || (n % 2) FROM t WHERE t.conv_id = g.conv_id) THEN upper(vessel) END AS vessel
FROM g JOIN e USING (conv_id, exchange)
UNION ALL
SELECT conv_id, -1, array_to_string(list_sort(list(id)), ','), NULL FROM t WHERE (conv_id, id) NOT IN (SELECT conv_id, id FROM o) GROUP BY conv_id""",
    "q_reply_contract": """
WITH t AS (SELECT conv_id, turn AS id, text FROM conversations),
r AS (SELECT conv_id, CASE WHEN conv_id % 17 = 5 AND id = 0 THEN 99 ELSE id END AS id, CASE WHEN conv_id % 5 = 0 AND id = 0 THEN text || ' over' WHEN conv_id % 13 = 4 AND id = 1 THEN ' ' ELSE text END AS new,
             CASE WHEN conv_id % 10 = 0 AND id = 0 THEN 1 WHEN conv_id % 7 = 2 AND id = 1 THEN 2 ELSE 0 END AS c FROM t WHERE NOT (conv_id % 11 = 3 AND id = 1)),
b AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, CASE WHEN t.id IS NULL THEN '1 unknown id' WHEN r.id IS NULL THEN '6 missing turn' WHEN trim(new) = '' THEN '3 empty text'
             WHEN trim(new) = trim(text) AND c > 0 THEN '4 declared a change it did not make' WHEN trim(new) <> trim(text) AND c = 0 THEN '5 undeclared rewrite' END AS why
      FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.id = r.id)
SELECT conv_id, min(why) IS NULL AS accepted, substr(min(why), 3) AS reason FROM b GROUP BY conv_id""",
    "q_nmea_mmsi": """
WITH k AS (SELECT c_custkey, c_custkey * 7919 % 1000000007 AS k FROM customer),
d AS (SELECT c_custkey, list_transform(range(0, 7), lambda i: k // [1, 64, 4096, 262144][i % 4 + 1] % 64) AS d FROM k),
v AS (SELECT c_custkey, list_reduce(d, lambda a, c: a * 64 + c) AS v FROM d)
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 7 <> 0 AND (v // 16) % 1073741824 > 0 THEN (v // 16) % 1073741824 END AS mmsi FROM v""",
}
