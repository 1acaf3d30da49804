"""Evaluation and view queries: benchmark items as references, documents as transcripts, labels as truth, events as runs and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import micros, seconds
from ..operators import evaluation as E
from ..operators import views as V


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark, sf_dir):
    refs = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    hyps = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("hyp"), "source")
    return refs.join(hyps, "item_id")


def q_wer_pooled(spark, sf_dir):
    counted = E.error_counts(_pairs(spark, sf_dir), "ref", "hyp")
    return counted.groupBy("source").agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("words"), F.round(E.pooled_wer(F.col("edits"), F.col("ref_words")), 9).alias("wer"))


def q_wer_macro(spark, sf_dir):
    counted = E.error_counts(_pairs(spark, sf_dir), "ref", "hyp").withColumn("wer", F.col("edits") / F.col("ref_words"))
    return counted.agg(F.count("wer").alias("n"), F.round(F.avg("wer"), 9).alias("mean"), F.round(F.median("wer"), 9).alias("median"), F.round(E.floor_percentile(F.col("wer"), 0.95), 9).alias("p95"))


def q_substitutions(spark, sf_dir):
    return E.substitutions(_pairs(spark, sf_dir), "ref", "hyp")


def q_precision_recall(spark, sf_dir):
    """Truth: a labelled document's source if it is good, nobody if not; prediction: by its length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    truth = F.when(F.col("quality") == 1, F.col("source"))
    predicted = F.when(F.col("n_chars") % 5 != 0, F.when(F.col("n_chars") % 3 == 0, "src0").otherwise(F.col("source")))
    return E.precision_recall(rows.withColumn("outcome", E.label_outcome(truth, predicted)), "outcome", "lang")


def q_outcome_split(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("quality").isNull(), "UNSURE").when(F.col("quality") == 0, "NONE").otherwise(F.col("source"))
    tagged = F.when(F.col("n_chars") % 4 == 0, F.when(F.col("n_chars") % 3 == 0, "src0").otherwise(F.col("source")))
    candidate = F.when(F.col("n_chars") % 2 == 0, F.col("source"))
    in_range = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 5 != 0)
    return rows.groupBy(E.outcome_split(label, tagged, candidate, in_range).alias("bucket")).agg(F.count("*").alias("n"))


def q_repeat_spread(spark, sf_dir):
    """Runs are days of the month mod 5, metrics event types; every third run of a metric is undefined."""
    rows = _table(spark, sf_dir, "events").select("event_type", (F.floor(seconds("ts") / 86400) % 5).alias("run"), "value")
    scores = rows.groupBy("event_type", "run").agg(F.round(F.avg("value"), 6).alias("v"))
    scores = scores.withColumn("v", F.when((F.col("run") + F.length("event_type")) % 3 != 0, F.col("v")))
    return E.repeat_spread(scores, "event_type", "v").select("event_type", "mean", "low", "high", "spread", "runs_defined")


def q_stability(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", (F.floor(seconds("ts") / 86400) % 2).alias("run"), "event_type", F.floor(F.col("value") / 200).alias("predicted"))
    return E.stability(rows, "user_id", "run", "event_type", "predicted", 2)


def q_arm_pairing(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), (F.col("user_id") * 8 + F.col("event_id") % 8).alias("clip"), F.when(F.col("value") > 60, "boom").alias("error"),
        F.when(F.col("user_id") % 9 != 0, "said").alias("reference"),
    )
    return E.paired_scores(rows, "arm", "clip", "error", "reference", 5)


ITERATIONS, SEED = 5000, 20240101


def q_bootstrap_ci(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    clips = labels.select("doc_id", (F.col("doc_id") * 7 % 5 + F.col("toxic")).alias("ea"), (F.col("doc_id") % 11 + 5).alias("wa"), (F.col("doc_id") * 3 % 4 + 1 - F.col("quality")).alias("eb"), (F.col("doc_id") % 11 + 5).alias("wb"))
    return E.bootstrap_ci(clips, "doc_id", ("ea", "wa"), ("eb", "wb"), ITERATIONS, SEED)


def q_ref_check(spark, sf_dir):
    captures = _table(spark, sf_dir, "documents").select("doc_id")
    refs = _table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.when(F.col("toxic") == 1, " ").otherwise("said").alias("text"))
    return E.reference_check(refs, captures, "doc_id", "text").groupBy("finding").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def q_top_movers(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))), 2).alias("change")
    )
    return E.movers(orders, F.col("change"), "o_custkey").select("o_custkey", "delta")


def q_percentile_floor(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return E.floor_percentile_rows(rows, "l_returnflag", "l_extendedprice", 0.95)


def q_echo_gate(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("call"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") + F.when(F.col("event_id") % 41 == 0, 1).otherwise(0)).alias("echo")
    )
    return E.echo_gate(rows)


def q_run_health(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "HTTP 503").alias("error"), F.when(F.col("user_id") % 4 != 0, "x").alias("text"))
    return E.run_health(rows, "error", "text", "user_id")


def q_page_search(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").filter(V.haystack(F.col("role"), F.col("text")).contains("er"))
    found = V.page(turns, [F.col("conv_id").desc(), "turn"], 500, 20)
    return found.select("conv_id", "turn", "role")


def q_wildcard_search(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    return parts.filter(F.col("p_name").rlike(V.wildcard("r?d*t"))).select("p_partkey", "p_name")


def q_strips(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("key"), micros("ts").alias("at"), "event_id", F.when(F.col("event_type") == "view", F.col("props")).alias("state"),
        F.when(F.col("event_type") == "signup", F.col("event_type")).alias("moved"),
    )
    return V.strips(rows, "key", "at", "event_id", "state", "moved")


def q_live_match_state(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("vessel"), F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("mmsi"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("age"),
    )
    return rows.select("event_id", V.live_match_state(F.col("vessel"), F.col("mmsi"), F.col("age"), 6.0).alias("state"), V.label(F.col("vessel"), F.col("mmsi")).alias("label"))


def q_combine_clues(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 4 != 0, F.concat("event_type", F.lit("-"), "user_id")).alias("candidate"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("call"),
        F.when(F.col("event_id") % 5 < 2, (F.col("user_id") + F.col("event_id") % 2).cast("string")).alias("echo"),
    )
    return rows.select("event_id", F.inline(F.array(V.combine_clues(F.col("candidate"), F.col("call"), F.col("echo")))))


def q_json_props(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("p.k").alias("n"), F.max("p.k").alias("top"))


def q_move_targets(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error')").select(
        F.when(F.col("event_type") == "error", "review").otherwise(F.concat(F.lit("f"), F.col("user_id") % 10)).alias("key"), seconds("ts").alias("at")
    )
    return V.move_targets(rows, "key", "at", 600)


QUERIES = {f.__name__: f for f in (
    q_wer_pooled, q_wer_macro, q_substitutions, q_precision_recall, q_outcome_split, q_repeat_spread, q_stability, q_arm_pairing, q_bootstrap_ci, q_ref_check, q_top_movers,
    q_percentile_floor, q_echo_gate, q_run_health, q_page_search, q_wildcard_search, q_strips, q_live_match_state, q_combine_clues, q_json_props, q_move_targets,
)}

#: DuckDB's levenshtein counts bytes; a reference here has fewer than 90 different words, so each word gets one ASCII character.
_WER = """
p AS (
  SELECT b.item_id, d.source, regexp_extract_all(lower(regexp_replace(b.text, '\\[[^\\]]*\\]', ' ', 'g')), '[a-z0-9'']+') AS r,
         regexp_extract_all(lower(regexp_replace(d.text, '\\[[^\\]]*\\]', ' ', 'g')), '[a-z0-9'']+') AS h
  FROM benchmark b JOIN documents d ON b.item_id = d.doc_id
), v AS (SELECT *, list_distinct(r) AS vocab FROM p),
c AS (
  SELECT item_id, source, len(r) AS words, levenshtein(array_to_string(list_transform(r, lambda x: chr(CAST(34 + list_position(vocab, x) AS INTEGER))), ''),
         array_to_string(list_transform(h, lambda x: CASE WHEN list_contains(vocab, x) THEN chr(CAST(34 + list_position(vocab, x) AS INTEGER)) ELSE '!' END), '')) AS edits
  FROM v WHERE len(r) > 0
)"""


def _drawn(i: str) -> str:
    x = f"(({i} * 40503 + {SEED}) % 2147483648)"
    for k, factor in enumerate((48271, 69621, 16807)):
        x = f"list_transform([{x}], lambda y{k}: (xor(y{k}, y{k} // 65536) * {factor} + 12345) % 2147483648)[1]"
    return x


_CRC = """
poly(i, v, step) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, step + 1 FROM poly WHERE step < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE step = 8)"""
_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])))"

ORACLES = {
    "q_wer_pooled": f"WITH {_WER} SELECT source, sum(edits)::BIGINT AS edits, sum(words)::BIGINT AS words, round(sum(edits) / sum(words), 9) AS wer FROM c GROUP BY source",
    "q_wer_macro": f"""WITH {_WER}, w AS (SELECT edits / words AS wer FROM c)
SELECT count(*) AS n, round(avg(wer), 9) AS mean, round(median(wer), 9) AS median, round(list_sort(list(wer))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1], 9) AS p95 FROM w""",
    "q_precision_recall": """
WITH r AS (
  SELECT lang, CASE WHEN quality = 1 THEN source END AS truth, CASE WHEN n_chars % 5 <> 0 THEN CASE WHEN n_chars % 3 = 0 THEN 'src0' ELSE source END END AS pred
  FROM documents JOIN labels USING (doc_id)
), o AS (SELECT lang, CASE WHEN truth IS NULL AND pred IS NULL THEN 'correct_null' WHEN truth IS NULL THEN 'wrong' WHEN pred IS NULL THEN 'missed' WHEN truth = pred THEN 'correct' ELSE 'wrong' END AS o FROM r),
n AS (SELECT lang, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'wrong') AS wrong, count(*) FILTER (o = 'missed') AS missed, count(*) FILTER (o = 'correct_null') AS correct_null FROM o GROUP BY lang)
SELECT *, round(correct / nullif(correct + wrong, 0), 9) AS precision, round(correct / nullif(correct + wrong + missed, 0), 9) AS recall FROM n""",
    "q_outcome_split": """
WITH r AS (
  SELECT CASE WHEN quality IS NULL THEN 'UNSURE' WHEN quality = 0 THEN 'NONE' ELSE source END AS label, CASE WHEN n_chars % 4 = 0 THEN CASE WHEN n_chars % 3 = 0 THEN 'src0' ELSE source END END AS tag,
         CASE WHEN n_chars % 2 = 0 THEN source END AS cand, CASE WHEN n_chars % 7 <> 0 THEN n_chars % 5 <> 0 END AS near
  FROM documents LEFT JOIN labels USING (doc_id)
)
SELECT CASE WHEN label = 'UNSURE' THEN 'excluded' WHEN label = 'NONE' THEN CASE WHEN tag IS NOT NULL THEN 'wrong_match' ELSE 'correct_rejection' END
            WHEN tag IS NOT NULL THEN CASE WHEN tag = label THEN 'correct' ELSE 'wrong_match' END WHEN near IS NULL THEN 'excluded' WHEN NOT near THEN 'retrieval_miss'
            WHEN cand IS NULL THEN 'extraction_miss' ELSE 'selection_miss' END AS bucket, count(*) AS n FROM r GROUP BY 1""",
    "q_repeat_spread": """
WITH s AS (SELECT event_type, epoch_us(ts) // 86400000000 % 5 AS run, round(avg(value), 6) AS v FROM events GROUP BY ALL),
d AS (SELECT event_type, CASE WHEN (run + length(event_type)) % 3 <> 0 THEN v END AS v FROM s)
SELECT event_type, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(coalesce(max(v) - min(v), 0), 6) AS spread, count(v) AS runs_defined FROM d GROUP BY event_type""",
    "q_stability": """
WITH r AS (SELECT user_id, epoch_us(ts) // 86400000000 % 2 AS run, event_type, floor(value / 200) AS p FROM events),
g AS (SELECT user_id, count(DISTINCT run) AS runs_present, count(DISTINCT event_type) AS n_outcomes, count(DISTINCT p) AS n_predictions FROM r GROUP BY user_id)
SELECT *, runs_present = 2 AND n_outcomes = 1 AND n_predictions = 1 AS stable FROM g""",
    "q_arm_pairing": """
WITH r AS (SELECT event_type AS arm, user_id * 8 + event_id % 8 AS clip, CASE WHEN value > 60 THEN 1 END AS err, user_id % 9 <> 0 AS has_ref FROM events)
SELECT clip, CASE WHEN NOT bool_and(has_ref) THEN 'no_reference' WHEN count(err) > 0 THEN 'errored' ELSE 'scored' END AS status FROM r GROUP BY clip HAVING count(DISTINCT arm) = 5""",
    "q_bootstrap_ci": f"""
WITH RECURSIVE {_CRC},
c AS (SELECT doc_id, doc_id * 7 % 5 + toxic AS ea, doc_id % 11 + 5 AS wa, doc_id * 3 % 4 + 1 - quality AS eb FROM labels),
part AS (SELECT c.*, {_CRC_OF.format(s='doc_id::VARCHAR')} % 1024 AS part FROM c, crc_table),
k AS (SELECT *, row_number() OVER (ORDER BY part, doc_id) - 1 AS clip FROM part),
n AS (SELECT count(*) AS n FROM c),
draws AS (SELECT i // n AS iteration, {_drawn('i')} % n AS clip FROM (SELECT unnest(range(0, {ITERATIONS} * n)) AS i, n FROM n)),
s AS (SELECT iteration, sum(eb) / sum(wa) - sum(ea) / sum(wa) AS delta FROM draws JOIN k USING (clip) GROUP BY iteration),
l AS (SELECT list_sort(list(delta)) AS d FROM s)
SELECT round(d[CAST(floor(0.025::DOUBLE * len(d)) AS INTEGER) + 1], 9) AS low, round(d[CAST(floor(0.975::DOUBLE * (len(d) - 1)) AS INTEGER) + 1], 9) AS high, CAST(len(d) AS INTEGER) AS n FROM l""",
    "q_ref_check": """
WITH r AS (SELECT doc_id * 2 AS doc_id, toxic FROM labels), f AS (
  SELECT doc_id, 'missing' AS finding FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)
  UNION ALL SELECT doc_id, 'extra' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, 'empty' FROM r WHERE toxic = 1)
SELECT finding, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM f GROUP BY finding""",
    "q_top_movers": """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), 2) AS delta FROM orders GROUP BY o_custkey
HAVING round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), 2) <> 0 ORDER BY abs(delta) DESC, o_custkey LIMIT 12""",
    "q_percentile_floor": """
SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS value FROM lineitem GROUP BY l_returnflag""",
    "q_echo_gate": """
WITH r AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS c, CASE WHEN event_id % 3 <> 0 THEN user_id + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END END AS e FROM events),
n AS (SELECT count(*) FILTER (c IS NOT NULL AND e IS NOT NULL) AS overlap, count(*) FILTER (c = e) AS agree, count(*) FILTER (c IS NULL) AS no_call, count(*) FILTER (c IS NULL AND e IS NOT NULL) AS recovered FROM r)
SELECT overlap, agree, round(agree / overlap, 9) AS agreement, recovered, round(recovered / no_call, 9) AS recovery, overlap >= 50 AND agree / overlap >= 0.95 AND recovered / no_call >= 0.1 AS passes FROM n""",
    "q_run_health": """
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed,
       CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'all_failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'some_failed' WHEN user_id % 4 = 0 THEN 'all_empty' ELSE 'healthy' END AS state
FROM events GROUP BY user_id""",
    "q_page_search": "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(role || ' ' || text), 'er') ORDER BY conv_id DESC, turn LIMIT 200 OFFSET 20",
    "q_wildcard_search": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?is)r.d.*t')",
    "q_strips": """
WITH r AS (SELECT user_id % 40 AS key, epoch_us(ts) AS at_us, event_id, CASE WHEN event_type = 'signup' THEN event_type WHEN event_type = 'view' THEN props END AS s FROM events)
SELECT key, count(*) AS n, max(at_us) AS last_at, arg_max(s, (at_us, event_id)) FILTER (s IS NOT NULL) AS state FROM r GROUP BY key""",
    "q_live_match_state": """
WITH r AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS v, CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR END AS m, CASE WHEN event_id % 5 <> 0 THEN value END AS age FROM events)
SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN m IS NULL THEN 'heard-only' WHEN age IS NULL THEN 'ais-matched' WHEN age <= 6 THEN 'ais-confirmed' ELSE 'ais-stale' END AS state,
       coalesce(v || ' (' || m || ')', v, m, 'unidentified') AS label FROM r""",
    "q_combine_clues": """
WITH r AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type || '-' || user_id END AS c, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS h, CASE WHEN event_id % 5 < 2 THEN (user_id + event_id % 2)::VARCHAR END AS e FROM events),
k AS (SELECT *, CASE WHEN c IS NOT NULL AND h IS NULL THEN 1 WHEN h <> e THEN 2 WHEN h = e THEN 3 WHEN h IS NOT NULL THEN 4 WHEN e IS NOT NULL THEN 5 ELSE 6 END AS k FROM r)
SELECT event_id, ['unknown', 'review', 'flight', 'flight', 'flight', 'unassigned'][k] AS kind,
       CASE k WHEN 1 THEN 'heard:' || substr(regexp_replace(upper(c), '[^A-Z0-9]', '', 'g'), 1, 12) WHEN 2 THEN 'review' WHEN 6 THEN 'unassigned' WHEN 5 THEN e ELSE h END AS key,
       ['unknown', 'conflict', 'confirmed', 'callsign', 'echo', 'none'][k] AS badge FROM k""",
    "q_json_props": "SELECT event_type, sum(CAST(props->>'k' AS INTEGER))::BIGINT AS total, count(*) AS n, max(CAST(props->>'k' AS INTEGER)) AS top FROM events GROUP BY event_type",
    "q_move_targets": """
WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'review' ELSE 'f' || (user_id % 10) END AS key, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT DISTINCT key, t FROM r WHERE key <> 'review')
SELECT r.key AS own, f.key AS target, count(*) AS n FROM r JOIN f ON abs(r.t - f.t) <= 600 AND r.key <> f.key GROUP BY ALL""",
}
