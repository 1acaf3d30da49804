"""Text and fuzzy queries over conversations, documents, benchmark, customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import indel_ratio
from ..operators import fuzzy

PROMPT = "Le la de que. The of and in this is Maas Approach, standing by on channel one six, el en der die und zu Motortanker Neptune."


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def q_hint_probes(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(T.hint_probes(F.col("text")), "|").alias("probes"))


def q_doc_frequency_filter(spark, sf_dir):
    probes = _turns(spark, sf_dir).select("conv_id", F.explode(T.hint_probes(F.col("text"))).alias("probe"))
    return fuzzy.document_frequency(probes, "conv_id", "probe").filter("n > 1")


def q_prompt_echo(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"(?<=[.\n])")).alias("piece"))
    marked = docs.select("doc_id", T.prompt_echo(F.col("piece"), F.lit(PROMPT)).alias("echo"))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sum(F.col("echo").cast("long")).alias("n_echo"))


def q_hallucination(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.split("text", r"\.")).alias("piece"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(T.hallucination(F.col("piece")).cast("long")).alias("n_made_up"))


#: The driver's texts have none of the words that the rules rewrite, so that some of their words stand in for them.
_GARBLED = (("the", "mass"), ("of", "draft"), ("and", "motor vets"), ("de", "letter"), ("la", "boys"), ("in", "cosine"), ("on", "approach"))


def _with_words(text, pairs):
    """text with some whole words replaced; words stand between spaces."""
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(table[w], w)), " ")


def _garbled(text):
    return _with_words(text, _GARBLED)


def q_corrections(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("raw", _garbled(F.col("text")))
    return rows.select("conv_id", "turn", F.md5(T.rule_corrections(F.col("raw")).cast("binary")).alias("corrected_md5"))


def q_station_corrections(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("raw", _garbled(F.col("text")))
    return rows.select("conv_id", "turn", T.corrections(F.col("raw")).alias("corrected"))


_SPELT = (("the", "alpha"), ("of", "bravo"), ("and", "seven"), ("de", "x-ray"), ("la", "niner"), ("que", "callsign"), ("in", "call sign"))


def _spelt(text):
    return _with_words(text, _SPELT)


def q_spelled_runs(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("raw", _spelt(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.array_join(T.spelled_runs(F.col("raw")), "|").alias("runs"), F.array_join(T.phonetic_probes(F.col("raw")), "|").alias("probes"),
    )


def q_partial_pattern(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.split(_spelt(F.col("text")), r"[.,\n]")).alias("piece"))
    found = rows.withColumn("pattern", T.partial_pattern(F.concat(F.lit("callsign "), "piece")))
    return found.filter("pattern IS NOT NULL").groupBy("conv_id", "pattern").agg(F.count("*").alias("n"))


def q_indel_topk(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_name", F.reverse("p_type").alias("t"))
    probes = parts.select(F.regexp_replace("p_name", "[aeo]", "").alias("probe")).distinct()
    return fuzzy.top_names(fuzzy.similar_pairs(probes, parts, "probe", "p_name", 76.0), 3).select("probe", "name", F.round("score", 4).alias("score"), "rank")


def q_ambiguous_names(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_name")
    probes = parts.select(F.concat(F.substring("p_name", 1, 6), F.lit("x")).alias("probe")).distinct()
    found = fuzzy.ambiguous(fuzzy.similar_pairs(probes, parts, "probe", "p_name", 60.0), 3.0)
    return found.groupBy("probe").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


def q_shortlist(spark, sf_dir):
    """J16 over whole turns: ships are the different part names, each borne by its first part."""
    ships = _table(spark, sf_dir, "part").groupBy(F.upper("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("mmsi"))
    probes = _turns(spark, sf_dir).select("conv_id", F.posexplode(T.hint_probes(F.col("text"))).alias("pos", "probe"))
    probes = probes.groupBy("conv_id", "probe").agg(F.min("pos").alias("pos"))
    return fuzzy.shortlist(probes, ships, "conv_id").select("conv_id", "mmsi", "name", "score", "heard", "rank")


def q_indel_same_length(spark, sf_dir):
    """T1 on pairs of neighbours, against nested list functions."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("a"), F.lower(F.concat(F.substring("c_mktsegment", 3, 4), "c_name")).alias("b"))
    return rows.select("c_custkey", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (
    q_hint_probes, q_doc_frequency_filter, q_prompt_echo, q_hallucination, q_corrections, q_station_corrections, q_spelled_runs, q_partial_pattern, q_indel_topk,
    q_ambiguous_names, q_shortlist, q_indel_same_length,
)}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _replaced(text: str, pairs) -> str:
    cases = " ".join(f"WHEN '{word}' THEN '{stand_in}'" for word, stand_in in pairs)
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda v: CASE v {cases} ELSE v END), ' ')"


def _ruled(text: str) -> str:
    text = f"regexp_replace({text}, '\\b(letter|leather)(\\s+of)\\b', 'le~~er\\2', 'gi')"
    for pattern, replacement in T.SHARED_RULES + T.MARITIME_RULES:
        if "(?=" in pattern:
            pattern, replacement = pattern.replace("(?=\\s)", "(\\s)"), replacement + "\\1"
        text = f"regexp_replace({text}, '{pattern.replace('(?!\\s+of\\b)', '')}', '{replacement}', 'gi')"
    return f"replace({text}, 'le~~er', 'letter')"


#: LCS by dynamic programming over lists, for the ratio of two strings.
def _lcs(a: str, b: str) -> str:
    return f"""list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda q: 0::BIGINT), list_transform(range(1, length({a}) + 1), lambda i: [i::BIGINT])),
  lambda prev, cur: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j::BIGINT])),
    lambda done, j: list_append(done, CASE WHEN substr({a}, cur[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[j[1]]) END)))[length({b}) + 1]"""


_PROBES = f"""
turns AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '\\s+'), lambda w: w <> ''), lambda w: trim(w, '.,!?;:')) AS w FROM conversations),
sized AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM turns),
spans AS (SELECT conv_id, turn, n, i, list_slice(w, i, i + n - 1) AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM sized)),
useful AS (
  SELECT *, array_to_string(s, ' ') AS probe FROM spans
  WHERE list_max(list_transform(s, lambda x: length(x))) >= 4 AND len(list_filter(s, lambda x: NOT list_contains({_list(T.PROBE_STOPWORDS)}, x))) > 0
)"""

_DECODED = f"""
said AS (SELECT conv_id, turn, regexp_extract_all(lower({_replaced('text', _SPELT)}), '[a-z0-9''-]+') AS w FROM conversations),
word AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM said),
decoded AS (
  SELECT conv_id, turn, i, CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in (T.LETTERS | T.DIGITS).items())}
         ELSE CASE WHEN regexp_matches(w, '^[a-z0-9]{{1,8}}$') AND (length(w) = 1 OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]'))) THEN upper(w) END END AS c,
         CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in (T.LETTERS | T.DIGITS).items())} ELSE CASE WHEN regexp_matches(w, '^[a-z0-9]$') THEN upper(w) END END AS p,
         w IN ({', '.join(f"'{k}'" for k in T.LETTERS)}) AS letter
  FROM word
)"""


def _run_sql(col: str, having: str = "true") -> str:
    return f"""(SELECT conv_id, turn, string_agg(run, '|' ORDER BY first) AS runs FROM (
  SELECT conv_id, turn, g, min(i) AS first, string_agg({col}, '' ORDER BY i) AS run FROM (
    SELECT *, sum(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM decoded) WHERE {col} IS NOT NULL GROUP BY conv_id, turn, g HAVING {having}
) GROUP BY conv_id, turn)"""


_PARTS = "SELECT DISTINCT regexp_replace(p_name, '[aeo]', '', 'g') AS probe FROM part"

ORACLES = {
    "q_hint_probes": f"""WITH {_PROBES}
SELECT t.conv_id, t.turn, coalesce(p.probes, '') AS probes FROM conversations t
LEFT JOIN (SELECT conv_id, turn, string_agg(probe, '|' ORDER BY n, i) AS probes FROM useful GROUP BY ALL) p USING (conv_id, turn)""",
    "q_doc_frequency_filter": f"""WITH {_PROBES}
SELECT probe, count(DISTINCT conv_id) AS n FROM useful WHERE n <= 4 GROUP BY probe
HAVING count(DISTINCT conv_id) > 1 AND count(DISTINCT conv_id) <= 0.05 * (SELECT count(DISTINCT conv_id) FROM useful WHERE n <= 4)""",
    "q_prompt_echo": f"""
WITH raw AS (SELECT doc_id, regexp_extract_all(text, '[^.\\n]*[.\\n]|[^.\\n]+$') AS pieces, text FROM documents),
piece AS (SELECT doc_id, unnest(CASE WHEN text = '' THEN [''] WHEN right(text, 1) IN ('.', chr(10)) THEN list_append(pieces, '') ELSE pieces END) AS p FROM raw),
w AS (SELECT doc_id, regexp_extract_all(lower(p), '[a-z0-9'']+') AS w FROM piece),
prompt AS (SELECT regexp_extract_all(lower('{PROMPT}'), '[a-z0-9'']+') AS q),
e AS (SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(q, x))) = 0
             AND (len(w) >= 6 OR len(list_filter(w, lambda x: NOT list_contains({_list(T.GENERIC_WORDS)}, x))) > 0) AS echo FROM w, prompt)
SELECT doc_id, count(*) AS n_pieces, sum(CASE WHEN echo THEN 1 ELSE 0 END)::BIGINT AS n_echo FROM e GROUP BY doc_id""",
    "q_corrections": f"SELECT conv_id, turn, md5({_ruled(_replaced('text', _GARBLED))}) AS corrected_md5 FROM conversations",
    "q_spelled_runs": f"""WITH {_DECODED}
SELECT t.conv_id, t.turn, coalesce(a.runs, '') AS runs, coalesce(b.runs, '') AS probes FROM conversations t LEFT JOIN {_run_sql('c')} a USING (conv_id, turn)
LEFT JOIN {_run_sql('p', "length(string_agg(p, '')) >= 3 AND count(CASE WHEN letter THEN 1 END) >= 2")} b USING (conv_id, turn)""",
    "q_indel_topk": f"""
WITH probes AS ({_PARTS}), names AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT probe, name, 200.0::DOUBLE * {_lcs('probe', 'name')} / (length(probe) + length(name)) AS score FROM probes, names WHERE probe <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS rank FROM s WHERE score >= 76)
SELECT probe, name, round(score, 4) AS score, rank FROM r WHERE rank <= 3""",
    "q_ambiguous_names": f"""
WITH probes AS (SELECT DISTINCT substr(p_name, 1, 6) || 'x' AS probe FROM part), names AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT probe, name, 200.0::DOUBLE * {_lcs('probe', 'name')} / (length(probe) + length(name)) AS score FROM probes, names),
b AS (SELECT *, max(score) OVER (PARTITION BY probe) AS best FROM s WHERE score >= 60)
SELECT probe, count(*) AS n, round(max(score), 4) AS best FROM b WHERE score >= best - 3 GROUP BY probe""",
    "q_indel_same_length": f"""
WITH r AS (SELECT c_custkey, lower(c_mktsegment) AS a, lower(substr(c_mktsegment, 3, 4) || c_name) AS b FROM customer)
SELECT c_custkey, round(200.0::DOUBLE * {_lcs('a', 'b')} / (length(a) + length(b)), 6) AS ratio FROM r""",
}
