"""Signal queries: embeddings as arrays of samples, the values of each user's events as frames of power."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signal as S
from ..functions.time import micros
from ..operators import radio
from ..operators import signal as O

#: The embeddings as recordings: fifty vectors each, ten in a block.
RATE, BLOCK, RECEIVER = 40_000, 640, radio.Receiver(16_000, 1000.0)


def _arrays(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _frames(spark, sf_dir):
    """Frames numbered in time within each user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", micros("ts").alias("t"), "value")
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    return rows.select("user_id", (F.row_number().over(order) - 1).alias("frame"), "value")


def _digest(column):
    """Sum and last value, rounded: enough to hold an array against another engine's."""
    return [F.round(F.aggregate(column, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(column).alias("n")]


def q_rms(spark, sf_dir):
    return _arrays(spark, sf_dir).select("vec_id", F.round(S.rms(F.col("embedding")), 9).alias("rms"))


def q_normalize_array(spark, sf_dir):
    rows = _arrays(spark, sf_dir).withColumn("y", S.normalize(F.col("embedding"), 2.0))
    return rows.select("vec_id", F.round(F.array_max("y"), 6).alias("top"), *_digest("y"))


def q_dc_block(spark, sf_dir):
    rows = _arrays(spark, sf_dir).withColumn("y", S.by_rows(F.col("embedding"), S.dc_block))
    return rows.select("vec_id", *_digest("y"), F.round(F.element_at("y", -1), 6).alias("last"))


def q_high_pass(spark, sf_dir):
    rows = _arrays(spark, sf_dir).withColumn("y", S.by_rows(F.col("embedding"), lambda x: S.high_pass(x, 16000.0)))
    return rows.select("vec_id", *_digest("y"), F.round(F.element_at("y", -1), 6).alias("last"))


def q_resample(spark, sf_dir):
    rows = S.conditioned(_arrays(spark, sf_dir).withColumnRenamed("embedding", "y"), "y", 37500.0)
    return rows.select("vec_id", *_digest("y"))


def q_noise_floor(spark, sf_dir):
    return O.noise_floor(_frames(spark, sf_dir), "user_id", "value").select("user_id", F.round("floor", 9).alias("floor"), "n_frames")


def q_segments(spark, sf_dir):
    found = O.segments(_frames(spark, sf_dir), "user_id", "frame", "value", 10.0, margin=10.0, hang_ms=300, least_ms=200, pad_ms=100)
    return found.select("user_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def q_squelch(spark, sf_dir):
    followed = O.squelch(_frames(spark, sf_dir), "user_id", "frame", "value", 25.0, 1000.0)
    return followed.groupBy("user_id").agg(F.sum(F.col("open").cast("long")).alias("n_open"), F.round(F.max("level"), 6).alias("top"))


def q_vad_segments(spark, sf_dir):
    config = O.Vad(onset=2, onset_of=4, pre_roll=2, hang=3, tail=1, longest=30, least_active=2, least_ratio=0.1, floor=5.0, window=20)
    return O.voice_activity(_frames(spark, sf_dir), "user_id", "frame", "value", config)


def q_channel_power(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumn("im", F.col("value") / 2)
    return O.channel_power(rows, "user_id", "frame", "value", "im", 8).select("user_id", "frame", F.round("power_db", 6).alias("power_db"))


def embedding_blocks(spark, sf_dir):
    parts = _arrays(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 50).alias("capture"), F.floor(F.col("vec_id") % 50 / 10).alias("block"))
    rows = parts.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    return rows.select("capture", "block", F.flatten("v.embedding").alias("re"), F.flatten(F.transform("v.embedding", F.reverse)).alias("im"))


def q_demodulated(spark, sf_dir):
    audio, _ = radio.demodulated(embedding_blocks(spark, sf_dir), RATE, BLOCK, RECEIVER)
    return audio.select("capture", "block", *_digest("samples"))


def q_channel_frames(spark, sf_dir):
    _, power = radio.demodulated(embedding_blocks(spark, sf_dir), RATE, BLOCK, RECEIVER)
    return power.select("capture", "frame", F.round("power", 6).alias("power"))


def q_replay_arms(spark, sf_dir):
    """Clips of two arms, one of them gated, along one cut list."""
    arms = {"wide": RECEIVER, "gated": radio.Receiver(8000, 1000.0)}
    clips, _ = radio.replay(embedding_blocks(spark, sf_dir), RATE, BLOCK, arms, {"gated": 1.0}, margin=2.0, hang_ms=3, least_ms=2, pad_ms=1)
    return clips.select("arm", "capture", "segment", *_digest("samples"))


QUERIES = {f.__name__: f for f in (
    q_rms, q_normalize_array, q_dc_block, q_high_pass, q_resample, q_noise_floor, q_segments, q_squelch, q_vad_segments, q_channel_power, q_demodulated, q_channel_frames, q_replay_arms,
)}

_FRAMES = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events)"

ORACLES = {
    "q_rms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms FROM embeddings",
    "q_normalize_array": """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings),
g AS (SELECT vec_id, list_transform(e, lambda x: x * (pow(10, 0.1::DOUBLE) / peak)) AS y FROM p),
y AS (SELECT vec_id, list_transform(y, lambda x: CASE WHEN abs(x) > 0.98 THEN sign(x) * (0.98::DOUBLE + 0.02::DOUBLE * tanh((abs(x) - 0.98::DOUBLE) / 0.02::DOUBLE)) ELSE x END) AS y FROM g)
SELECT vec_id, round(list_max(y), 6) AS top, round(list_sum(y), 6) AS total, len(y)::INTEGER AS n FROM y""",
    "q_dc_block": """
WITH d AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x, i: x::DOUBLE - CASE WHEN i > 1 THEN embedding[i - 1]::DOUBLE ELSE 0 END) AS d FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(d, lambda x, i: x * (1 - pow(0.995::DOUBLE, n - i + 1)) / 0.005::DOUBLE)), 6) AS total, n::INTEGER AS n,
       round(list_sum(list_transform(d, lambda x, i: x * pow(0.995::DOUBLE, n - i))), 6) AS "last" FROM d""",
    "q_noise_floor": f"WITH {_FRAMES} SELECT user_id, round(quantile_cont(value, 0.2), 9) AS floor, count(*) AS n_frames FROM f GROUP BY user_id",
    "q_segments": f"""
WITH {_FRAMES}, k AS (SELECT user_id, quantile_cont(value, 0.2) + 10 AS bar, count(*) AS n FROM f GROUP BY user_id),
a AS (SELECT f.user_id, frame, n, CASE WHEN frame - lag(frame) OVER (PARTITION BY f.user_id ORDER BY frame) > 3 THEN 1 ELSE 0 END AS o FROM f JOIN k USING (user_id) WHERE value >= bar),
r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM a),
s AS (SELECT user_id, min(frame) AS a, max(frame) + 1 AS b, any_value(n) AS n FROM r GROUP BY user_id, run)
SELECT user_id, round(greatest(0, a / 10 - 0.1), 6) AS start_s, round(least(n / 10, b / 10 + 0.1), 6) AS end_s FROM s WHERE b - a >= 2""",
    "q_channel_power": f"""WITH {_FRAMES}
SELECT user_id, frame // 8 AS frame, round(10 * log10(greatest(avg(value * value + value / 2 * (value / 2)), 1e-12)), 6) AS power_db FROM f GROUP BY user_id, frame // 8""",
}
