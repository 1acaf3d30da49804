"""The findings of round 4: a small case of each that failed before."""

import duckdb
from pyspark.sql import functions as F

from voxlake.functions import display
from voxlake.operators import conversations, signal
from voxlake.plans import panel
from voxlake.plans import signal as plans


def test_f1_frames_on_the_bar_to_the_last_bit(spark, tmp_path):
    users = [[1.0, 2.18, 12.19, 12.19, 2.23, 3.0, 3.0], [1.0, 1.73, 11.79, 11.79, 1.83, 3.0, 3.0, 3.0, 3.0]]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    for user, values in enumerate(users):
        con.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ?, ?, ?)", [(100 * user + i, i, user, v) for i, v in enumerate(values)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(plans.ORACLES["q_segments"]).fetchall()
    assert want == [(0, 0.1, 0.5)]
    assert [tuple(r) for r in plans.q_segments(spark, str(tmp_path)).collect()] == want
    floors = con.execute("SELECT user_id, quantile_cont(value, 0.2) FROM events GROUP BY user_id ORDER BY user_id").fetchall()
    frames = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert [(r.user_id, r.floor) for r in signal.noise_floor(frames, "user_id", "value").orderBy("user_id").collect()] == floors


def test_f1_floors_of_nulls_nans_and_infinities(spark):
    rows = [("none", None), ("none", None), ("one", 3.0), ("one", None), ("nan", float("nan")), ("nan", 1.0), ("low", float("-inf")), ("low", 1.0), (None, 2.0), (None, 4.0)]
    found = signal.noise_floor(spark.createDataFrame(rows, "c string, p double"), "c", "p").collect()
    assert {r.c: (str(r.floor and round(r.floor, 9)), r.n_frames) for r in found} == {"none": ("None", 2), "one": ("3.0", 2), "nan": ("nan", 2), "low": ("-inf", 2), None: ("2.4", 2)}


def test_f2_worksheets_beyond_four_digits(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT k::BIGINT AS s_suppkey, 'S' || k AS s_name FROM (VALUES (7), (1000), (9999), (10000), (12345), (123456)) t(k)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    want = con.execute(panel.ORACLES["q_worksheet_blocks"]).fetchall()
    assert sorted(map(tuple, panel.q_worksheet_blocks(spark, str(tmp_path)).collect())) == sorted(want)
    own = display.worksheet_block(F.col("id"), F.lit("t"), F.lit("c"), F.lit(1), F.lit("x"), F.lit("none"))
    assert spark.range(12345, 12346).select(own.alias("b")).first().b.startswith("--- 12345 ")


def test_f3_turns_are_not_shuffled_for_their_numbers(spark):
    turn = F.struct(F.col("id").alias("at"), F.lit("").alias("raw"), F.concat(F.lit("said "), "id").alias("text"), F.concat(F.lit("ship "), F.col("id") % 3).alias("live_vessel"))
    exchanges = spark.range(400).groupBy(F.floor(F.col("id") / 4).alias("exchange")).agg(F.lit("a").alias("channel"), F.array_sort(F.collect_list(turn)).alias("turns"))
    labels = spark.range(0, 400, 50).select(F.col("id").alias("label"), F.lit("a").alias("channel"), (F.col("id") + 1).alias("start"), (F.col("id") + 30).alias("end"))
    ships = spark.range(1_000_000).select(F.concat(F.lit("SHIP "), "id").alias("name"), F.col("id").cast("string").alias("mmsi"))
    whole = conversations.rebuilt_windows(exchanges, labels, ships, 30)
    found = whole.collect()
    assert "hashpartitioning(upper(trim(live_vessel" not in whole._jdf.queryExecution().executedPlan().toString()
    assert len(found) == 4 * (32 + 36) and all(r.live_mmsi == str(r.at % 3) and r.text == f"said {r.at}" for r in found)
    some = ["place", "label", "live_mmsi"]
    assert sorted(map(tuple, conversations.rebuilt_windows(exchanges, labels, ships, 30, some).collect())) == sorted(map(tuple, whole.select(*some).collect()))
