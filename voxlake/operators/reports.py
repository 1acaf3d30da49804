"""Reports: word production (A9), draught plausibility (A12, M16), error kinds (A15), trials (A18, A19, X26), traffic (A20, S37), languages (A21), corrections (A22, A23, M15),
antenna (A24), feed contract (A26, F21), shortlist hits (M10), sweeps (M12), integrity (M13), labels (M14), per-clip matrix (K18), draft labels (K14), stored exchanges (K3)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import word_edits
from ..functions.text import wer_tokens

#: A ship's length is at least so many times its draught (M16); failures of one fault lie within so many seconds.
LEAST_RATIO, FIXED_SPREAD = 8.0, 1.0


def word_production(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Per word the rows that hold it, once each, whatever its case. One scan, one row per word."""
    held = [F.coalesce(F.col(text).rlike(rf"(?iU)\b{re.escape(w)}\b"), F.lit(False)) for w in words]
    counted = rows.agg(*[F.coalesce(F.sum(h.cast("long")), F.lit(0)).alias(f"w{i}") for i, h in enumerate(held)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n_rows")) for i, w in enumerate(words)])
    return counted.select(F.inline(pairs))


def draught_partition(rows: DataFrame, draughts: str, vessel: str, length: str) -> DataFrame:
    """Rows with bucket (no_draught, unnamed, no_length, flagged, plausible), said (the largest draught) and ratio."""
    said = F.array_max(draughts)
    ratio = F.col(length) / said
    unnamed, no_length = F.coalesce(F.col(vessel), F.lit("")) == "", F.coalesce(F.col(length), F.lit(0)) == 0
    bucket = F.when(said.isNull(), "no_draught").when(unnamed, "unnamed").when(no_length, "no_length").when(ratio < LEAST_RATIO, "flagged").otherwise("plausible")
    scored = bucket.isin("flagged", "plausible")
    return rows.withColumns({"bucket": bucket, "said": said, "ratio": F.when(scored, ratio)})


def per_hundred(rows: DataFrame, kind: str) -> DataFrame:
    """Rows per kind, and per 100 of all."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.count("*").alias("__total")))  # one row
    return counts.crossJoin(total).select(kind, "n", (100.0 * F.col("n") / F.col("__total")).alias("per_100"))


def trial_summary(trials: DataFrame, label: str, outcome: str, elapsed: str) -> DataFrame:
    """Per label runs, failures, their rate, the spread of times of either kind and a verdict. Medians are exact and interpolate."""
    failed = F.col(outcome) != "ok"
    spread = lambda cond, p: [f(F.when(cond, F.col(elapsed))).alias(f"{p}_{n}") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    rows = trials.groupBy(label).agg(
        F.count("*").alias("runs"), F.sum(failed.cast("long")).alias("failures"), *spread(~failed, "ok"), *spread(failed, "fail")
    )
    verdict = (
        F.when(F.col("failures") == 0, "clean").when(F.col("failures") == 1, "fault present, too few to read")
        .when(F.col("fail_max") - F.col("fail_min") <= FIXED_SPREAD, "fault reproduced").otherwise("failures, but scattered")
    )
    return rows.withColumns({"failure_rate": F.col("failures") / F.col("runs"), "verdict": verdict})


def before_after(before: Column, after: Column) -> Column:
    """What a change did, from the failure rates before and after."""
    return F.when(before == 0, "inconclusive").when(after == 0, "change helped").when(after < before / 2, "partial").otherwise("no effect")


def traffic_report(days: DataFrame, series: str) -> DataFrame:
    """Totals and active days per series. Daily uniques add up to daily uniques, not to distinct visitors."""
    return days.groupBy(series).agg(
        F.sum("count").alias("total"), F.sum("uniques").alias("summed_daily_uniques"), F.sum((F.col("count") > 0).cast("long")).alias("active_days"), F.max("day").alias("last_day")
    )


def language_census(rows: DataFrame, language: str, forced: bool = False) -> DataFrame:
    """Rows and share per language; no rows where the language was forced, as it then only echoes the request."""
    named = rows.select(F.coalesce(F.nullif(F.trim(F.col(language)), F.lit("")), F.lit("(error)")).alias("language"))
    counted = per_hundred(named, "language").withColumn("share", F.col("per_100") / 100).drop("per_100")
    return counted.filter(F.lit(not forced))


def correction_score(rows: DataFrame, reference: str, before: str, after: str, failed: str, elapsed: str) -> DataFrame:
    """One row: pooled error rates before and after, clips that improved, regressed, grew or shrank, failures and the upper median of the
    time. A failed correction counts with the text it had; blank references are left out."""
    ref = wer_tokens(F.col(reference))
    rows = rows.filter(F.size(ref) > 0)
    kept = F.when(F.col(failed), F.col(before)).otherwise(F.col(after))
    e0, e1 = word_edits(ref, wer_tokens(F.col(before))), word_edits(ref, wer_tokens(kept))
    scored = rows.select(
        F.size(ref).alias("n"), e0.alias("e0"), e1.alias("e1"), (F.size(wer_tokens(kept)) - F.size(wer_tokens(F.col(before)))).alias("growth"), F.col(failed).alias("failed"),
        F.col(elapsed).alias("elapsed"),
    )
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return scored.agg(
        F.count("*").alias("clips"), (F.sum("e0") / F.sum("n")).alias("wer_before"), (F.sum("e1") / F.sum("n")).alias("wer_after"), count(F.col("e1") < F.col("e0")).alias("improved"),
        count(F.col("e1") > F.col("e0")).alias("regressed"), count(F.col("growth") > 0).alias("grew"), count(F.col("growth") < 0).alias("shrank"), count(F.col("failed")).alias("failed"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed DESC) FILTER (WHERE NOT failed)").alias("median_elapsed"),
    )


def invented_words(hypothesis: Column, reference: Column) -> Column:
    """Words of the hypothesis, each time they occur, that the reference doesn't have."""
    return F.filter(hypothesis, lambda w: ~F.array_contains(reference, w))


def antenna_report(levels: DataFrame, capture: str, level_db: str) -> DataFrame:
    """Noise floor (the 20th percentile), peak and largest distance between them, per capture."""
    return levels.groupBy(capture).agg(F.percentile(level_db, 0.2).alias("floor_db"), F.max(level_db).alias("peak_db")).withColumn("max_snr_db", F.col("peak_db") - F.col("floor_db"))


def contract_census(rows: DataFrame, fields: list[str], ordinal: str) -> DataFrame:
    """Per field the rows whose value is neither null nor a number, and the first of them."""
    bad = lambda f: F.col(f).isNotNull() & F.col(f).cast("string").try_cast("double").isNull()
    counted = rows.agg(*[F.struct(F.sum(bad(f).cast("long")).alias("n_bad"), F.min_by(F.col(f).cast("string"), F.when(bad(f), F.col(ordinal))).alias("first_bad")).alias(f) for f in fields])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f)["n_bad"], F.lit(0)).alias("n_bad"), F.col(f)["first_bad"].alias("first_bad")) for f in fields])))


def shortlist_hits(shortlists: DataFrame, truth: str, listed: str) -> DataFrame:
    """Of the rows with a true name, those whose shortlist (an array, best first) holds it. One row."""
    rank = F.nullif(F.array_position(listed, F.col(truth)), F.lit(0))
    rows = shortlists.filter(F.coalesce(F.col(truth), F.lit("")) != "").withColumn("rank", rank)
    return rows.agg(F.count("*").alias("scored"), F.count("rank").alias("hits"), (F.count("rank") / F.nullif(F.count("*"), F.lit(0))).alias("hit_rate"), F.avg("rank").alias("mean_rank"))


def sweep(rows: DataFrame, parameters: DataFrame, keep: Column, hit: Column, *keys: str) -> DataFrame:
    """Per combination of parameters (a small table, a few dozen rows) the rows kept and the hits among them."""
    tried = rows.crossJoin(F.broadcast(parameters)).filter(keep)
    return tried.groupBy(*keys).agg(F.count("*").alias("kept"), F.sum(hit.cast("long")).alias("hits"))


def integrity_warnings(sheet: DataFrame, stored: str, recomputed: Column) -> DataFrame:
    """Rows of which the stored line isn't what is computed now."""
    return sheet.withColumn("recomputed", recomputed).filter(~F.col(stored).eqNullSafe(F.col("recomputed")))


def resolved_labels(labels: DataFrame, ships: DataFrame, name: str) -> DataFrame:
    """Labels with status by exact name: scorable (one ship, with mmsi), ambiguous, or unknown."""
    owners = ships.groupBy(F.upper(F.trim("name")).alias("__name")).agg(F.count_distinct("mmsi").alias("__n"), F.min("mmsi").alias("mmsi"))
    joined = labels.join(owners, F.upper(F.trim(F.col(name))) == F.col("__name"), "left")
    status = F.when(F.col("__n") == 1, "scorable").when(F.col("__n") > 1, "ambiguous").otherwise("unknown")
    return joined.withColumn("status", status).withColumn("mmsi", F.when(F.col("__n") == 1, F.col("mmsi"))).drop("__n", "__name")


def clip_matrix(rows: DataFrame, clip: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """A row per clip, a column per arm."""
    return rows.groupBy(clip).pivot(arm, arms).agg(F.first(value))


def draft_labels(exchanges: DataFrame, clips: DataFrame, day: str | None = None) -> DataFrame:
    """Lines start, end, mmsi or '-', note of exchanges (start, end, channel, mmsi, vessel), the note naming the clips inside; times are seconds."""
    rows = exchanges if day is None else exchanges.filter(F.to_date(F.timestamp_seconds("start")) == F.lit(day).cast("date"))
    width = 300
    laid = rows.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    inside = laid.join(clips.select("channel", "clip", "at", F.floor(F.col("at") / width).alias("__bucket")), ["channel", "__bucket"]).filter(F.col("at").between(F.col("start"), F.col("end")))
    noted = inside.groupBy("channel", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("clip")), " ").alias("note"))
    return rows.join(noted, ["channel", "start", "end"], "left").select("start", "end", F.coalesce("mmsi", F.lit("-")).alias("mmsi"), "vessel", "note", "channel")


def stored_exchanges(exchanges: DataFrame, chunks: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """K3: exchanges (key, chunk_ids) with turns in the order of their ids: what was said stays as it is, a correction stands beside it."""
    turns = exchanges.select(key, F.explode("chunk_ids").alias("id")).join(chunks, "id").join(corrections.select(key, "id", F.col("text").alias("conv")), [key, "id"], "left")
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "time", "text", "conv"))).alias("turns"), F.min("time").alias("start"), F.max("time").alias("end"))
    return exchanges.drop("chunk_ids").join(listed, key)
