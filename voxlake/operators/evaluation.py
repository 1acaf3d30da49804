"""Evaluation and statistics: word error rates (M1-M5), scoring (M8, M11, A11), repeats (M9), paired bootstrap (M6), arms (J28), reports (A*)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import alignment, word_edits
from ..functions.text import prompt_echo, wer_tokens


#: Clips that the bootstrap hands to every task.
MOST_SHARED = 1_000_000


def error_counts(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """rows with edits and ref_words (both null where the reference has no words)."""
    tokened = rows.withColumn("__ref", wer_tokens(F.col(reference))).withColumn("__hyp", wer_tokens(F.col(hypothesis)))
    has_words = F.size("__ref") > 0
    return tokened.withColumn("edits", word_edits(F.col("__ref"), F.col("__hyp"))).withColumn("ref_words", F.when(has_words, F.size("__ref"))).drop("__ref", "__hyp")


def pooled_wer(edits: Column, words: Column) -> Column:
    """M4: errors over words, not the mean of ratios; null without words."""
    return F.sum(edits) / F.nullif(F.sum(words), F.lit(0))


def pooled_wer_of_arm(edits: Column, words: Column) -> Column:
    """M5: the same per arm, 0.0 without words."""
    return F.coalesce(pooled_wer(edits, words), F.lit(0.0))


def clip_counts(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Clips with edits and ref_words; those whose reference has no words are left out."""
    return error_counts(rows, reference, hypothesis).filter("ref_words IS NOT NULL")


def echo_suppressed(rows: DataFrame, text: str, prompt: str) -> DataFrame:
    """M7: each arm's texts that only echo its own prompt become empty, marked suppressed."""
    echo = prompt_echo(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(prompt), F.lit("")))
    marked = rows.withColumn("suppressed", echo)
    return marked.withColumn(text, F.when(F.col("suppressed"), "").otherwise(F.col(text)))


def most_divergent(rows: DataFrame, divergence: str, error: str, tie: str, most: int = 20) -> DataFrame:
    """The references furthest from an unprompted decode. A report: the limit is the feature."""
    return rows.filter(F.col(divergence).isNotNull() & (F.coalesce(F.col(error), F.lit("")) == "")).orderBy(F.col(divergence).desc(), tie).limit(most)


def clip_range(rows: DataFrame, clip: str, low: str, high: str) -> DataFrame:
    """Clips from low to high, as text, both included."""
    return rows.filter(F.col(clip).between(low, high))


def flight_scores(rows: DataFrame, bucket: str, in_range: str, *keys: str) -> DataFrame:
    """Of M11's buckets precision over the tags given, recall over the achievable rows (named aircraft in range), and how many were excluded."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    is_in = lambda *names: F.col(bucket).isin(*names)
    counted = rows.groupBy(*keys).agg(
        n(is_in("correct")).alias("correct"), n(is_in("correct", "wrong_match")).alias("tags"), n(F.col(in_range) & ~is_in("excluded")).alias("achievable"),
        n(is_in("retrieval_miss")).alias("ceiling_missed"), n(is_in("excluded")).alias("excluded"),
    )
    ratio = lambda of: F.round(F.col("correct") / F.nullif(F.col(of), F.lit(0)), 9)
    return counted.withColumns({"precision": ratio("tags"), "recall": ratio("achievable")})


def substitutions(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Hyp, ref, n of the aligned substitutions."""
    steps = rows.select(F.explode(alignment(wer_tokens(F.col(reference)), wer_tokens(F.col(hypothesis)))).alias("step"))
    return steps.filter("step.op = 'sub'").groupBy(F.col("step.hyp").alias("hyp"), F.col("step.ref").alias("ref")).agg(F.count("*").alias("n"))


def floor_percentile(values: Column, share: float) -> Column:
    """The sorted value at index floor(share * (n - 1)); no interpolation. For values that fit one group in memory (a report's)."""
    listed = F.array_sort(F.collect_list(values))
    return F.get(listed, F.floor(F.lit(share) * (F.count(values) - 1)).cast("int"))


def floor_percentile_rows(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The same for groups of any size. An approximate percentile (its rank is off by a 10,000th of the rows at most) bounds the value from both sides;
    the rows below are counted, and only the different values in between are ranked. Groups of up to 10,000 rows need no bounds."""
    most, margin = 10_000, 0.002
    known = rows.filter(F.col(value).isNotNull()).select(key, value)
    bounds = known.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(value, [max(0.0, share - margin), min(1.0, share + margin)], most).alias("__bounds"), F.count("*").alias("__n"))
    bounds = bounds.withColumn("__bounds", F.when(F.col("__n") > most, F.col("__bounds")))
    placed = known.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("__key"))).filter(F.lit(share + margin >= 1) | F.coalesce(F.col(value) <= F.col("__bounds")[1], F.lit(True)))
    below = F.coalesce(F.col(value) < F.col("__bounds")[0], F.lit(False)) & F.lit(share - margin > 0)
    counted = placed.groupBy(key, F.when(~below, F.col(value)).alias("value")).agg(F.count("*").alias("__count"), F.first("__n").alias("__n"))  # null: all that lie below
    order = Window.partitionBy(key).orderBy(F.col("value").asc_nulls_first())
    ranked = counted.withColumn("__end", F.sum("__count").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.floor(F.lit(share) * (F.col("__n") - 1))
    return ranked.filter((at < F.col("__end")) & (at >= F.col("__end") - F.col("__count"))).select(key, "value")


def label_outcome(truth: Column, predicted: Column) -> Column:
    """Per transmission; a null truth says nobody could be identified, so any prediction is wrong there."""
    return (
        F.when(truth.isNull() & predicted.isNull(), "correct_null").when(truth.isNull(), "wrong").when(predicted.isNull(), "missed")
        .when(truth == predicted, "correct").otherwise("wrong")
    )


def precision_recall(outcomes: DataFrame, outcome: str, *keys: str) -> DataFrame:
    """M8: counts, precision over named and recall over identifiable; null where nothing counts."""
    n = lambda name: F.sum((F.col(outcome) == name).cast("long"))
    counted = outcomes.groupBy(*keys).agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("missed").alias("missed"), n("correct_null").alias("correct_null"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 9)
    c = F.col("correct")
    wrong_of_known = F.col("wrong")
    return counted.withColumn("precision", ratio(c, c + F.col("wrong"))).withColumn("recall", ratio(c, c + wrong_of_known + F.col("missed")))


def outcome_split(label: Column, tagged: Column, candidate: Column, in_range: Column) -> Column:
    """Seven buckets; in_range null means that no snapshot covers the moment, and matters only where it changes the answer."""
    return (
        F.when(label == "UNSURE", "excluded").when((label == "NONE") & tagged.isNotNull(), "wrong_match").when(label == "NONE", "correct_rejection")
        .when(tagged == label, "correct").when(tagged.isNotNull(), "wrong_match").when(in_range.isNull(), "excluded")
        .when(~in_range, "retrieval_miss").when(candidate.isNull(), "extraction_miss").otherwise("selection_miss")
    )


def repeat_spread(scores: DataFrame, metric: str, value: str) -> DataFrame:
    """M9: over runs: mean, min, max and their spread of the defined values (0 where there is none), runs defined."""
    spread = F.coalesce(F.max(value) - F.min(value), F.lit(0.0))
    return scores.groupBy(metric).agg(
        F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(spread, 6).alias("spread"), F.count(value).alias("runs_defined")
    )


def stability(turns: DataFrame, at: str, run: str, outcome: str, predicted: str, n_runs: int) -> DataFrame:
    """Per transmission whether all runs have it, with one outcome and one prediction."""
    same = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    return turns.groupBy(at).agg(F.count_distinct(run).alias("runs_present"), same(outcome).alias("n_outcomes"), same(predicted).alias("n_predictions")).withColumn(
        "stable", (F.col("runs_present") == n_runs) & (F.col("n_outcomes") == 1) & (F.col("n_predictions") == 1)
    )


def in_every_arm(rows: DataFrame, arm: str, clip: str, n_arms: int) -> DataFrame:
    """The clips that every arm has."""
    return rows.groupBy(clip).agg(F.count_distinct(arm).alias("__arms")).filter(F.col("__arms") == n_arms).select(clip)


def paired_scores(rows: DataFrame, arm: str, clip: str, error: str, reference: str, n_arms: int) -> DataFrame:
    """Clips of every arm, split into no_reference, errored (in any arm) and scored."""
    joined = rows.join(in_every_arm(rows, arm, clip, n_arms), clip)
    status = F.when(F.max(F.col(reference).isNull()), "no_reference").when(F.max(F.col(error).isNotNull()), "errored").otherwise("scored")
    return joined.groupBy(clip).agg(status.alias("status"))


def _draw(i: Column, seed: int) -> Column:
    """A number below 2**31 from an index: three rounds of multiply and fold, in plain integer arithmetic that any engine repeats."""
    x = (i * 40503 + seed) % 2147483648
    for factor in (48271, 69621, 16807):
        x = (x.bitwiseXOR(F.floor(x / 65536).cast("long")) * factor + 12345) % 2147483648
    return x


def _draws(i: np.ndarray, seed: int) -> np.ndarray:
    """_draw of many indexes."""
    x = (i * 40503 + seed) % 2147483648
    for factor in (48271, 69621, 16807):
        x = ((x ^ (x // 65536)) * factor + 12345) % 2147483648
    return x


def bootstrap_ci(clips: DataFrame, order: str, a: tuple[str, str], b: tuple[str, str], iterations: int, seed: int) -> DataFrame:
    """M6: 95 % interval of pooled WER b minus a, clips resampled in pairs; one row: low, high, n. a, b: (errors, words) columns.

    The draws are hash-seeded: draw k of iteration i picks clip _draw(i * n + k) mod n. Clips are numbered by order within 1024 ranges of the hash of
    their id, so no single task numbers them all. Up to MOST_SHARED clips (four numbers each, 32 MB) go to every task, which draws and sums whole
    iterations; beyond that draws meet clips in an equi join and only sums per iteration are shuffled.
    """
    parts = clips.withColumn("__part", F.pmod(F.crc32(F.col(order).cast("string").cast("binary")), F.lit(1024)))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(starts), "__part").withColumn(
        "__clip", F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    )
    n = clips.count()
    if n <= MOST_SHARED:
        values = numbered.select(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate((*a, *b))], "__clip").toPandas().sort_values("__clip")
        shared = clips.sparkSession.sparkContext.broadcast(values[["v0", "v1", "v2", "v3"]].to_numpy())

        def resampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                total = [own[_draws(i * n + np.arange(n), seed) % n].sum(axis=0) if n else np.zeros(4) for i in batch["id"]]
                yield pd.DataFrame(np.reshape(total, (-1, 4)), columns=["__ea", "__wa", "__eb", "__wb"])

        sums = clips.sparkSession.range(iterations).mapInPandas(resampled, "__ea double, __wa double, __eb double, __wb double")
    else:
        draws = clips.sparkSession.range(iterations * n).select(F.floor(F.col("id") / n).alias("iteration"), (_draw(F.col("id"), seed) % n).alias("__clip"))
        sums = draws.join(numbered, "__clip").groupBy("iteration").agg(*[F.sum(c).alias(f"__{k}") for k, c in zip(("ea", "wa", "eb", "wb"), (*a, *b), strict=True)])
    deltas = sums.filter("__wa > 0 AND __wb > 0").select((F.col("__eb") / F.col("__wb") - F.col("__ea") / F.col("__wa")).alias("delta"))
    listed = deltas.agg(F.array_sort(F.collect_list("delta")).alias("d"))  # one number per iteration
    at = lambda k: F.round(F.coalesce(F.get("d", k.cast("int")), F.lit(0.0)), 9)
    return listed.select(at(F.floor(0.025 * F.size("d"))).alias("low"), at(F.floor(0.975 * (F.size("d") - 1))).alias("high"), F.size("d").alias("n"))


def reference_check(references: DataFrame, captures: DataFrame, key: str, text: str) -> DataFrame:
    """One row per finding: missing (captured, no reference), extra (reference, no capture), empty."""
    refs = references.select(key, F.col(text).alias("__text"))
    missing = captures.select(key).join(refs, key, "left_anti").select(key, F.lit("missing").alias("finding"))
    extra = refs.join(captures.select(key), key, "left_anti").select(key, F.lit("extra").alias("finding"))
    empty = refs.filter(F.coalesce(F.trim("__text"), F.lit("")) == "").select(key, F.lit("empty").alias("finding"))
    return reduce(DataFrame.unionByName, (missing, extra, empty))


def movers(rows: DataFrame, delta: Column, tie: str, most: int = 12) -> DataFrame:
    """The rows that changed most, largest first; none that didn't change. A report: the limit is the feature."""
    changed = rows.withColumn("delta", delta).filter(F.col("delta") != 0)
    return changed.orderBy(F.abs("delta").desc(), tie).limit(most)


def echo_gate(rows: DataFrame, least_overlap: int = 50, least_agreement: float = 0.95, least_recovery: float = 0.10) -> DataFrame:
    """Rows (call, echo: hex or null) with evidence. One row: overlap, agree, agreement, recovered, recovery, passes."""
    both = F.col("call").isNotNull() & F.col("echo").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    counted = rows.agg(
        n(both).alias("overlap"), n(both & (F.col("call") == F.col("echo"))).alias("agree"), n(F.col("call").isNull()).alias("no_call"),
        n(F.col("call").isNull() & F.col("echo").isNotNull()).alias("recovered"),
    )
    agreement = F.round(F.col("agree") / F.nullif("overlap", F.lit(0)), 9)
    recovery = F.round(F.col("recovered") / F.nullif("no_call", F.lit(0)), 9)
    passes = (F.col("overlap") >= least_overlap) & (F.coalesce(agreement, F.lit(0.0)) >= least_agreement) & (F.coalesce(recovery, F.lit(0.0)) >= least_recovery)
    return counted.select("overlap", "agree", agreement.alias("agreement"), "recovered", recovery.alias("recovery"), passes.alias("passes"))


def run_health(rows: DataFrame, error: str, text: str, *keys: str) -> DataFrame:
    """no_rows can't group; per key: all_failed, some_failed, all_empty or healthy."""
    failed = F.sum(F.col(error).isNotNull().cast("long"))
    empty = F.sum((F.col(error).isNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) == "")).cast("long"))
    n = F.count("*")
    state = F.when(failed == n, "all_failed").when(failed > 0, "some_failed").when(empty == n, "all_empty").otherwise("healthy")
    return rows.groupBy(*keys).agg(n.alias("n"), failed.alias("n_failed"), state.alias("state"))


def error_class(error: Column) -> Column:
    """The first rule that fits."""
    low = F.lower(error)
    return (
        F.when(error.isNull(), None).when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("reset") | low.contains("refused"), "connection")
        .when(low.contains("429") | low.contains("rate"), "rate_limit").when(low.rlike("5[0-9][0-9]"), "server").otherwise("other")
    )
