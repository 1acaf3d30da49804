"""Fuzzy joins of probes with names (J12-J16) without comparing everything with everything.

``similar_pairs`` blocks exactly: a ratio of c or more leaves at most t = (1 - c)(la + lb) characters that are not common. A name cut into t + 1
pieces then keeps one piece whole in the probe, at a place shifted by t at most. Pieces are the equi keys of the join.
``shortlist`` is for low floors, where no blocking is exact: the probes, a stated query set, meet the names in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import Names, indel_ratio


def similar_pairs(probes: DataFrame, names: DataFrame, probe: str, name: str, cutoff: float) -> DataFrame:
    """probe, name, score of all different pairs whose Indel ratio is the cutoff or more."""
    miss = 1 - cutoff / 100
    shortest = lambda n: F.ceil(n * (cutoff / (200 - cutoff)) - 1e-9).cast("int")
    longest = lambda n: F.floor(n * ((200 - cutoff) / cutoff) + 1e-9).cast("int")
    slack = lambda a, b: F.floor((a + b) * miss + 1e-9).cast("int")
    lengths = lambda n: F.sequence(F.greatest(F.lit(1), shortest(n)), F.greatest(F.lit(1), longest(n)))
    own = names.select(F.col(name).alias("name")).filter("length(name) > 0").distinct().withColumn("lb", F.length("name"))
    own = own.withColumn("la", F.explode(lengths(F.col("lb")))).withColumn("t", slack(F.col("la"), F.col("lb")))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.least("t", F.col("lb") - 1))))
    pieces = F.least(F.col("t"), F.col("lb") - 1) + 1
    start = lambda k: F.floor(F.col("lb") * k / pieces).cast("int")
    own = own.withColumn("at", start(F.col("piece")) + 1).withColumn("size", start(F.col("piece") + 1) - start(F.col("piece")))
    own = own.select("name", "la", "lb", "piece", F.expr("substring(name, at, size)").alias("key"))
    asked = probes.select(F.col(probe).alias("probe")).filter("length(probe) > 0").distinct().withColumn("la", F.length("probe"))
    asked = asked.withColumn("lb", F.explode(lengths(F.col("la")))).withColumn("t", slack(F.col("la"), F.col("lb")))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.least("t", F.col("lb") - 1))))
    asked = asked.withColumn("at", start(F.col("piece")) + 1).withColumn("size", start(F.col("piece") + 1) - start(F.col("piece")))
    asked = asked.withColumn("from", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("t")), F.greatest(F.lit(1), F.col("at") + F.col("t")))))
    asked = asked.select("probe", "la", "lb", "piece", F.expr("substring(probe, from, size)").alias("key")).filter("key <> ''").distinct()
    met = asked.join(own, ["la", "lb", "piece", "key"]).select("probe", "name").distinct()
    return met.withColumn("score", indel_ratio(F.col("probe"), F.col("name"))).filter(F.col("score") >= cutoff)


def top_names(scored: DataFrame, k: int) -> DataFrame:
    """The k best names per probe, ties by name."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.col("score").desc(), "name"))).filter(F.col("rank") <= k)


def first_hits(hits: DataFrame, key: str, probe_order: str, most: int = 5) -> DataFrame:
    """Of hits (key, probe_order, mmsi, ...) the first distinct ships in probe order, ``most`` of them per key."""
    once = hits.groupBy(key, "mmsi").agg(F.min_by(F.struct(*[c for c in hits.columns if c not in (key, "mmsi")]), probe_order).alias("__hit"))
    flat = once.select(key, "mmsi", "__hit.*")
    return flat.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(probe_order, "mmsi"))).filter(F.col("slot") <= most)


def ambiguous(scored: DataFrame, gap: float = 3.0) -> DataFrame:
    """The names within the gap of their probe's best score."""
    best = F.max("score").over(Window.partitionBy("probe"))
    return scored.withColumn("best", best).filter(F.col("score") >= F.col("best") - gap)


def shortlist(probes: DataFrame, ships: DataFrame, key: str, n: int = 3, floor: float = 55.0, block: int = 512) -> DataFrame:
    """Per key the n ships whose names come closest to any of its probes, however poorly: key, mmsi, name, score, heard, rank.

    probes: key, pos, probe. ships: mmsi, name. Ships lie in blocks of about 512; each batch of probes is scored against one block at a time, and
    only scores of the floor or more come out. Ties: greater score, then mmsi.
    """
    distinct = probes.select("probe").distinct()
    n_blocks = max(1, -(-ships.count() // block))
    n_chunks = max(1, -(-distinct.count() // (2 * block)))
    blocks = ships.groupBy(F.pmod(F.xxhash64("mmsi", "name"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("mmsi", "name")).alias("ships"))
    chunks = distinct.groupBy(F.pmod(F.xxhash64("probe"), F.lit(n_chunks)).alias("chunk")).agg(F.collect_list("probe").alias("probes"))
    asked = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked_here, ships_here in zip(batch["probes"], batch["ships"], strict=True):
                texts, names = list(asked_here), [s["name"] for s in ships_here]
                # The shorter list is walked, the longer one laid out: common lengths don't care which is which.
                rows, columns = (names, texts) if len(names) <= len(texts) else (texts, names)
                laid = Names(columns)
                scores = np.array([200.0 * laid.common_lengths(x) / np.maximum(1, len(x) + laid.lengths) for x in rows])
                i, j = np.nonzero(scores >= floor)
                ship, probe = (i, j) if rows is names else (j, i)
                yield pd.DataFrame({
                    "probe": [texts[k] for k in probe], "mmsi": [ships_here[k]["mmsi"] for k in ship], "name": [names[k] for k in ship], "score": scores[i, j],
                })

    # A row per chunk of probes and block of ships; what comes out are the scores that reach the floor.
    # Merged, not broadcast: lists of names or probes and the hits never pass through the driver.
    pairs = asked.join(blocks.hint("merge"), "block").repartition("chunk", "block").select("probes", "ships")
    hits = pairs.mapInPandas(scored, "probe string, mmsi string, name string, score double")
    per_ship = probes.join(hits.hint("merge"), "probe").groupBy(key, "mmsi").agg(
        F.max_by(F.struct("name", F.col("probe").alias("heard"), "score"), F.struct("score", (-F.col("pos")).alias("early"), "name")).alias("best")
    )
    flat = per_ship.select(key, "mmsi", "best.name", "best.heard", F.round("best.score", 1).alias("score"), F.col("best.score").alias("__exact"))
    order = Window.partitionBy(key).orderBy(F.col("__exact").desc(), "mmsi")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("__exact")


def document_frequency(probes: DataFrame, doc: str, probe: str, most: float = 0.05) -> DataFrame:
    """The probes that no more than a share of the documents contain, with their number. probes: doc, probe (repeats allowed)."""
    n_docs = F.broadcast(probes.agg(F.count_distinct(doc).alias("n_docs")))  # one row
    counted = probes.select(doc, probe).distinct().groupBy(probe).agg(F.count("*").alias("n"))
    return counted.crossJoin(n_docs).filter(F.col("n") <= most * F.col("n_docs")).select(probe, "n")
