"""Candidates and contracts: union by precedence (J19), flight matches (J23-J26), clues (X1), exchange validation (F27), reply contract (F26), station decode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.airband import callsign, code_of, misheard, tail_of
from ..functions.similarity import indel_ratio

#: Fixed value: the order in which sources of a candidate count.
PRECEDENCE = ("spoken_callsign", "journal_callsign", "live_match", "hint", "partial_callsign")


def union_by_precedence(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The candidates of all sources, one row per key, from the source that comes first; a journal call sign overwrites what a spoken one said."""
    rank = {name: (PRECEDENCE.index(name) if name != "journal_callsign" else -1) for name in sources}
    tagged = [df.withColumn("source", F.lit(name)).withColumn("__rank", F.lit(rank[name])) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__rank", *[c for c in rest if c != "__rank"])).alias("__best"))
    return best.select(*keys, "__best.*").drop("__rank")


def match_flights(asked: DataFrame, aircraft: DataFrame, candidate: str, flight: str, cutoff: float = 85.0) -> DataFrame:
    """Each candidate designator with the aircraft it names: the same designator, else one of the same tail and the most similar code.

    The tail is the equi key; only codes are compared. Result: candidate, flight, score (100 for the same designator).
    """
    wanted = asked.select(F.col(candidate).alias("candidate")).filter("candidate IS NOT NULL").distinct()
    flying = aircraft.select(F.col(flight).alias("flight")).filter("flight IS NOT NULL").distinct()
    exact = wanted.join(flying, wanted["candidate"] == flying["flight"]).withColumn("score", F.lit(100.0))
    left = wanted.join(exact, "candidate", "left_anti").select("candidate", code_of(F.col("candidate")).alias("code"), tail_of(F.col("candidate")).alias("tail"))
    right = flying.select("flight", code_of(F.col("flight")).alias("own_code"), tail_of(F.col("flight")).alias("tail"))
    near = left.join(right, "tail").withColumn("score", indel_ratio(F.col("code"), F.col("own_code"))).filter(F.col("score") >= cutoff)
    best = near.groupBy("candidate").agg(F.max_by(F.struct("flight", "score"), F.struct("score", "flight")).alias("b")).select("candidate", "b.flight", "b.score")
    return exact.select("candidate", "flight", "score").unionByName(best)


def callsign_clues(said: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Said (id, text) with candidate, flight, hex, type, reg and repaired_from. aircraft: flight, hex, type, reg.

    A candidate without an aircraft was heard and isn't there. Where no airline was heard, a 'QNH' that can be no pressure is read as 'KLM' and counts
    if exactly one aircraft bears that designator.
    """
    fields = F.struct("hex", "flight", "type", "reg")
    flying = aircraft.filter("flight IS NOT NULL").groupBy("flight").agg(F.min(fields).alias("craft"), F.count("*").alias("n"))
    heard = said.select("id", callsign(F.col("text")).alias("candidate"), misheard(F.col("text")).alias("misheard"))
    matched = match_flights(heard, aircraft, "candidate", "flight").select("candidate", "flight").join(flying, "flight").select("candidate", F.col("craft").alias("matched"))
    doubtful = heard.filter("candidate IS NULL").select("id", F.posexplode("misheard").alias("place", "flight")).join(flying.filter("n = 1"), "flight")
    repaired = doubtful.groupBy("id").agg(F.min_by(F.struct("flight", "craft"), "place").alias("repaired"))
    both = heard.join(matched, "candidate", "left").join(repaired, "id", "left")
    craft = F.coalesce("matched", "repaired.craft")
    return both.select(
        "id", F.coalesce("candidate", "repaired.flight").alias("candidate"), *[craft[f].alias(f) for f in ("hex", "flight", "type", "reg")],
        F.when(F.col("repaired").isNotNull(), "QNH").alias("repaired_from"),
    )


def match_by_tail(tails: DataFrame, aircraft: DataFrame, tail: str, flight: str, hex_: str, on_ground: str) -> DataFrame:
    """Tails borne by exactly one airborne aircraft."""
    flying = aircraft.filter(~F.coalesce(F.col(on_ground), F.lit(False))).select(tail_of(F.col(flight)).alias("tail"), F.col(hex_).alias("hex"))
    one = flying.groupBy("tail").agg(F.count_distinct("hex").alias("n"), F.min("hex").alias("hex")).filter("n = 1").select("tail", "hex")
    return tails.select(F.col(tail).alias("tail")).distinct().join(one, "tail")


def near_miss_codes(asked: DataFrame, aircraft: DataFrame, candidate: str, flight: str, cutoff: float = 85.0) -> DataFrame:
    """Flights whose code resembles the candidate's, whatever the tail. Codes have 2 to 4 letters: they meet by a shared first or second letter,
    as two codes at 85 or more differ in at most one character of seven."""
    wanted = asked.select(code_of(F.col(candidate)).alias("code")).filter("code IS NOT NULL").distinct()
    codes = aircraft.select(code_of(F.col(flight)).alias("own_code")).filter("own_code IS NOT NULL").distinct()
    letters = lambda c: F.array_distinct(F.array(F.substring(c, 1, 1), F.substring(c, 2, 1)))
    left = wanted.withColumn("letter", F.explode(letters(F.col("code"))))
    right = codes.withColumn("letter", F.explode(letters(F.col("own_code"))))
    return left.join(right, "letter").select("code", "own_code").distinct().filter(indel_ratio(F.col("code"), F.col("own_code")) >= cutoff)


def validated_exchanges(exchanges: DataFrame, chunks: DataFrame, candidates: DataFrame, window: str) -> DataFrame:
    """Exchanges (window, exchange, chunk_ids, vessel) kept to the window's chunks (window, id) and candidates (window, name).

    A chunk belongs to the first exchange that claims it, exchanges left without chunks go, names off the list become null, and chunks that
    nobody claimed form one more exchange, numbered -1, with nobody.
    """
    claims = exchanges.select(window, "exchange", F.explode("chunk_ids").alias("id")).join(chunks.select(window, "id").distinct(), [window, "id"])
    owner = claims.groupBy(window, "id").agg(F.min("exchange").alias("exchange"))
    owned = owner.groupBy(window, "exchange").agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    listed = candidates.select(window, F.upper(F.trim("name")).alias("__name"), F.col("name").alias("vessel")).groupBy(window, "__name").agg(F.min("vessel").alias("vessel"))
    named = exchanges.select(window, "exchange", F.upper(F.trim("vessel")).alias("__name")).join(listed, [window, "__name"], "left").drop("__name")
    kept = owned.join(named, [window, "exchange"])
    left = chunks.select(window, "id").distinct().join(owner, [window, "id"], "left_anti").groupBy(window).agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    rest = left.select(window, F.lit(-1).cast(kept.schema["exchange"].dataType).alias("exchange"), "chunk_ids", F.lit(None).cast("string").alias("vessel"))
    return kept.select(window, "exchange", "chunk_ids", "vessel").unionByName(rest)


def reply_verdict(reply: DataFrame, turns: DataFrame, exchange: str) -> DataFrame:
    """per exchange accepted, or the first reason to reject the whole reply. reply: exchange, id, text, n_changes; turns: exchange, id, text."""
    given = reply.select(exchange, "id", F.col("text").alias("new"), "n_changes", F.lit(True).alias("given"))
    own = turns.select(exchange, "id", F.col("text").alias("old"), F.lit(True).alias("known"))
    both = own.join(given, [exchange, "id"], "full_outer")
    changed = F.trim("new") != F.trim("old")
    reason = (
        F.when(F.col("known").isNull(), F.lit("1 unknown id")).when(F.col("given").isNull(), "6 missing turn").when(F.trim(F.coalesce("new", F.lit(""))) == "", "3 empty text")
        .when(~changed & (F.col("n_changes") > 0), "4 declared a change it did not make").when(changed & (F.coalesce("n_changes", F.lit(0)) == 0), "5 undeclared rewrite")
    )
    twice = given.groupBy(exchange, "id").count().filter("count > 1").select(exchange).distinct().withColumn("__twice", F.lit("2 id appears twice"))
    worst = both.groupBy(exchange).agg(F.min(reason).alias("__reason")).join(twice, exchange, "left")
    found = F.least("__reason", "__twice")
    return worst.select(exchange, found.isNull().alias("accepted"), F.substring(found, 3, 80).alias("reason"))


def nmea_mmsi(sentence: Column) -> Column:
    """The number in the first fragment of a station's sentence; null for later fragments and what can't be read. Seven characters of six
    bits: the number is bits 8 to 37."""
    parts = F.split(sentence, ",")
    payload = F.get(parts, F.lit(5))
    codes = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.ascii(F.substring(payload, i, F.lit(1))) - 48)
    six = F.transform(codes, lambda c: F.when(c > 40, c - 8).otherwise(c))
    value = F.aggregate(six, F.lit(0).cast("long"), lambda a, c: a * 64 + c)
    number = F.shiftright(value, 4).bitwiseAND(F.lit(0x3FFFFFFF).cast("long"))
    fits = (
        sentence.rlike("^!(AIVDM|AIVDO|BSVDM|ABVDM)") & (F.size(parts) >= 6) & (F.get(parts, F.lit(2)).try_cast("int") == 1) & (F.length(payload) >= 7)
        & ~F.exists(six, lambda c: (c < 0) | (c > 63))
    )
    return F.when(fits & (number > 0), number)
