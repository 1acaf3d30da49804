"""Operator 10, sharding: a Feistel permutation of global row numbers, with cycle walking.

Rows get a global number by the order of a content hash, so the number depends on the rows alone and not on
files, partitions or cluster size. A keyed Feistel network over [0, a) x [0, b), a*b >= N, permutes the
numbers; a value at or beyond N goes through the network again until it falls below N. Position p of the
permutation lies in shard p % n and slot p // n, so shard counts differ by one at most, and shard and slot of
a row number can be computed without any table (``locate``).

Everything on the main path is a DataFrame or SQL expression. The numbers come from two scans: one counts the
rows per hash prefix (so long that a prefix has half a million rows, but five digits at most, so a million counts at most reach the
driver), the other numbers the rows inside each prefix by a window and adds the prefix's start. A row that is repeated very often has
one hash; such hashes are found in overfull prefixes only, and their copies, which are interchangeable, are written with a salt and
numbered in 64 parts. What decides a number is the row's content or what was written, so a lost executor changes nothing.

Defined cases: a null text has size 1 and the CRC of no bytes; a null id is an id of its own; equal rows
get different slots; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import without, written

ROUNDS = 8
SALTS = 64
#: Rows of a hash prefix, on average, that one window numbers.
PREFIX_ROWS = 500_000
SEED = "voxlake"


def round_keys(seed: str) -> list[int]:
    return [zlib.crc32(f"{seed}:{i}".encode()) & 0x7FFFFFFF for i in range(ROUNDS)]


def domain(n: int) -> tuple[int, int]:
    """Sides a, b with a*b >= n and fewer than a values too many."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _mix(value: int, key: int) -> int:
    t = (value * 40503 + key) % 2147483648
    t ^= t // 32768
    t = t * 48271 % 2147483648
    return t ^ (t // 8192)


def once(x: int, n: int, keys: list[int]) -> int:
    """One pass of the network over one number; the expression below is the same for a column."""
    a, b = domain(n)
    left, right = divmod(x, b)
    for i, key in enumerate(keys):
        if i % 2:
            right = (right + _mix(left, key)) % b
        else:
            left = (left + _mix(right, key)) % a
    return left * b + right


def longest_walk(n: int, keys: list[int]) -> int:
    """Passes that the longest walk from a number below n takes. Only the fewer than sqrt(n)+1 values beyond n matter."""
    a, b = domain(n)
    after = {y: once(y, n, keys) for y in range(n, a * b)}
    entered = set(after) - set(after.values())
    longest = 0
    for y in entered:
        steps = 1
        while (y := after[y]) >= n:
            steps += 1
        longest = max(longest, steps)
    return 1 + longest


def locate(number: int, n: int, n_shards: int, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    keys, x = round_keys(seed), number
    while True:
        x = once(x, n, keys)
        if x < n:
            return x % n_shards, x // n_shards


def _mix_sql(value: str, key: int) -> str:
    first = f"transform(array(({value} * 40503L + {key}L) % 2147483648L), t -> t ^ (t div 32768L))[0]"
    return f"transform(array({first} * 48271L % 2147483648L), t -> t ^ (t div 8192L))[0]"


def permuted(number: str, n: int, keys: list[int]) -> Column:
    """The permutation of a column of numbers below n, as an expression."""
    a, b = domain(n)
    state = f"named_struct('l', x div {b}L, 'r', x % {b}L)"
    for i, key in enumerate(keys):
        left = f"(s.l + {_mix_sql('s.r', key)}) % {a}L" if i % 2 == 0 else "s.l"
        right = f"(s.r + {_mix_sql('s.l', key)}) % {b}L" if i % 2 else "s.r"
        state = f"transform(array({state}), s -> named_struct('l', {left}, 'r', {right}))[0]"
    network = f"transform(array({state}), s -> s.l * {b}L + s.r)[0]"
    walk = f"aggregate(sequence(1, {longest_walk(n, keys)}), {number}, (x, step) -> if(step > 1 AND x < {n}L, x, {network}))"
    return F.expr(walk)


def _digits(total: int) -> int:
    """Length of the hash prefix for so many rows."""
    return next((d for d in (3, 4) if total <= PREFIX_ROWS * 16**d), 5)


def _numbered(rows: DataFrame, most_equal: int) -> tuple[DataFrame, int]:
    """rows with __number, 0 to N-1 in the order of __key; and N."""
    spark, total = rows.sparkSession, rows.count()
    if not total:
        return rows.withColumn("__number", F.lit(0).cast("long")), 0
    digits = _digits(total)
    rows = rows.withColumn("__part", F.substring("__key", 1, digits))
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    # A key with more than this many rows is salted: fewer than 10,000 keys can have so many.
    often = max(most_equal, total // 10_000)
    full = [(part,) for part, k in counts.items() if k > often]
    hot: dict[str, int] = {}
    if full:
        copies = rows.join(F.broadcast(spark.createDataFrame(full, "__part string")), "__part").groupBy("__key").count().filter(F.col("count") > often)
        hot = {r["__key"]: r["count"] for r in copies.collect()}
    for key, k in hot.items():
        counts[key[:digits]] -= k
    starts, at = [], 0
    for part in sorted(counts):
        starts.append((part, 0, at))
        at += counts[part]
    rows = rows.withColumn("__salt", F.lit(0))
    if hot:
        often_found = F.broadcast(spark.createDataFrame([(key,) for key in hot], "__key string"))
        salt = (F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).cast("int")
        salted = rows.join(often_found, "__key", "left_semi").withColumns({"__part": F.col("__key"), "__salt": salt})
        salted = written(salted, "repeated-rows")  # once, as the salt hangs on the run
        for part, s, k in sorted((r["__part"], r["__salt"], r["count"]) for r in salted.groupBy("__part", "__salt").count().collect()):
            starts.append((part, s, at))
            at += k
        rows = rows.join(often_found, "__key", "left_anti").unionByName(salted)
    # At most 16**digits prefixes and 64 parts for each of the fewer than 10,000 repeated rows.
    start = spark.createDataFrame(starts, "__part string, __salt int, __start long")
    within = Window.partitionBy("__part", "__salt").orderBy("__key", "__tie")
    numbered = rows.join(F.broadcast(start), ["__part", "__salt"]).withColumn("__number", F.col("__start") + F.row_number().over(within) - 1)
    return numbered.drop("__part", "__salt", "__start"), total


def assign_shards(
    docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
    most_equal: int = 100_000,
) -> DataFrame:
    """docs with size, text_crc32, row_number, position, shard and slot (see the module's text)."""
    added = ("size", "text_crc32", "row_number", "position", "shard", "slot")
    text, key = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = {
        "__size": (F.octet_length(text) + 1).cast("long"),
        "__crc": F.crc32(text.cast("binary")),
        "__key": F.md5(F.concat_ws(":", F.coalesce(key, F.lit("null")), text).cast("binary")),
        "__tie": F.xxhash64(F.to_json(whole) if "map<" in docs.schema.simpleString() else whole),  # a map has no hash
    }
    rows = without(docs.withColumns(measured), *added)
    numbered, total = _numbered(rows, most_equal)
    position = permuted("__number", total, round_keys(seed)) if total else F.col("__number")
    placed = numbered.withColumn("__position", position)
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__number").alias("row_number"),
        F.col("__position").alias("position"),
        (F.col("__position") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("__position") / n_shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **options) -> None:
    """Writes one folder per shard, the rows of each file in slot order."""
    placed = assign_shards(docs, n_shards, **options)
    chunk = F.floor(F.col("slot") / 1_000_000)
    placed.repartition("shard", chunk).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle(n_shards: int = 8, seed: str = SEED) -> str:
    """DuckDB SQL for op10: the same numbering and network, walked by a recursive query."""
    keys = round_keys(seed)
    key = "CASE step % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(keys)) + " END"
    mix = lambda v: (
        f"list_reduce([0::BIGINT, ({v} * 40503 + {key}) % 2147483648], lambda x, y: xor("
        f"xor(y, y // 32768) * 48271 % 2147483648, xor(y, y // 32768) * 48271 % 2147483648 // 8192))"
    )
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS body,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS k
  FROM documents
), dims AS (
  SELECT c, a, greatest(1, (c + a - 1) // a) AS b
  FROM (SELECT count(*) AS c, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM base)
), poly(i, v, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, step + 1 FROM poly WHERE step < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM poly WHERE step = 8
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY k) - 1 AS n FROM base
), walk(n, step, l, r) AS (
  SELECT n, 0, n // b, n % b FROM numbered, dims
  UNION ALL
  SELECT n, step + 1,
         CASE WHEN step % 2 = 0 THEN (l + {mix("r")}) % a ELSE l END,
         CASE WHEN step % 2 = 1 THEN (r + {mix("l")}) % b ELSE r END
  FROM walk, dims
  WHERE step % 8 <> 0 OR step = 0 OR l * b + r >= c
), placed AS (
  SELECT n, l * b + r AS p FROM walk, dims WHERE step > 0 AND step % 8 = 0 AND l * b + r < c
)
SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size,
       xor(4294967295, list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(body))),
           lambda j: CAST('0x' || substr(hex(encode(body)), 2 * j + 1, 2) AS BIGINT))),
         lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) AS text_crc32,
       'rows' AS law, CAST(p % {n_shards} AS INTEGER) AS shard, p // {n_shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN placed USING (n), crc_table
"""
