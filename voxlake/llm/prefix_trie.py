"""Operator 13, conversation prefix trie: what conversations share from their first turn on, node by node.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. Turns become ids (a 128-bit hash of role and text with the
text's length), a conversation becomes a padded row of ids, and the distinct rows are dealt to tasks by ranges of their order. A range shard is an Arrow batch of a sorted
partition: its rows are put in order by a lexsort of the padded matrix, changes from row to row are OR-accumulated over the columns, so that a mark in column d starts a
node of depth d, and reduceat sums members, children, leaves and lengths for every depth. Only nodes on the path of a shard's first or last row can go on in another shard: of
these a shard gives the part that it sees, and the parts are recombined by a hash of the path.

Rows are ``WIDTH`` turns wide. A longer conversation lies in several rows, each known by the hash of all turns before it; rows with the same turns before them form a trie of
their own, which hangs below the node where those turns end. Tries of one row, the tails of long conversations, are done at once; the levels above the deepest branching
row follow from below, so the number of rounds is the depth of the deepest shared prefix over WIDTH, not the longest conversation's.

Sums over a subtree come from two additive parts: for members, the lengths of all their turns from a node on, and for nodes, the length of each distinct turn; their difference
is the sum of (members - 1) * length. Turns are numbered in parts of an ordered table, so one conversation may hold most rows; equal rows of turns are counted before they are
dealt, so any number of copies is one row. Ids of members that end at a node are written as texts of ``CHUNK`` ids at most, and hashed as they stream by.

``rebuilt`` makes the conversations of the query: those of a hundred ids begin with the first turns of one of them.

Defined cases: turns are ordered by number, null first, then role, the first 64 characters of the text and a hash of both, so the order never hangs on partitions; equal
rows are turns of their own; null role and text are empty; rows without conv_id belong to no conversation and go; a conversation may have no turns, then it ends at
the root; an empty table gives an empty result. % keeps the sign of a negative id, as in SQL. Texts count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WIDTH, CHUNK = 64, 4096
#: Most turns that a rebuilt conversation takes from the head of its hundred, plus one.
HEADS, HUNDRED = 6, 100
#: Characters of a turn's id: 32 of the hash, 10 of the length.
ID = 42
NOBODY = hashlib.sha256().hexdigest()
_NODES = (
    "k int, b1 long, b2 long, depth int, edge boolean, key string, parent string, path array<string>, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, total long, once long, chars long, ends_sha256 string"
)
_ROW = ("k", "b1", "b2", "ids")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place of a turn in its conversation, from 1), id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"), F.concat(hashed, F.lpad(F.length(text).cast("string"), ID - 32, "0")).alias("id"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ("conv_id", F.asc_nulls_first("turn"), "r", "t", "id", "tie")
    parts = written(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    # Of a conversation that goes over several parts, the turns in earlier ones; two conversations a part at most have any.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.sum("n").over(before).alias("offset")).filter("offset > 0")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:]))
    return parts.withColumn("p", within).join(offset, ["conv_id", "part"], "left").select("conv_id", (F.col("p") + F.coalesce("offset", F.lit(0))).alias("p"), "id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, id) of the rebuilt conversations, and every (conv_id, length) of them. turns: conv_id, p, id."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({
        "head": F.expr(f"conv_id - conv_id % {HUNDRED}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS,
    })
    heads = turns.filter(F.expr(f"conv_id % {HUNDRED} = 0 AND p < {HEADS}")).withColumnRenamed("conv_id", "head")
    lead = heads.groupBy("head").agg(F.count("*").alias("lead"))
    convs = convs.join(lead, "head", "left").withColumn("lead", F.least("h", F.coalesce("lead", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt-lengths")
    led = convs.join(heads, "head").filter("p <= h").select("conv_id", F.col("p").alias("depth"), "id")
    own = turns.join(convs.select("conv_id", "h", "lead"), "conv_id").filter("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("lead")).alias("depth"), "id")
    return led.unionByName(own), convs.select("conv_id", "length")


def _rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows of WIDTH turns at most: conv_id, k, b1 and b2 (hash of the turns before), ids, a1 and a2 (hash with its own), later (length of the turns after), last."""
    dealt = turns.groupBy("conv_id", F.expr(f"cast((depth - 1) div {WIDTH} as int)").alias("k")).agg(F.sort_array(F.collect_list(F.struct("depth", "id"))).alias("turns"))
    rows = dealt.select("conv_id", "k", F.array_join("turns.id", "").alias("ids"), F.aggregate("turns.id", F.lit(0).cast("long"), lambda s, t: s + F.substring(t, 33, ID - 32).cast("long")).alias("chars"))
    none = lengths.filter("length = 0").select("conv_id", F.lit(0).alias("k"), F.lit("").alias("ids"), F.lit(0).cast("long").alias("chars"))
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = (F.xxhash64("k", "ids"), F.xxhash64("ids", F.lit("second"), "k"))
    rows = rows.unionByName(none).withColumns({
        "b1": F.coalesce(F.bit_xor(own[0]).over(before), F.lit(0)), "b2": F.coalesce(F.bit_xor(own[1]).over(before), F.lit(0)),
        "later": F.sum("chars").over(conv) - F.sum("chars").over(conv.orderBy("k")), "last": F.col("k") == F.max("k").over(conv),
    })
    return rows.withColumns({"a1": F.col("b1").bitwiseXOR(own[0]), "a2": F.col("b2").bitwiseXOR(own[1]), "row": F.md5(F.concat_ws(" ", *_ROW))})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, sha: texts of one row lie together and in order; a hash goes on over batches."""
    row, state = None, None
    schema = pa.schema([("row", pa.string()), ("sha", pa.string())])
    for batch in batches:
        done = []
        for now, text in zip(batch.column("row").to_pylist(), batch.column("convs").to_pylist(), strict=True):
            if now != row:
                if row is not None:
                    done.append((row, state.hexdigest()))
                row, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([state.hexdigest()])], schema=schema)


def _ends(rows: DataFrame) -> DataFrame:
    """row, sha: the hash of the ids of all conversations that end with a row."""
    chunk = F.floor(F.col("conv_id") / CHUNK)
    texts = rows.filter("last").groupBy("row", chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("convs"))
    return texts.repartition("row").sortWithinPartitions("row", "chunk").select("row", "convs").mapInArrow(_hashed, "row string, sha string")


def _path(group: str, ids: str) -> list[str]:
    """Keys of the nodes from a trie's root down along a row."""
    return [hashlib.md5(f"{group} {ids[: ID * d]}".encode()).hexdigest() for d in range(len(ids) // ID + 1)]


def _trie(batch: pa.RecordBatch) -> dict[str, list]:
    """The nodes of a shard of rows, those on its edges in part."""
    ids = np.array(batch.column("ids").to_pylist(), object)
    lens = np.array([len(x) // ID for x in ids])
    col = {c: np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("k", "b1", "b2", "n", "first", "later", "above", "kids", "leaves", "below")}
    sha = np.array(batch.column("sha").to_pylist(), object)
    m, width = len(ids), int(lens.max())
    _, group = np.unique(np.stack([col["k"].astype(np.int64), col["b1"], col["b2"]]), axis=1, return_inverse=True)
    flat = np.frombuffer("".join(ids).encode(), f"S{ID}")
    known, code = np.unique(flat, return_inverse=True)
    length_of = np.array([int(x[32:]) for x in known], np.int64)
    matrix, chars = np.zeros((m, width + 1), np.int64), np.zeros((m, width + 1), np.int64)
    filled = np.arange(1, width + 1) <= lens[:, None]
    matrix[:, 0], matrix[:, 1:][filled] = group.ravel(), code.ravel() + 1
    chars[:, 1:][filled] = length_of[code.ravel()]
    order = np.lexsort(matrix.T[::-1])
    matrix, chars, lens, ids, sha = matrix[order], chars[order], lens[order], ids[order], sha[order]
    col = {c: x[order] for c, x in col.items()}
    starts = np.ones((m, width + 1), bool)
    starts[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    onward = col["later"][:, None] + col["n"][:, None] * chars[:, ::-1].cumsum(axis=1)[:, ::-1]
    below, leaves, kids = (np.zeros(m, np.int64) for _ in range(3))  # of the children, at the rows where they start
    found = []
    for d in range(width, -1, -1):
        rows = np.flatnonzero(lens >= d)
        first = np.flatnonzero(starts[rows, d])
        at, ends = rows[first], lens[rows] == d
        edge = np.zeros(len(at), bool)
        edge[0] |= lens[0] >= d
        edge[-1] |= lens[-1] >= d
        sums = lambda inner, own: np.add.reduceat(inner[rows] + np.where(ends, own[rows], 0), first)  # noqa: E731,B023
        once, n_kids, n_leaves = sums(below, col["below"]), sums(kids, col["kids"]), sums(leaves, col["leaves"])
        once += np.where(edge, 0, chars[at, d])
        n_leaves += ~edge & (n_kids == 0)
        hashes = np.full(len(at), None, object)
        ended = rows[ends]
        hashes[np.searchsorted(at, ended, "right") - 1] = sha[ended]
        found.append({
            "at": at, "depth": np.full(len(at), d), "edge": edge, "n_convs": np.add.reduceat(col["n"][rows], first), "conv_id": np.minimum.reduceat(col["first"][rows], first),
            "n_children": n_kids, "n_leaves": n_leaves, "total": np.add.reduceat(onward[rows, d], first), "once": once, "chars": chars[at, d], "ends_sha256": hashes,
        })
        below, leaves, kids = (np.zeros(m, np.int64) for _ in range(3))
        below[at], leaves[at], kids[at] = once, n_leaves, ~edge
    found.reverse()
    paths = {r: _path(f"{col['k'][r]} {col['b1'][r]} {col['b2'][r]}", ids[r]) for r in {0, m - 1}}
    for d, level in enumerate(found):
        at, edge, n = level["at"], level["edge"], len(level["at"])
        level["key"], level["parent"], level["path"] = (np.full(n, None, object) for _ in range(3))
        for i in np.flatnonzero(edge):
            path = paths[0 if i == 0 and lens[0] >= d else m - 1]
            level["key"][i], level["path"][i] = path[d], path[: d + 1]
            level["parent"][i] = path[d - 1] if d else None
        level |= {c: col[c][at] for c in ("k", "b1", "b2")}
        if d == 0:
            level["parent_conv_id"] = np.full(n, None, object)
            continue
        over = found[d - 1]
        up = np.searchsorted(over["at"], at, "right") - 1
        level["parent_conv_id"] = np.where(over["edge"][up], None, over["conv_id"][up].astype(object))
        level["parent"] = np.where(over["edge"][up], over["key"][up], None)
        if d == 1:  # a trie that hangs below a node: its root is that node, and known
            hung = col["k"][at] > 0
            level["parent_conv_id"], level["parent"] = np.where(hung, col["above"][at].astype(object), level["parent_conv_id"]), np.where(hung & ~edge, None, level["parent"])
    return {c: np.concatenate([level[c] for level in found]) for c in found[0]}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"k": pa.int32(), "depth": pa.int32(), "edge": pa.bool_(), "key": pa.string(), "parent": pa.string(), "path": pa.list_(pa.string()), "ends_sha256": pa.string()}
    names = [c.split()[0] for c in _NODES.split(", ")]
    for batch in batches:
        if batch.num_rows:
            nodes = _trie(batch)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[c].tolist(), kinds.get(c, pa.int64())) for c in names], names)


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the tries of rows: those below a root (and the root of all), and the roots' sums as what hangs below (k, a1, a2)."""
    dealt = rows.repartitionByRange(*_ROW).sortWithinPartitions(*_ROW)
    nodes = written(dealt.select(*_ROW, "n", "first", "later", "above", "kids", "leaves", "below", "sha").mapInArrow(_shards, _NODES), "shard-nodes")
    # Edges: the parts of a node add up; children and leaves among edges count once they are whole.
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "once")]
    same = [F.max(c).alias(c) for c in ("k", "b1", "b2", "depth", "parent", "path", "chars", "ends_sha256", "parent_conv_id")]
    edges = written(nodes.filter("edge").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *same), "edges")
    children = edges.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    edges = edges.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    edges = written(edges.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "edges")
    inner = edges.select(F.explode("path").alias("key"), "chars", "leaf").groupBy("key").agg(F.sum("chars").alias("c"), F.sum("leaf").alias("l"))
    edges = edges.join(inner, "key").withColumns({"once": F.col("once") + F.col("c"), "n_leaves": F.col("n_leaves") + F.col("l")})
    told = ("k", "b1", "b2", "depth", "conv_id", "parent_conv_id", "parent", "n_convs", "n_children", "n_leaves", "total", "once", "ends_sha256")
    whole = written(edges.select(*told).unionByName(nodes.filter("NOT edge").select(*told)), "nodes")
    # A parent on an edge gets its least id only now.
    parents = written(edges.select(F.col("key").alias("parent"), F.col("conv_id").alias("up")), "edge-parents")
    named = whole.filter("parent IS NOT NULL AND parent_conv_id IS NULL").join(parents, "parent", "left").withColumn("parent_conv_id", F.col("up")).drop("up")
    whole = named.unionByName(whole.filter("parent IS NULL OR parent_conv_id IS NOT NULL"), allowMissingColumns=True)
    hung = whole.filter("k > 0 AND depth = 0").select((F.col("k") - 1).alias("k"), F.col("b1").alias("a1"), F.col("b2").alias("a2"), "n_children", "n_leaves", "once")
    return whole.filter("k = 0 OR depth > 0"), hung


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node. turns: conv_id, depth, id; lengths: every conv_id with its number of turns."""
    rows = written(_rows(turns, lengths), "conversation-rows")
    distinct = rows.groupBy(*_ROW, "row", "a1", "a2").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum("later").alias("later"), F.max("later").alias("below"), F.sum((~F.col("last")).cast("long")).alias("go_on")
    )
    distinct = written(distinct.join(_ends(rows), "row", "left"), "distinct-rows")
    above = distinct.select((F.col("k") + 1).alias("k"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("first").alias("above")).filter("k > 0")
    tails = distinct.filter("k > 0").join(above, ["k", "b1", "b2"])
    distinct = distinct.filter("k = 0").withColumn("above", F.lit(0).cast("long")).unionByName(tails)
    deepest = distinct.filter("k > 0").groupBy("k", "b1", "b2").count().filter("count > 1").agg(F.max("k")).first()[0] or 0
    goes = (F.col("go_on") > 0).cast("long")
    # Below the deepest branching row each trie is a single tail: one child, one leaf, and as much below as the longest member has.
    distinct = distinct.withColumns({"kids": goes, "leaves": goes})
    nodes, hung = _level(distinct.filter(F.col("k") >= deepest))
    for k in range(deepest - 1, -1, -1):
        known = hung.filter(F.col("k") == k).withColumnsRenamed({"n_children": "kids", "n_leaves": "leaves", "once": "below"})
        level = distinct.filter(F.col("k") == k).drop("kids", "leaves", "below").join(known, ["k", "a1", "a2"], "left").na.fill(0, ["kids", "leaves", "below"])
        found, hung = _level(level)
        nodes = nodes.unionByName(found)
    return nodes.select(
        "conv_id", (F.col("k") * WIDTH + F.col("depth")).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(*rebuilt(written(numbered_turns(conversations), "numbered-turns")))


ORACLE = f"""
WITH RECURSIVE poly(i, v, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, step + 1 FROM poly WHERE step < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM poly WHERE step = 8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r[:64], t[:64], md5(length(r) || ':' || r || t)) AS p, length(r) || ':' || r || t AS id, length(t) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {HUNDRED} AS head,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(conv_id::VARCHAR)), lambda j: ascii(substr(conv_id::VARCHAR, j + 1, 1))::BIGINT)),
           lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), seqs AS (
  SELECT convs.conv_id, list(id ORDER BY own, p) FILTER (p IS NOT NULL) AS ids, list(chars ORDER BY own, p) FILTER (p IS NOT NULL) AS chars
  FROM convs LEFT JOIN (
    SELECT c.conv_id, false AS own, p, id, chars FROM convs c JOIN turns ON turns.conv_id = c.head AND p <= h
    UNION ALL
    SELECT conv_id, true, p, id, chars FROM convs JOIN turns USING (conv_id) WHERE p > h
  ) USING (conv_id) GROUP BY ALL
), members AS (
  SELECT conv_id, coalesce(len(ids), 0) AS l, unnest(range(0, coalesce(len(ids), 0) + 1)) AS depth, ids, chars FROM seqs
), nodes AS (
  SELECT depth, coalesce(ids[:depth], []) AS seq, CASE WHEN depth > 0 THEN md5(array_to_string(ids[:depth - 1], chr(1))) END AS up, md5(coalesce(array_to_string(ids[:depth], chr(1)), '')) AS own,
         min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars[depth]) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = l), '')) AS ends_sha256
  FROM members GROUP BY ALL
), kids AS (
  SELECT up AS own, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (own, depth)
), over AS (
  SELECT n.n_convs, n.chars, n.n_children, n.depth AS below, unnest(range(0, n.depth + 1)) AS depth, n.seq FROM counted n
), sums AS (
  SELECT depth, md5(array_to_string(seq[:depth], chr(1))) AS own, sum((n_children = 0)::INT)::BIGINT AS n_leaves, coalesce(sum((n_convs - 1) * chars) FILTER (below > 0), 0)::BIGINT AS saved_tokens FROM over GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums ON sums.own = c.own AND sums.depth = c.depth LEFT JOIN counted p ON p.own = c.up AND p.depth = c.depth - 1
"""
