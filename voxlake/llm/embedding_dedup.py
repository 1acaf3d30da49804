"""Operator 11, embedding near-dedup: int8 tile products with rigorous error bounds, full precision where they leave a doubt.

A vector u of length one is quantised to û = s q, q in -127..127, with its error e = |u - û| measured in double precision. For two vectors
|u.v - û.v̂| <= e_u + (1 + e_u) e_v, so the product of the codes decides most pairs: linked for sure, not linked for sure, or in doubt. A product of codes is a sum of integers
below 2**24 and exact in single precision (beyond 1,040 components double is used). Pairs in doubt are compared in double precision, dot / (|u| |v|), in a second pass
over the tiles that have any.

Equal vectors (up to a power of two) are one node, however many there are. Nodes are dealt to cells, by the nearest of at most ``PIVOTS`` vectors, and cells to
blocks of about ``BLOCK`` nodes by hash, so a cell with most nodes is many blocks. A tile is two blocks; one of which all angles exceed the bound by the triangle inequality
(angle of the centres less both radii) isn't computed. A tile gives, for each vector, how many it links to, and of its links a spanning forest: no list of
all pairs leaves a task, and a group of near copies costs some rows a vector and tile. Components come from the forests by star contraction.

Tiles are the work of the square of the nodes over BLOCK where vectors lie scattered; bounds by angle save tiles only where they lie in clusters. Only pivots reach the driver.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; so do vectors of different lengths; rows with equal
vectors link with each other, whatever their ids; equal rows are vectors of their own; a row without id counts as a link and may hold a component together, but never names it (one of
such rows only is named null) and is never kept; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .near_dedup import components

COSINE = 0.9
BLOCK, PIVOTS = 4096, 1024
#: Rows of a tile that are multiplied at once.
STRIP = 256
#: What rounding in double precision may add to an error bound.
SLACK = 1e-9
#: Components up to which a product of codes is exact in single precision.
EXACT = 2**24 // 127**2
_PACKED = "block int, dim int, fps binary, n binary, scale binary, error binary, codes binary, centre array<double>, radius double"
_FOUND = "i int, j int, a binary, b binary, links long, doubt binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, fp (null where a vector links with nothing), dim, vector (doubles, scaled by a power of two so that squares neither overflow nor vanish)."""
    for batch in batches:
        lists = batch.column(1)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
        start = np.cumsum(size) - size
        fps, vectors = [None] * len(lists), [None] * len(lists)
        for dim in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == dim)
            v = values[start[rows][:, None] + np.arange(dim)]
            top = np.abs(v).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            rows, v = rows[good], v[good]
            v = np.ldexp(v, -np.frexp(top[good])[1][:, None]) + 0.0  # no negative zero
            for r, x in zip(rows.tolist(), v, strict=True):
                vectors[r] = x.tobytes()
                fps[r] = hashlib.md5(vectors[r]).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(size, pa.int32()), pa.array(vectors, pa.binary())], ["id", "fp", "dim", "vector"])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scale and error of vectors of length one."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + SLACK
    return codes.astype(np.int8), scale, error


def _units(vectors: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors)).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _celled(pivots: dict[int, np.ndarray]):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in set(dims.tolist()) & set(pivots):
                rows = np.flatnonzero(dims == dim)
                cell[rows] = (_units(batch.column("vector").take(pa.array(rows)).to_pylist(), dim) @ pivots[dim].T).argmax(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    return cells


def _packed(table: pa.Table) -> pa.Table:
    """A block of nodes as one row, in the order of fp."""
    table = table.sort_by("fp")
    dim = table["dim"][0].as_py()
    unit = _units(table["vector"].to_pylist(), dim)
    codes, scale, error = quantised(unit)
    centre = unit.sum(axis=0)
    centre /= max(np.linalg.norm(centre), 1e-300)
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if np.linalg.norm(centre) > 0.5 else math.pi
    n = table["n"].to_numpy().astype(np.int64)
    row = {"block": table["block"][0].as_py(), "dim": dim, "fps": b"".join(table["fp"].to_pylist()), "n": n.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "codes": codes.tobytes(), "centre": centre.tolist(), "radius": radius}
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.float64()), pa.float64()]
    return pa.table({c: pa.array([x], t) for (c, x), t in zip(row.items(), kinds, strict=True)})


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links a-b that join what label holds apart; label (the least node of each tree) follows. Each round, a tree that meets a lesser one joins it."""
    kept_a, kept_b = [], []
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        chosen = np.full(len(label), -1)
        chosen[high] = np.arange(len(a))
        tops = np.flatnonzero(chosen >= 0)
        edge = chosen[tops]
        kept_a.append(a[edge])
        kept_b.append(b[edge])
        parent = np.arange(len(label))
        parent[tops] = low[edge]
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        label[:] = parent[label]
    none = np.zeros(0, np.int64)
    return np.concatenate(kept_a or [none]), np.concatenate(kept_b or [none])


class _Tile:
    """What a task finds in a tile: links per node of either block, and a spanning forest of the links."""

    def __init__(self, first: dict, second: dict | None):
        self.sides = [first, second or first]
        self.n = [np.frombuffer(s["n"], np.int64) for s in self.sides]
        self.same, self.size = second is None, len(self.n[0])
        self.links = [np.zeros(len(n), np.int64) for n in self.n]
        self.label = np.arange(self.size + (0 if self.same else len(self.n[1])))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a-b, node a of the first block and b of the second; of one block, each pair once."""
        self.links[0] += np.bincount(a, self.n[1][b], self.size).astype(np.int64)
        self.links[1] += np.bincount(b, self.n[0][a], len(self.n[1])).astype(np.int64)
        self.edges.append(forest(self.label, a, b if self.same else b + self.size))

    def found(self, i: int, j: int, doubts: list[np.ndarray]) -> pa.Table:
        fps = [f for s in (self.sides[:1] if self.same else self.sides) for f in np.frombuffer(s["fps"], "V16").tolist()]
        links = self.links[0] + self.links[1] if self.same else np.concatenate(self.links)
        some = np.flatnonzero(links).tolist()
        a, b = (np.concatenate([e[k] for e in self.edges] or [np.zeros(0, np.int64)]).tolist() for k in (0, 1))
        none = [None] * len(doubts)
        columns = [[fps[x] for x in some] + [fps[x] for x in a] + none, [None] * len(some) + [fps[x] for x in b] + none, links[some].tolist() + [0] * len(a) + none, [None] * (len(some) + len(a)) + [d.tobytes() for d in doubts]]
        rows = len(columns[0])
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("i", "j", "a", "b", "links", "doubt"), [[i] * rows, [j] * rows, *columns], kinds, strict=True)})


def _sides(i: int, j: int, rows: list[dict]) -> tuple[dict, dict | None]:
    by = {r["block"]: r for r in rows if r["block"] is not None}
    return by[i], by[j] if j != i else None


def _tile(cosine: float):
    def tile(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        first, second = _sides(i, j, table.to_pylist())
        found, doubts = _Tile(first, second), []
        dim = first["dim"]
        kind = np.float32 if dim <= EXACT else np.float64
        (qa, sa, ea), (qb, sb, eb) = ((np.frombuffer(s["codes"], np.int8).reshape(-1, dim).astype(kind), np.frombuffer(s["scale"]), np.frombuffer(s["error"])) for s in found.sides)
        qb = qb.T.copy()
        # The least product of codes that a row needs for any column: the largest scale and error of the other block.
        need = np.maximum((cosine - ea - (1 + ea) * eb.max() - SLACK) / (sa * sb.max()) - 1, -np.inf).astype(kind)
        for at in range(0, len(sa), STRIP):
            product = qa[at : at + STRIP] @ qb
            a, b = np.divmod(np.flatnonzero(product >= need[at : at + STRIP, None]), len(sb))
            near = product[a, b].astype(float)
            a += at
            if found.same:
                once = a < b
                a, b, near = a[once], b[once], near[once]
            near *= sa[a] * sb[b]
            bound = ea[a] + (1 + ea[a]) * eb[b] + SLACK
            sure = near - bound >= cosine
            found.add(a[sure], b[sure])
            doubt = ~sure & (near + bound >= cosine)
            if doubt.any():
                doubts.append(np.stack([a[doubt], b[doubt]]).astype(np.int32))
        return found.found(i, j, doubts)

    return tile


def _recheck(cosine: float):
    def recheck(key: tuple, table: pa.Table) -> pa.Table:
        """The pairs in doubt of a tile in double precision."""
        i, j = (k.as_py() for k in key)
        rows = table.to_pylist()
        found = _Tile(*_sides(i, j, rows))
        u, v = (np.frombuffer(s["vectors"]).reshape(-1, s["dim"]) for s in found.sides)
        nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
        for pairs in (np.frombuffer(r["doubt"], np.int32).reshape(2, -1).astype(np.int64) for r in rows if r["doubt"] is not None):
            for at in range(0, pairs.shape[1], 1 << 16):
                a, b = pairs[:, at : at + (1 << 16)]
                linked = np.einsum("pd,pd->p", u[a], v[b]) / (nu[a] * nv[b]) >= cosine
                found.add(a[linked], b[linked])
        return found.found(i, j, [])

    return recheck


def _vectors(table: pa.Table) -> pa.Table:
    """The vectors of a block in the order of its codes."""
    table = table.sort_by("fp")
    n = table["n"].to_numpy().astype(np.int64).tobytes()
    row = {"block": (table["block"][0].as_py(), pa.int32()), "dim": (table["dim"][0].as_py(), pa.int32()), "fps": (b"".join(table["fp"].to_pylist()), pa.binary()), "n": (n, pa.binary()), "vectors": (b"".join(table["vector"].to_pylist()), pa.binary())}
    return pa.table({c: pa.array([x], t) for c, (x, t) in row.items()})


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes with block: blocks of one dim and cell, of about BLOCK nodes, numbered through."""
    n_nodes = nodes.count()
    sample = nodes.orderBy("fp").limit(min(PIVOTS, n_nodes // BLOCK)).select("dim", "vector").collect()
    pivots = {dim: _units([r["vector"] for r in sample if r["dim"] == dim], dim) for dim in {r["dim"] for r in sample}}
    schema = "fp binary, id {}, n long, dim int, vector binary, cell int".format(nodes.schema["id"].dataType.simpleString())
    celled = written(nodes.select("fp", "id", "n", "dim", "vector").mapInArrow(_celled(pivots), schema), "cells")
    # PIVOTS rows for each length of vectors at most.
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    before = Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int"))
    block = F.col("start") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return written(celled.join(parts, ["dim", "cell"]).select("fp", "n", "dim", "vector", block.alias("block")), "blocks")


def links(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(fp, links) and edges (a, b) that hold the components together. nodes: fp, id, n, dim, vector."""
    blocks = _blocks(nodes)
    packed = written(blocks.groupBy("block").applyInArrow(_packed, _PACKED), "packed")
    last = Window.partitionBy("dim")
    here = packed.select("block", "dim", "centre", "radius").withColumn("last", F.max("block").over(last))
    other = here.select(F.col("block").alias("j"), F.col("centre").alias("centre_j"), F.col("radius").alias("radius_j"))
    met = here.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence("i", "last"))).join(other, "j")
    dot = F.aggregate(F.zip_with("centre", "centre_j", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))
    tiles = met.filter((F.col("i") == F.col("j")) | (angle <= F.col("radius") + F.col("radius_j") + math.acos(cosine) + 1e-6)).select("i", "j")
    sides = written(tiles.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))), "tiles")
    found = written(sides.join(packed.drop("centre", "radius"), "block").groupBy("i", "j").applyInArrow(_tile(cosine), _FOUND), "tile-links")
    doubts = found.filter("doubt IS NOT NULL").select("i", "j", "doubt")
    if doubts.head(1):
        sides = sides.join(doubts.select("i", "j").distinct(), ["i", "j"])
        needed = blocks.join(sides.select("block").distinct(), "block")
        full = needed.groupBy("block").applyInArrow(_vectors, "block int, dim int, fps binary, n binary, vectors binary")
        asked = sides.join(full, "block").unionByName(doubts, allowMissingColumns=True)
        found = found.unionByName(written(asked.groupBy("i", "j").applyInArrow(_recheck(cosine), _FOUND), "tile-links"))
    return found.filter("links > 0").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links")), found.filter("b IS NOT NULL").select("a", "b")


def near_duplicates(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: its id, n_links, component_id and kept."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    slim = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = written(slim.mapInArrow(_read, f"id {kind}, fp binary, dim int, vector binary"), "vectors")
    nodes = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    nodes = written(nodes, "nodes")
    linked, edges = links(nodes, cosine)
    roots = components(edges)
    known = nodes.select("fp", "id", "n").join(linked, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    known = written(known.select("fp", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "fp").alias("root")), "node-links")
    # Written before the joins, so that Spark can split a component or a vector of very many rows there.
    names = written(known.groupBy("root").agg(F.min("id").alias("component_id")), "component-names")
    told = written(known.select("fp", "n_links", "root").join(names, "root").select("fp", "n_links", "component_id"), "told")
    valid = rows.filter("fp IS NOT NULL").select("id", "fp").join(told, "fp").select("id", "n_links", "component_id")
    alone = rows.filter("fp IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return valid.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pair AS (
  SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {COSINE} ELSE false END
), reach(r, id) AS (
  SELECT r, vec_id FROM v
  UNION
  SELECT x, id FROM reach JOIN pair ON pair.y = reach.r
), component AS (
  SELECT r, min(id) AS component_id FROM reach GROUP BY r
), counted AS (
  SELECT x AS r, count(*) AS n_links FROM pair GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN component USING (r) LEFT JOIN counted USING (r)
"""
