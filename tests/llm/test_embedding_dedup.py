"""Operator 11 against all pairs in double precision."""

from collections import Counter

import numpy as np
import pytest

from voxlake.llm import embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, id string, n_links string"


def plain(rows):
    vectors = []
    for _, e in rows:
        v = None if e is None or not len(e) or any(x is None for x in e) else np.asarray(e, np.float32).astype(float)
        vectors.append(v if v is not None and np.isfinite(v).all() and v.any() else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j])
             and vectors[i] @ vectors[j] / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= 0.9] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        name = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(near[k]), name, rows[k][0] is not None and rows[k][0] == name)
    return Counter(out)


def found(spark, rows):
    table = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], "mine", "mine") for i, e in rows], SCHEMA)
    return Counter(map(tuple, op.near_duplicates(table).collect()))


def at_angle(r, v, cosine):
    """A vector of the given cosine with v."""
    w = r.normal(size=len(v))
    v = v / np.linalg.norm(v)
    w -= (w @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def some(seed=0, n=240, dim=24):
    r = np.random.default_rng(seed)
    rows = [(1000 + i, r.normal(size=dim) * 10.0 ** r.integers(-3, 3)) for i in range(n)]
    base = [v for _, v in rows[:30]]
    for k, c in enumerate([0.89, 0.899, 0.8999, 0.90001, 0.901, 0.91, 0.95, 0.9995] * 6):  # within the error of the codes, and beyond
        rows.append((5000 + k, at_angle(r, base[k % 30], c)))
    rows += [(7000 + k, base[0] + r.normal(size=dim) * 1e-3) for k in range(60)]  # a group of near copies
    rows += [(8000 + k, base[1]) for k in range(50)] + [(8000, base[1]), (None, base[1] * 4)]  # equal vectors, equal rows, no id
    chain = r.normal(size=dim)
    for k in range(12):  # linked only over the ones between
        rows.append((9000 - k, chain))
        chain = at_angle(r, chain, 0.93)
    rows += [(1, None), (2, []), (3, [0.0] * dim), (4, [float("nan")] + [1.0] * (dim - 1)), (5, [float("inf")] + [1.0] * (dim - 1)), (6, [None] + [1.0] * (dim - 1)), (None, None)]
    rows += [(7, base[0][:5]), (8, base[0][:5] * 3), (9, [3e38] * dim), (10, [1e-38] * dim), (11, [9.0, 3.0, 3.0, 1.0]), (12, [1.0, 0.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize(("block", "strip"), [(4096, 256), (40, 7)])
def test_equals_all_pairs(spark, monkeypatch, block, strip):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "STRIP", strip)
    assert found(spark, some()) == plain(some())


def test_tiles_far_apart_are_left_out_rightly(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    rows = [(i, centres[i % 6] + r.normal(size=12) * 0.15) for i in range(150)]
    assert found(spark, rows) == plain(rows)


def test_no_vectors(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark, [(1, None), (2, [0.0])]) == plain([(1, None), (2, [0.0])])


def test_error_bound_holds():
    r = np.random.default_rng(1)
    for dim in (2, 3, 64, 700):
        u = r.normal(size=(80, dim)) * r.choice([0.01, 1, 9], size=(80, dim))
        u /= np.linalg.norm(u, axis=1)[:, None]
        q, s, e = op.quantised(u)
        near = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
        assert (np.abs(near - u @ u.T) <= e[:, None] + (1 + e[:, None]) * e).all()


def test_forest_joins_what_links_join():
    r = np.random.default_rng(2)
    label = np.arange(50)
    a, b = r.integers(0, 50, 60), r.integers(0, 50, 60)
    x, y = op.forest(label, a, b)
    assert len(x) == 50 - len(set(label.tolist())) and (label[a] == label[b]).all()
    again = np.arange(50)
    op.forest(again, x, y)
    assert (again == label).all()
