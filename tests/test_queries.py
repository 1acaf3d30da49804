"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, sql, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    cursor = sql.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.startswith("q_") and q not in ORACLES))
def test_finds_rows_without_sql(spark, sf_dir, name):
    """Their results are held against plain loops in test_without_sql, test_signal, test_whole_job, test_radio and test_panel."""
    found = QUERIES[name](spark, sf_dir)
    assert found.columns and found.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    find = __spark_entry__.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None if name in ("voxlake.llm", "corpus_pipeline") else find(name))
    assert __spark_entry__.queries() and all(name.startswith("q_") for name in __spark_entry__.queries())
