"""Every part has a label to resolve."""

import duckdb

from voxlake.plans import reports


def test_label_status_resolves_the_label_of_every_part(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    borne = {}
    for p in parts:
        borne.setdefault((p.p_name if len(p.p_name) % 2 == 0 else f"{p.p_name} {p.p_partkey}").strip().upper(), set()).add(p.p_partkey)
    want = set()
    for p in parts:
        name = "nobody" if p.p_partkey % 30 == 0 else p.p_name
        ships = borne.get(name.strip().upper(), set())
        want.add((p.p_partkey, name, ("unknown", "scorable")[len(ships)] if len(ships) < 2 else "ambiguous", min(ships) if len(ships) == 1 else None))
    got = [tuple(r) for r in reports.q_label_status(spark, sf_dir).select("p_partkey", "name", "status", "mmsi").collect()]
    assert len(got) == len(parts) and set(got) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf_dir}/part.parquet'")
    assert set(con.execute(reports.ORACLES["q_label_status"]).fetchall()) == want
