"""Every named query runs; where SQL can express it, its rows equal DuckDB's."""

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got, "no rows"
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


def test_net_addresses_of_any_key(spark, tmp_path):
    keys = [None, 0, 24, 25, 255, 65280, 65281, 65305, 899_999, -1, -232, -65281, 140_187_732_541_561, -140_187_732_541_561]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r[c] for c in ("c_custkey", "ip", "back", "bad")) for r in registry.queries()["net_addresses"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.sql(f"SELECT c_custkey, ip, back, bad FROM ({ORACLES['net_addresses']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(65280, "255.255.255.0", 4294967040, False), (65281, "256.1.0.1", 4295032833, False), (None, None, None, None)} <= set(got)
