"""Every registered query against its SQL on the smallest tables, as the driver does on larger ones."""

import duckdb
import pytest

from tessella.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    return round(float(v), 8) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    cur = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in names) for r in rows], key=str)
    assert got == sorted([tuple(map(plain, r)) for r in cur.fetchall()], key=str)
