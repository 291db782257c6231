"""Every registered query of the library against its SQL in another engine."""

import duckdb
import pytest

from tabulon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def key(row):
    return tuple((x is None, "n" if isinstance(x, (int, float)) else type(x).__name__, 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    if name not in catalog.SQL:
        assert got
        return
    rel = duck.sql(catalog.SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    expected = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert len(got) == len(expected)
    assert got == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
