"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from parlance.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_and_oracles():
    jobs, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(jobs) and len(jobs) >= 118
    assert set(jobs) == set(oracles)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    if not DATA.exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    near = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(map(near, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = sql.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


def test_entry_runs(spark):
    if not DATA.exists():
        pytest.skip("no tables here")
    df = entry.entry(spark)
    assert df.count() > 0 and "text" in df.columns
