"""Each registered query of the engine against its SQL, and the entry points."""

import math
import os

import duckdb
import pytest

from chronoframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(rows):
    return sorted((tuple(("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    found = duck.execute(registry.oracle_sql()[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == names
    want = [tuple(r[order.index(c)] for c in names) for r in found.fetchall()]
    assert normal(got.select(*[f"`{c}`" for c in names]).collect()) == normal(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
