"""Every registered query of the library against its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, int)):
        return x
    return round(x, 5) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(name, spark, db):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE:
        assert rows
        return
    found = db.sql(registry.ORACLE[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
