"""Every query with an oracle equals its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return 0.0 if v == 0 and isinstance(v, float) else v


def canonical(rows, order):
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    names = sorted(cols)
    assert (canonical(got, [df.columns.index(c) for c in names])
            == canonical(res.fetchall(), [cols.index(c) for c in names]))


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0

