"""Every registered query of the engine's own operators against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = rows(catalog.queries()[name](spark, DATA).toPandas())
    if name in catalog.oracle_sql():
        assert got == rows(duck.execute(catalog.oracle_sql()[name]).df())
    else:
        assert got[1]
