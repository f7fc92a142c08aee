"""Registered queries of the training-data operators against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.llm import queries

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())
