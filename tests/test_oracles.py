"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewatch import queries

TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"inc_full_equivalence"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def values(df):
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v).removesuffix(" 00:00:00") for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - SLOW))
def test_same_rows(spark, duck, data, name):
    ours, theirs = queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


def test_every_query_has_sql_but_the_one_with_a_hash_that_duckdb_lacks():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"fn_event_id"}
