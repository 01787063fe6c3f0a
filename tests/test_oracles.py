"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from tierscope.plans.catalog import QUERIES
from tierscope.plans.oracles import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 9))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"semantic_dedup_stored", "suspect_flags", "flags_in_order", "identity_batch", "scrub_all_rules", "visible_text", "evidence_hashes"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
