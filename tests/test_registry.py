import os

import duckdb
import pandas as pd
import pytest

from groundwork.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    show = lambda v: None if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(map(show, r)) for r in df.itertuples(index=False)], key=str)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.dirname(e.__file__)
