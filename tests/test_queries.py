"""Every catalogue query with an oracle, side by side with DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        return None if x is None or x != x else (repr(float(x)) if isinstance(x, float) else str(x))

    return sorted(
        (tuple(plain(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False)),
        key=repr,
    )


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    # the queries for training text have tests of their own
    own = {q for q in QUERIES if not q.startswith("op") and q != "pipeline"}
    assert {q for q in own if q not in ORACLES} == {
        "mllib_evaluate", "mllib_label_issues",
    }


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 8
