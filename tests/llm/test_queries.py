"""The operators' queries over the given tables, and against their SQL."""

import glob
import os

import duckdb
import pytest

from tracelake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(tuple(r[x] for x in cols) for r in got.collect()) == sorted(want.project(", ".join(cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs_over_whole_tables(spark, name):
    n = queries.QUERIES[name](spark, SF).count()
    table = "pages" if name.startswith("op9") else "conversations" if name.startswith("op13") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = rows.select("conv_id").distinct().count() if table == "conversations" else rows.count()
    assert n == rows if not name.startswith("op3") else n > 0
