"""Registered queries: every one runs, matches its DuckDB oracle on sf0.001,
and the drift plans read only what they use."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from driftwise.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["column_name", "kind", "bins", "ref_count", "cur_count", "psi", "threshold", "drifted"]
    assert df.count() == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF001)
    res = duck.execute(ORACLE_SQL[name])
    dnames = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dnames)
    assert _rows(sdf.columns, sdf.collect()) == _rows(dnames, res.fetchall())


def test_drift_plan_prunes_and_broadcasts_bounded_side(spark):
    import re
    df = QUERIES["drift_columns_orders"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    allowed = {"o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"}
    for sch in schemas:
        cols = {f.split(":")[0] for f in sch.split(",")}
        assert cols <= allowed, sch          # never the id, never unused columns
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Generate posexplode(" in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_links_plan_has_group_limit(spark):
    plan = QUERIES["bounded_id_list"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairwise_joins(spark, name):
    df = QUERIES[name](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                "CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in plan, (name, bad)
