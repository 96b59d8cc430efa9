"""Drift on more tables and columns against DuckDB: values must be equal to
the last bit (both engines evaluate the same bin formula in IEEE doubles)."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwise import DatasetSpec, compare_split
from driftwise.plans import oracle
from tests.conftest import SF01

CASES = [
    # table, numerical, categorical, split column, split value
    ("customer", ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "c_custkey", "700"),
    ("part", ["p_retailprice", "p_size"], ["p_brand", "p_type"], "p_partkey", "1000"),
    ("supplier", ["s_acctbal"], ["s_name"], "s_suppkey", "50"),
    ("lineitem", ["l_discount", "l_tax", "l_linenumber"], ["l_returnflag"], "l_partkey", "1500"),
    ("events", ["value"], ["props"], "user_id", "75"),
]


def _norm(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)


@pytest.mark.parametrize("table,num,cat,key,cut", CASES)
def test_drift_equals_duckdb(spark, table, num, cat, key, cut):
    df = spark.read.parquet(f"{SF01}/{table}.parquet")
    spec = DatasetSpec(features=tuple(num + cat))
    got = compare_split(df, spec, F.col(key) >= int(cut)).columns
    names = got.columns
    src = (f"SELECT CASE WHEN {key} >= {cut} THEN 1 WHEN {key} < {cut} THEN 0 END AS side, * "
           f"FROM read_parquet('{SF01}/{table}.parquet') WHERE {key} IS NOT NULL")
    res = duckdb.connect().execute(oracle.drift_columns_sql(src, num, cat))
    dnames = [c[0] for c in res.description]
    want = [tuple(r[dnames.index(n)] for n in names) for r in res.fetchall()]
    assert _norm(got.collect()) == _norm(want)
