"""Comparison by row digests: null-aware, type-aware, narrow, and rows on request."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwise.functions.digest import digest
from driftwise.operators.roundtrip import column_differences, content_differences, row_differences, types_differences
from tests.conftest import SF001

NESTED = "a array<int>, m map<string,array<int>>, s struct<p:int,q:int>, b binary, d double"
ROWS = [([1, None], {"a": None, "b": [1]}, (None, 2), b"x", 1.0), ([None, 1], {"b": [1], "a": None}, (None, 2), b"x", 1.0),
        ([1], {"b": [1], "a": None}, (2, None), b"x", 1.0), ([], {}, None, b"", float("nan")), (None, None, (None, None), None, None),
        ([1, None], {"a": [None]}, (None, 2), b"x", -0.0), ([1, None], {"a": []}, (None, 2), b"x", 0.0), ([0, 1], {"a": None}, (0, 2), b"\0", 1.0)]


def test_digests_tell_nulls_apart(spark):
    """Where a null stands matters at every depth, the order of a map's entries does not; -0.0 equals 0.0."""
    df = spark.createDataFrame(ROWS, NESTED)
    halves = digest([(F.col(f.name), f.dataType) for f in df.schema.fields])
    got = [tuple(r) for r in df.select(*halves).collect()]
    assert len(set(got)) == len(got) and all(len({g[i] for g in got}) == len(got) for i in (0, 1))
    twin = spark.createDataFrame([([1, None], {"b": [1], "a": None}, (None, 2), b"x", 1.0), ([1, None], {"a": []}, (None, 2), b"x", -0.0),
                                  ([], {}, None, b"", float("nan"))], NESTED)
    again = [tuple(r) for r in twin.select(*halves).collect()]
    assert again == [got[0], got[6], got[3]]
    flat = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), (None, None)], "a string, b string")
    halves = digest([(F.col(f.name), f.dataType) for f in flat.schema.fields])
    assert flat.select(*halves).distinct().count() == 4


def test_types_are_part_of_a_digest(spark):
    a = spark.createDataFrame([(1,)], "n int")
    b = a.select(F.col("n").cast("bigint"))
    assert tuple(content_differences(a, b).first()) == (1, 1) and types_differences(a.schema, b.schema) == 1
    with pytest.raises(ValueError, match="types"):
        row_differences(a, b)
    nullable = spark.sql("SELECT array(1) AS x"), spark.createDataFrame([([1],)], "x array<int>")
    assert types_differences(*(d.schema for d in nullable)) == 0 and tuple(content_differences(*nullable).first()) == (0, 0)


def test_the_shuffle_carries_a_digest_and_a_sign(spark):
    """However wide the rows: 24 bytes, no row and no text."""
    wide = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = content_differences(wide, wide.where("doc_id > 3"))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
    partial = re.search(r"Exchange hashpartitioning.*?\n.*?HashAggregate\(keys=\[([^\]]*)\], functions=\[([^\]]*)\], output=\[([^\]]*)\]", text, re.S)
    if partial:
        assert len(partial[3].split(",")) == 3
    keys = re.search(r"hashpartitioning\(([^)]*)\)", text)[1]
    assert [re.sub(r"#.*", "", k.strip()) for k in keys.split(",")[:2]] == ["_d1", "_d2"]


def _tables(spark, seed):
    r = random.Random(seed)
    rows = lambda n: [(r.choice([None, "a", "b", ""]), r.choice([None, 0, 1]), {"k": r.choice([None, "v"])}) for _ in range(n)]
    schema = "s string, n bigint, m map<string,string>"
    a, b = rows(80), rows(70)
    return a, b, spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("near", [1_000_000, 0])
def test_differing_rows(spark, near):
    """All copies counted, whether the digests are sent to the tasks or joined by shuffle."""
    key = lambda row: (row[0], row[1], tuple(row[2].items()))
    for seed in range(3):
        a, b, left, right = _tables(spark, seed)
        ca, cb = Counter(map(key, a)), Counter(map(key, b))
        got = {key(r[2:]): (r.only_left, r.only_right) for r in row_differences(left, right, broadcast_rows=near).collect()}
        assert got == {k: (max(0, ca[k] - cb[k]), max(0, cb[k] - ca[k])) for k in ca | cb if ca[k] != cb[k]}
        assert tuple(content_differences(left, right).first()) == (sum((ca - cb).values()), sum((cb - ca).values()))
    assert row_differences(left, left, broadcast_rows=near).count() == 0
    assert row_differences(left.limit(0), left, broadcast_rows=near).agg(F.sum("only_right")).first()[0] == 80


def test_differing_columns(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (2, None, 3.0)], "n int, s string, v double")
    b = spark.createDataFrame([(2, "x", 1), (1, "y", 2), (3, "y", 2)], "n int, t string, v int").withColumn("w", F.lit(1))
    got = [tuple(r) for r in column_differences(a, b).orderBy("position").collect()]
    assert got == [(0, "n", "n", True, True, 1, 1), (1, "s", "t", False, True, 1, 1), (2, "v", "v", True, False, None, None),
                   (3, None, "w", False, False, None, None)]
    empty = [tuple(r)[3:] for r in column_differences(a.limit(0), a.limit(0)).orderBy("position").collect()]
    assert empty == [(True, True, 0, 0)] * 3
    other = spark.createDataFrame([("x",)], "n string")
    assert [tuple(r)[3:] for r in column_differences(a.select("n"), other).collect()] == [(True, False, None, None)]
