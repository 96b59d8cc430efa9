import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwise import DatasetSpec, compare_frames
from driftwise.operators.roundtrip import compare_tables, content_differences, roundtrip_check
from driftwise.sources.files import csv_to_parquet, read_csv, write_csv
from driftwise.sources.report import read_report, write_report
from driftwise.sources.split_json import read_split_json, write_split_json
from driftwise.sources.tracking import experiments, has_rows
from tests.conftest import SF001


def results(df):
    return {r.check: (r.result, r.differences) for r in df.collect()}


def test_parquet_roundtrip_identical(spark, tmp_dir):
    cust = spark.read.parquet(f"{SF001}/customer.parquet")
    got = results(roundtrip_check(spark, cust, f"{tmp_dir}/c"))
    assert got == {"columns": ("identical", 0), "types": ("identical", 0), "contents": ("identical", 0)}


def test_planted_difference_is_found(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("y", None, 2), ("z", 3.0, 3)], "datum string, v double, n bigint")
    b = a.withColumn("datum", F.when(F.col("n") == 3, "changed").otherwise(F.col("datum")))
    got = results(compare_tables(spark, a, b))
    assert got["contents"] == ("different", 2)   # one row missing on each side
    # nulls compare equal, order does not matter, duplicates count
    assert results(compare_tables(spark, a, a.orderBy(F.desc("n"))))["contents"] == ("identical", 0)
    d = content_differences(a.union(a), a).first()
    assert (d.only_left, d.only_right) == (3, 0)


def test_schema_differences(spark):
    a = spark.createDataFrame([(1, "x")], "n bigint, s string")
    got = results(compare_tables(spark, a, a.select(F.col("n").cast("int"), "s")))
    assert got["types"] == ("different", 1) and got["contents"][1] is None
    got2 = results(compare_tables(spark, a, a.toDF("m", "s")))
    assert got2["columns"] == ("different", 1)


def test_map_columns_compare(spark):
    a = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>")
    b = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>")
    assert results(compare_tables(spark, a, b))["contents"] == ("identical", 0)


def test_csv_roundtrip_and_conversion(spark, tmp_dir):
    sup = spark.read.parquet(f"{SF001}/supplier.parquet")
    got = results(roundtrip_check(spark, sup, f"{tmp_dir}/s", fmt="csv", options={"header": "true"}))
    assert all(v == ("identical", 0) for v in got.values())
    write_csv(sup, f"{tmp_dir}/s2")
    pq = csv_to_parquet(spark, f"{tmp_dir}/s2", f"{tmp_dir}/s2.parquet", sup.schema)
    assert results(compare_tables(spark, sup, pq))["contents"] == ("identical", 0)


def test_split_json_roundtrip(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    write_split_json(orders, f"{tmp_dir}/j", rows_per_doc=100)
    back = read_split_json(spark, f"{tmp_dir}/j", orders.schema, index_col=None)
    assert back.schema.simpleString() == orders.schema.simpleString().replace("not null", "")
    assert results(compare_tables(spark, orders, back))["contents"] == ("identical", 0)


def test_split_json_document_from_pandas(spark, tmp_dir):
    pdf = pd.DataFrame({"a": [1, 2, None], "s": ["x", None, "z"], "f": [1.5, 2.0, 3.25]})
    for i in range(2):
        with open(f"{tmp_dir}/doc{i}.json", "w") as fh:
            fh.write(pdf.to_json(orient="split"))
    df = read_split_json(spark, tmp_dir, "f double, s string, a bigint", multi_line=True)
    rows = sorted((r["index"], r.a, r.s, r.f) for r in df.collect())
    assert rows[:3] == [(0, 1, "x", 1.5), (0, 1, "x", 1.5), (1, 2, None, 2.0)]
    assert len(rows) == 6


def test_experiments_projection(spark):
    raw = spark.createDataFrame([
        ("1", "a", "active", "loc/1", 1735689600000, 1735689601000, json.dumps({"k": "v"})),
        ("x", "b", "active", "loc/2", 0, 0, "{}"),
        ("3", "c", "deleted", "loc/3", 0, 0, None),
    ], "experiment_id string, name string, lifecycle_stage string, artifact_location string, "
       "creation_time bigint, last_update_time bigint, tags string")
    e = experiments(raw)
    rows = {r.name: r for r in e.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].experiment_id == 1 and rows["b"].experiment_id is None
    assert rows["a"].creation_time == dt.datetime(2025, 1, 1) and rows["a"].tags == {"k": "v"}
    assert experiments(raw, include_deleted=True).count() == 3
    assert dict(e.dtypes)["tags"] == "map<string,string>"
    assert has_rows(e) and not has_rows(e.where("false"))


def test_report_written_and_read_back(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    spec = DatasetSpec(features=("o_totalprice", "o_orderstatus"))
    rep = compare_frames(orders, orders, spec, spec)
    stored = write_report(spark, rep, f"{tmp_dir}/report")
    assert stored.columns.count() == 2
    assert stored.summary.first().scored_columns == 2
    again = read_report(spark, f"{tmp_dir}/report")
    assert again.tests.count() == 3


def test_csv_keeps_microseconds(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = results(roundtrip_check(spark, ev, f"{tmp_dir}/ev", fmt="csv", options={"header": "true"}))
    assert all(v == ("identical", 0) for v in got.values()), got


def test_csv_roundtrip_is_lossless_for_awkward_text(spark, tmp_dir):
    rows = [("a,b", 1.0, 1), ('say "hi"', float("nan"), None), ("", float("inf"), 3),
            (None, float("-inf"), 4), ("line1\nline2", -0.0, 5), ("  pad  ", 1e-300, 6)]
    df = spark.createDataFrame(rows, "s string, d double, n bigint")
    got = results(roundtrip_check(spark, df, f"{tmp_dir}/x", fmt="csv", options={"header": "true"}))
    assert got["contents"] == ("identical", 0), got


def test_split_json_awkward_values(spark, tmp_dir):
    rows = [("a,b", 1.0, 1), ('say "hi"', float("nan"), None), ("", float("inf"), 3),
            (None, float("-inf"), 4), ("line1\\nline2", -0.0, 5), ("  pad  ", 1e-300, 6)]
    df = spark.createDataFrame(rows, "s string, d double, n bigint")
    write_split_json(df, f"{tmp_dir}/j", rows_per_doc=2)
    back = read_split_json(spark, f"{tmp_dir}/j", df.schema, index_col=None)
    assert results(compare_tables(spark, df, back))["contents"] == ("identical", 0)


from collections import Counter  # noqa: E402

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_row = st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", ""])), st.one_of(st.none(), st.integers(0, 3)))


@settings(max_examples=6, deadline=None)
@given(st.lists(_row, max_size=30), st.lists(_row, max_size=30))
def test_content_differences_property(spark, a, b):
    schema = "s string, n bigint"
    d = content_differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first()
    ca, cb = Counter(a), Counter(b)
    assert (d.only_left, d.only_right) == (sum((ca - cb).values()), sum((cb - ca).values()))


def test_runs_and_map_tags(spark, tmp_dir):
    from driftwise.sources.tracking import read_export, runs
    raw = spark.createDataFrame(
        [("7", "e", "active", "loc", 0, 86_400_000, {"team": "x"})],
        "experiment_id string, name string, lifecycle_stage string, artifact_location string, "
        "creation_time bigint, last_update_time bigint, tags map<string,string>")
    e = experiments(raw).first()
    assert e.tags == {"team": "x"} and e.last_update_time == dt.datetime(1970, 1, 2)
    raw.write.json(f"{tmp_dir}/runs")
    with pytest.raises(ValueError, match="run_id"):
        runs(spark, f"{tmp_dir}/runs", fmt="json")
    assert read_export(spark, f"{tmp_dir}/runs", fmt="json").columns[0] == "artifact_location"
    with pytest.raises(ValueError, match="lacks"):
        experiments(raw.drop("tags"))


def test_split_json_without_index(spark, tmp_dir):
    pdf = pd.DataFrame({"a": [1, 2], "s": ["x", "y"]})
    with open(f"{tmp_dir}/doc.json", "w") as fh:
        fh.write(pdf.to_json(orient="split", index=False))
    df = read_split_json(spark, tmp_dir, "a bigint, s string", multi_line=True)
    assert sorted((r["index"], r.a, r.s) for r in df.collect()) == [(0, 1, "x"), (1, 2, "y")]


def test_split_json_one_row_per_document_has_no_shuffle(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    write_split_json(orders, f"{tmp_dir}/j1", rows_per_doc=1)
    back = read_split_json(spark, f"{tmp_dir}/j1", orders.schema)
    assert back.count() == orders.count()
    assert results(compare_tables(spark, orders, back.drop("index")))["contents"] == ("identical", 0)
    assert spark.read.text(f"{tmp_dir}/j1").count() == orders.count()


def test_json_roundtrip_keeps_microseconds(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = results(roundtrip_check(spark, ev, f"{tmp_dir}/evj", fmt="json"))
    assert all(v == ("identical", 0) for v in got.values()), got
