"""Runs of several exports with different columns as one table."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from driftwise.sources.tracking import fold_run_columns, latest_runs, merge_runs, runs

FIRST = ("run_id string, experiment_id string, status string, artifact_uri string, start_time timestamp, end_time timestamp, "
         "`params.depth` string, `params.a.b` string, `metrics.auc` double, `tags.owner` string, stage string")
SECOND = "run_id string, experiment_id bigint, start_time bigint, `metrics.loss` string, `params.depth` int, nested struct<x:int>, `params.` string"


def _exports(spark):
    t = dt.datetime(2025, 1, 1, 12)
    first = spark.createDataFrame([("r1", "7", "FINISHED", "loc/1", t, t, "3", None, 0.9, "me", "prod"),
                                   ("r2", "x", "FAILED", None, t, None, None, "q", float("nan"), None, None)], FIRST)
    second = spark.createDataFrame([("r3", 8, 86_400_000, "0.25", 4, (1,), "odd"), ("r4", None, None, None, None, None, None)], SECOND)
    return first, second


def test_columns_become_maps(spark):
    rows = {r.run_id: r for r in merge_runs(list(_exports(spark))).collect()}
    assert set(rows) == {"r1", "r2", "r3", "r4"}
    a, b, c, d = (rows[k] for k in ("r1", "r2", "r3", "r4"))
    assert (a.experiment_id, a.status, a.start_time) == (7, "FINISHED", dt.datetime(2025, 1, 1, 12))
    assert (a.params, a.metrics, a.tags, a.others) == ({"depth": "3"}, {"auc": 0.9}, {"owner": "me"}, {"stage": "prod"})
    assert b.experiment_id is None and b.end_time is None and b.params == {"a.b": "q"} and b.tags == {} and b.others == {}
    assert math.isnan(b.metrics["auc"])
    assert (c.experiment_id, c.status, c.artifact_uri, c.start_time, c.end_time) == (8, None, None, dt.datetime(1970, 1, 2), None)
    assert (c.params, c.metrics, c.tags, c.others) == ({"depth": "4"}, {"loss": 0.25}, {}, {"nested": '{"x":1}', "params.": "odd"})
    assert (d.params, d.metrics, d.tags, d.others) == ({}, {}, {}, {})


def test_types_and_plan(spark):
    both = merge_runs(list(_exports(spark)))
    assert dict(both.dtypes) == {"run_id": "string", "experiment_id": "bigint", "status": "string", "artifact_uri": "string",
                                 "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "params": "map<string,string>",
                                 "metrics": "map<string,double>", "tags": "map<string,string>", "others": "map<string,string>"}
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_a_metric_that_is_no_number(spark):
    bad = spark.createDataFrame([("r9", "high")], "run_id string, `metrics.auc` string")
    with pytest.raises(Exception, match="no double in run r9"):
        fold_run_columns(bad).collect()
    assert fold_run_columns(bad, strict=False).first().metrics == {}
    with pytest.raises(ValueError, match="run_id"):
        fold_run_columns(bad.drop("run_id"))
    with pytest.raises(ValueError, match="no export"):
        merge_runs([])


def test_exports_from_files_and_reruns(spark, tmp_dir):
    first, second = _exports(spark)
    again = second.where("run_id = 'r3'").withColumn("run_id", F.lit("r2")).withColumn("end_time", F.lit(1000))
    paths = [f"{tmp_dir}/{k}" for k in range(3)]
    for p, e in zip(paths, (first, second, again)):
        e.write.parquet(p)
    every = runs(spark, paths)
    assert every.count() == 5 and runs(spark, paths[:1]).where("false").count() == 0
    last = {r.run_id: r for r in latest_runs(every).collect()}
    assert len(last) == 4 and last["r2"].metrics == {"loss": 0.25} and last["r1"].params == {"depth": "3"}
    spark.createDataFrame([("r1", 1.5)], "run_id string, `metrics.a b` double").write.json(f"{tmp_dir}/j")
    assert runs(spark, [f"{tmp_dir}/j"], fmt="json").first().metrics == {"a b": 1.5}


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT 'r' AS run_id, TIMESTAMP'2025-01-01 00:00:00Z' AS start_time, 1735689600000 AS end_time")
        row = fold_run_columns(df).selectExpr("CAST(start_time AS STRING) s", "CAST(end_time AS STRING) e").first()
        assert tuple(row) == ("2025-01-01 00:00:00", "2025-01-01 00:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
