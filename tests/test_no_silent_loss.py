import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from driftwise import session
from driftwise.__main__ import main
from driftwise.functions.scalar import parse_timestamp
from driftwise.operators.align import ColumnGroups, align_positional
from driftwise.operators.compare import compare_frames, compare_groups
from driftwise.operators.roundtrip import compare_tables
from driftwise.sources.files import read_csv
from driftwise.sources.split_json import read_split_json
from driftwise.spec import DatasetSpec


def _file(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("line", ["x,1.5", "1,1.5,9"])
def test_csv_with_a_bad_row_raises(spark, tmp_dir, line):
    path = _file(tmp_dir, "t.csv", f"a,b\n1,2.5\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, path, "a bigint, b double").collect()


def test_csv_conversion_of_a_bad_row_fails(spark, tmp_dir):
    path = _file(tmp_dir, "t.csv", "a,b\n1,2.5\nx,1.5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        main(["convert", "--csv", path, "--parquet", os.path.join(tmp_dir, "out"), "--schema", "a bigint, b double"])


def test_malformed_split_document_raises(spark, tmp_dir):
    doc = json.dumps({"columns": ["a"], "index": [0], "data": [["1"]]})
    path = _file(tmp_dir, "t.json", f"{doc}\n{{broken\n{doc}\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_split_json(spark, path, "a bigint").collect()


def test_split_cell_that_does_not_convert(spark, tmp_dir):
    path = _file(tmp_dir, "t.json", json.dumps({"columns": ["a"], "index": [0], "data": [["x"]]}) + "\n")
    with pytest.raises(Exception, match="not a bigint"):
        read_split_json(spark, path, "a bigint").collect()
    assert read_split_json(spark, path, "a bigint", bad_cells="null").collect()[0].a is None


def test_timestamps_do_not_depend_on_daylight_saving(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-11-02T01:30:00-04:00",), ("2025-11-02T01:30:00-05:00",)], "t string")
        got = [str(r[0]) for r in df.select(parse_timestamp("t").cast("string")).collect()]
        assert got == ["2025-11-02 05:30:00", "2025-11-02 06:30:00"]
        df = spark.createDataFrame([("2025-03-09 02:30:00",), ("nonsense",)], "t string")
        got = [r[0] for r in df.select(parse_timestamp("t", "yyyy-MM-dd HH:mm:ss")).collect()]
        assert got == [dt.datetime(2025, 3, 9, 2, 30), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_loose_alignment_pairs_within_roles(spark):
    ref = spark.createDataFrame([(1, 2.0, 3.0)], "rid bigint, a double, b double")
    cur = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    got = align_positional(ref, cur, DatasetSpec(features=("a", "b"), id="rid"), DatasetSpec(features=("x", "y")), strict=False)
    assert got.ref.collect() == cur.collect() and got.spec.id is None


def test_contents_of_other_columns_are_different(spark):
    rows = compare_tables(spark, spark.range(2).toDF("a"), spark.range(2).toDF("b")).collect()
    assert {r["check"]: r.result for r in rows} == {"columns": "different", "types": "identical", "contents": "different"}


def test_no_local_scratch_on_a_cluster():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_unpaired_columns_are_in_the_report(spark):
    """Loose sides: what has no partner is listed with its own count, tested as skipped, not scored."""
    ref = spark.createDataFrame([(1, 2.0, "x", None), (2, 3.0, "y", "z")], "rid bigint, a double, b string, `c d` string")
    cur = spark.createDataFrame([(2.0, "x", "2024-01-01")], "x double, y string, t string")
    report = compare_frames(ref, cur, DatasetSpec(features=("a", "b", "c d"), id="rid"),
                            DatasetSpec(features=("x", "y"), datetimes=("t",)), strict=False)
    rows = {r.column_name: r for r in report.columns.collect()}
    assert {n: (r.kind, r.ref_count, r.cur_count, r.psi is None) for n, r in rows.items()} == {
        "x": ("numerical", 2, 1, False), "y": ("categorical", 2, 1, False), "rid": ("unpaired", 2, 0, True),
        "c d": ("unpaired", 1, 0, True), "t": ("unpaired", 0, 1, True)}
    assert report.summary.first().scored_columns == 2
    assert {r.column_name: r.status for r in report.tests.collect() if r.column_name in ("rid", "t", "c d")} == dict.fromkeys(("rid", "t", "c d"), "SKIPPED")


def test_an_empty_side_raises(spark):
    df, spec = spark.range(5).selectExpr("CAST(id AS DOUBLE) v"), DatasetSpec(features=("v",))
    for ref, cur, what in ((df.limit(0), df, "empty reference"), (df, df.where("v > 9"), "empty current"), (None, df, "missing reference")):
        with pytest.raises(ValueError, match=what):
            compare_frames(ref, cur, spec)
    assert compare_frames(df, df.limit(0), spec, empty="null").columns.first().psi is None
    with pytest.raises(ValueError, match="empty data"):
        compare_groups(df.withColumn("w", F.col("v")).limit(0), ColumnGroups(new_features=("v",), ref_features=("w",)))
    with pytest.raises(ValueError, match="raise"):
        compare_frames(df, df, spec, empty="maybe")
