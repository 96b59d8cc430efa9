"""The lossless CSV: one line a row, read by several tasks, everything as it was."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from driftwise.operators.roundtrip import content_differences
from driftwise.sources.files import csv_to_parquet, escape_breaks, read_exact_csv, restore_breaks, write_csv

PARTS = ["\\", "\\\\", "\n", "\r", "\r\n", "\0", "\x01", '"', '""', ",", "\\N", "\\n", "\\0", "n", "N", " ", "\t", "a", "é", "\x85", " ", "日", "#"]


def _rows(n, seed=1):
    r = random.Random(seed)
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))
    return [(text(), r.choice([None, 1.5, float("nan"), -0.0, float("-inf")]), text(), r.choice([None, -7])) for _ in range(n)]


SCHEMA = "s string, d double, `a\nb,\"c` string, n bigint"


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in {r[0] for r in _rows(3000)}], "t string")
    got = df.select("t", escape_breaks(F.col("t")).alias("e")).select("t", "e", restore_breaks(F.col("e")).alias("r")).collect()
    assert all(r.r == r.t for r in got) and len({r.e for r in got}) == len(got)
    assert not any(c in (r.e or "") for r in got for c in "\n\r\0")


@pytest.mark.parametrize("header", [True, False])
def test_text_of_every_kind(spark, tmp_dir, header):
    df = spark.createDataFrame(_rows(2000), SCHEMA).repartition(3)
    write_csv(df, f"{tmp_dir}/c", header=header)
    back = read_exact_csv(spark, f"{tmp_dir}/c", df.schema, header=header)
    assert back.columns == df.columns and tuple(content_differences(df, back).first()) == (0, 0)
    lines = sum(open(f, newline="\n").read().count("\n") - header for f in glob.glob(f"{tmp_dir}/c/part*"))
    assert lines == 2000
    one = df.select("s")                # lines of blanks, of nothing, and of a null
    write_csv(one, f"{tmp_dir}/o", header=header)
    assert tuple(content_differences(one, read_exact_csv(spark, f"{tmp_dir}/o", "s string", header=header)).first()) == (0, 0)


def test_one_file_is_read_by_several_tasks(spark, tmp_dir):
    df = spark.createDataFrame(_rows(20_000, 2), SCHEMA).coalesce(1)
    write_csv(df, f"{tmp_dir}/c")
    assert len(glob.glob(f"{tmp_dir}/c/part*")) == 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = read_exact_csv(spark, f"{tmp_dir}/c", df.schema)
        per_task = back.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 10_000
        assert tuple(content_differences(df, back).first()) == (0, 0)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "multiLine" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_conversion_of_the_exact_form(spark, tmp_dir):
    df = spark.createDataFrame(_rows(300, 3), SCHEMA).withColumnRenamed("a\nb,\"c", "t")
    write_csv(df, f"{tmp_dir}/c")
    out = csv_to_parquet(spark, f"{tmp_dir}/c", f"{tmp_dir}/p", df.schema, exact=True)
    assert tuple(content_differences(df, out).first()) == (0, 0)
    with pytest.raises(ValueError, match="schema"):
        csv_to_parquet(spark, f"{tmp_dir}/c", f"{tmp_dir}/q", exact=True)
    with open(f"{tmp_dir}/bad.csv", "w") as f:
        f.write('"s","n"\n"x","1"\n"y","z"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_exact_csv(spark, f"{tmp_dir}/bad.csv", "s string, n bigint").collect()
