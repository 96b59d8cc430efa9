from pyspark.sql import functions as F

from driftwise import DatasetSpec, compare_frames
from driftwise.streaming.monitor import drift_stream, read_stream_results
from tests.conftest import SF001

SPEC = DatasetSpec(features=("user_id", "event_type", "value"), id="event_id", datetimes=("ts",))


def test_each_micro_batch_is_scored(spark, tmp_dir):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    split = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    reference = events.where(F.col("ts") < split)
    later = events.where(F.col("ts") >= split)
    # three files arrive, one per trigger
    for i, part in enumerate(later.randomSplit([1.0, 1.0, 1.0], seed=3)):
        part.coalesce(1).write.parquet(f"{tmp_dir}/in/part{i}")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in"))
    q = drift_stream(spark, stream, reference, SPEC, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    out = read_stream_results(spark, f"{tmp_dir}/out")
    epochs = sorted({r.epoch for r in out.select("epoch").collect()})
    assert epochs == [0, 1, 2]
    # every epoch equals the batch comparison of its own rows
    files = sorted(spark.read.parquet(f"{tmp_dir}/in/part{i}").count() for i in range(3))
    assert sorted(r.cur_count for r in out.where("column_name = 'value'").collect()) == files
    one = out.where("epoch = 0").collect()
    assert {r.column_name for r in one} == {"user_id", "event_type", "value"}
    assert all(r.psi is not None and r.psi >= 0 for r in one)


def test_whole_stream_equals_batch(spark, tmp_dir):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    split = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    events.where(F.col("ts") >= split).coalesce(1).write.parquet(f"{tmp_dir}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_dir}/in")
    reference = events.where(F.col("ts") < split)
    q = drift_stream(spark, stream, reference, SPEC, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    got = {r.column_name: r.psi for r in read_stream_results(spark, f"{tmp_dir}/out").collect()}
    want = {r.column_name: r.psi for r in compare_frames(
        reference, events.where(F.col("ts") >= split), SPEC, SPEC).columns.collect()}
    assert got == want


def test_reference_without_materializing(spark, tmp_dir):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    split = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    events.where(F.col("ts") >= split).coalesce(1).write.parquet(f"{tmp_dir}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_dir}/in")
    reference = events.where(F.col("ts") < split)
    q = drift_stream(spark, stream, reference, SPEC, f"{tmp_dir}/out", f"{tmp_dir}/ckpt",
                     materialize_reference=False)
    q.awaitTermination()
    assert read_stream_results(spark, f"{tmp_dir}/out").count() == 3


def test_batch_input_is_refused(spark):
    import pytest
    events = spark.read.parquet(f"{SF001}/events.parquet")
    with pytest.raises(ValueError, match="streaming"):
        drift_stream(spark, events, events, SPEC, "/nonexistent")


def test_stream_query_reads_a_table_stored_as_a_folder(spark, tmp_dir):
    from driftwise.plans.queries import drift_stream_events
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_dir}/events.parquet")
    got, want = (sorted(map(tuple, drift_stream_events(spark, d).collect())) for d in (tmp_dir, SF001))
    assert got == want and got


def test_restart_goes_on_and_an_empty_stream_has_no_rows(spark, tmp_dir):
    from driftwise.streaming import drift_stream, read_stream_results
    source, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    spark.range(0).selectExpr("CAST(id AS DOUBLE) v").write.parquet(source)
    reference, spec = spark.range(50).selectExpr("CAST(id AS DOUBLE) v"), DatasetSpec(features=("v",))

    def run():
        stream = spark.readStream.schema("v double").parquet(source)
        drift_stream(spark, stream, reference, spec, out).awaitTermination()
        return [(r.epoch, r.cur_count) for r in read_stream_results(spark, out).orderBy("epoch").collect() if r.cur_count]

    assert run() == []
    reference.write.mode("append").parquet(source)
    first = run()
    assert [n for _, n in first] == [50]
    reference.limit(20).coalesce(1).write.mode("append").parquet(source)
    assert [n for _, n in run()] == [50, 20]


def test_restart_keeps_the_reference_it_began_with(spark, tmp_dir):
    """The source of the reference changes between two starts: both score against the same rows."""
    source, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    rows = spark.range(100).selectExpr("CAST(id AS DOUBLE) v")
    rows.write.parquet(source)
    spec = DatasetSpec(features=("v",))

    def run(reference):
        stream = spark.readStream.schema("v double").parquet(source)
        drift_stream(spark, stream, reference, spec, out).awaitTermination()
        return [(r.ref_count, r.psi) for r in read_stream_results(spark, out).orderBy("epoch").collect() if r.cur_count]

    first = run(rows)
    rows.write.mode("append").parquet(source)
    again = run(rows.where("v < 10"))
    assert first == [(100, 0.0)] and again == first * 2
