"""Drift per micro-batch of a stream against a fixed reference table.

The reference service answers one comparison per request.  On Spark that
loop is a Structured Streaming query: every micro-batch of current rows is
compared with the reference table by the same batch plan
(:func:`driftwise.operators.compare.compare_frames`) inside ``foreachBatch``.
Each epoch's per-column result is written to ``<output>/epoch=<n>`` with
overwrite, so a batch replayed after a failure replaces its own output
instead of duplicating it (exactly-once at the sink).  Progress lives in
``<output>/_checkpoint`` unless another folder is given, so a query started again
for the same output goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwise.functions.sqltext import col
from driftwise.operators.compare import compare_frames
from driftwise.operators.drift import COLUMN_THRESHOLD
from driftwise.spec import DatasetSpec

RESULTS = ("column_name string, kind string, bins bigint, ref_count bigint, cur_count bigint, "
           "psi double, threshold double, drifted boolean, epoch bigint")


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end at ``path``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def drift_stream(spark: SparkSession, current: DataFrame, reference: DataFrame,
                 spec: DatasetSpec, output_path: str, checkpoint_path: str | None = None,
                 ref_spec: DatasetSpec | None = None, threshold: float = COLUMN_THRESHOLD,
                 available_now: bool = True, processing_time: str | None = None,
                 materialize_reference: bool = True) -> StreamingQuery:
    """Start the monitoring query and return it.

    ``current`` is a streaming DataFrame; ``reference`` a batch one.  With
    ``available_now`` the query processes what is there and stops; otherwise
    it runs with ``processing_time`` triggers until stopped.

    Pooled bins depend on each batch, so every batch reads the reference's
    values again.  With ``materialize_reference`` they are read from a
    narrow Parquet copy beside the checkpoint, written when the query first
    starts, instead of re-evaluating the reference DataFrame from its source.
    """
    if not current.isStreaming:
        raise ValueError("current must be a streaming DataFrame")
    ref_spec = ref_spec or spec
    checkpoint = checkpoint_path or f"{output_path.rstrip('/')}/_checkpoint"
    if materialize_reference:
        # Written once, read by every batch: only the spec's columns, with the
        # source's filters and joins already applied, and no lineage back to
        # the source.  The copy lies beside the checkpoint, so a query that is
        # started again scores against the same rows even if the source changed.
        ref_path = f"{checkpoint.rstrip('/')}-reference"
        narrow = reference.select(*[col(c) for c in ref_spec.columns()])
        if not _finished(spark, ref_path):
            narrow.write.mode("overwrite").parquet(ref_path)
        reference = spark.read.schema(narrow.schema).parquet(ref_path)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        cols = compare_frames(reference, batch, ref_spec, spec, threshold=threshold, empty="null").columns
        # The epoch is the folder name (``epoch=<n>``), read back as a column.
        cols.write.mode("overwrite").parquet(f"{output_path}/epoch={epoch_id}")

    writer = (current.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_stream_results(spark: SparkSession, output_path: str) -> DataFrame:
    """All epochs written so far (``epoch`` comes from the folder names); no rows before the first."""
    out = spark.read.schema(RESULTS).parquet(output_path)
    return out.withColumn("epoch", F.col("epoch").cast("bigint"))
