"""Drift report sink and scan.

A report is three tables: ``columns``, ``summary`` and ``tests``.  The per-column
table is computed once and written; summary and tests are derived from the
written table (a handful of rows) so the input is not scanned again.

The folder of a report holds versions, ``v-<id>``, each with all three tables, and a
small file ``_current`` that names one of them.  A report is written into a new version
and becomes the current one by renaming a file over ``_current``, which the file
system does in one step.  So a reader sees the three tables of one run, the earlier
ones until the very last step, and a job that dies on the way, or runs beside another,
leaves the current report as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftwise.operators.drift import DriftReport, drift_summary, drift_tests

TABLES = ("columns", "summary", "tests")
POINTER = "_current"


@dataclass(frozen=True)
class StoredReport:
    columns: DataFrame
    summary: DataFrame
    tests: DataFrame
    version: str = ""


def _files(spark: SparkSession, path: str):
    """The Hadoop file context of ``path``, whatever store it is in."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    where = at.getFileSystem(conf).makeQualified(at)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf), where


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one: a new file is renamed over the pointer."""
    fs = spark._jvm.org.apache.hadoop.fs
    context, root = _files(spark, path)
    draft, pointer = fs.Path(root, f"{POINTER}-{version}"), fs.Path(root, POINTER)
    out = root.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft)
    try:
        out.write(version.encode())
    finally:
        out.close()
    rename = fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, pointer, options)


def current_version(spark: SparkSession, path: str) -> str:
    """Name of the version that readers see; raises where no report was ever finished."""
    fs = spark._jvm.org.apache.hadoop.fs
    context, root = _files(spark, path)
    pointer = fs.Path(root, POINTER)
    if not context.util().exists(pointer):
        raise FileNotFoundError(f"no finished report below {path}")
    stream = context.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_report(spark: SparkSession, report: DriftReport, path: str,
                 share: float | None = None, fmt: str = "parquet") -> StoredReport:
    """Write the three tables of ``report`` below ``path`` as a new version and make it
    the current one.  ``share`` defaults to the report's own dataset-drift share.
    Earlier versions stay (their readers go on); :func:`old_versions` lists them."""
    share = report.share if share is None else share
    version = f"v-{uuid.uuid4().hex}"
    at = f"{path.rstrip('/')}/{version}"
    report.columns.write.format(fmt).save(f"{at}/columns")
    cols = spark.read.format(fmt).load(f"{at}/columns")
    drift_summary(cols, share).write.format(fmt).save(f"{at}/summary")
    drift_tests(cols, share).write.format(fmt).save(f"{at}/tests")
    _publish(spark, path, version)
    return read_report(spark, path, fmt, version)


def read_report(spark: SparkSession, path: str, fmt: str = "parquet", version: str | None = None) -> StoredReport:
    """The current report below ``path`` (or the named version), all tables of one run."""
    version = version or current_version(spark, path)
    return StoredReport(*(spark.read.format(fmt).load(f"{path.rstrip('/')}/{version}/{t}") for t in TABLES), version)


def old_versions(spark: SparkSession, path: str) -> list[str]:
    """Versions below ``path`` that are not the current one: earlier reports and what
    stopped jobs left.  Nothing deletes them here; a reader may still use one."""
    now = current_version(spark, path)
    context, root = _files(spark, path)
    names = [f.getPath().getName() for f in context.util().listStatus(root)]
    return sorted(n for n in names if n.startswith("v-") and n != now)
