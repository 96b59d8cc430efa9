"""Spark session and shared-storage helpers.

The library never creates its own cluster settings beyond what a batch job
needs: adaptive execution (coalescing, skew-join splitting) and a sane
default for shuffle partitions in local runs.  On a cluster the session comes
from the caller and every setting already present is respected.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings applied only when this module builds the session (tests, bench,
# local runs).  A session handed in by the caller is used untouched.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "driftwise") -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("DRIFTWISE_MASTER", "local[*]"))
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and points at shared storage, so
    every executor can read what another one wrote.  Only when neither the
    configuration nor the context names one (a local test session) a fresh
    local folder is created and registered with the context
    (``spark.checkpoint.dir`` itself cannot be changed at runtime).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftwise-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/driftwise/{name}-{uuid.uuid4().hex}"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, unless it was shipped to them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
