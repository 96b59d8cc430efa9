"""Experiment-tracking listings as tables.

The records come from an export of the tracking server (any format Spark
reads); no live client is involved.  Experiments are projected to typed
columns.  A runs export has one column per parameter, metric and tag that any of its
runs ever set (``params.depth``, ``metrics.auc``, ``tags.owner``), so no two exports
have the same columns: each is folded into maps where it is scanned, and the folded
tables, which all have the same columns, are put together by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.scalar import coerce_datetime, millis_to_timestamp, to_bigint
from driftwise.functions.sqltext import col

ACTIVE = "active"
RAW_EXPERIMENT_COLUMNS = ("experiment_id", "name", "lifecycle_stage", "artifact_location",
                          "creation_time", "last_update_time", "tags")


def experiments(raw: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Typed experiment table:
    ``experiment_id bigint, name, lifecycle_stage, artifact_location,
    creation_time timestamp_ntz, last_update_time timestamp_ntz,
    tags map<string,string>``.

    ``raw`` holds the exported fields; times are epoch milliseconds and
    ``tags`` is a JSON object (text) or already a map.  Only active
    experiments are listed unless ``include_deleted``.
    """
    missing = [c for c in RAW_EXPERIMENT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"experiment export lacks columns: {missing}")
    tags_type = dict(raw.dtypes)["tags"]
    tags = (F.col("tags") if tags_type.startswith("map")
            else F.from_json(F.col("tags"), "map<string,string>"))
    out = raw
    if not include_deleted:
        out = out.where(F.col("lifecycle_stage") == F.lit(ACTIVE))
    return out.select(
        to_bigint("experiment_id").alias("experiment_id"),
        F.col("name").cast("string").alias("name"),
        F.col("lifecycle_stage").cast("string").alias("lifecycle_stage"),
        F.col("artifact_location").cast("string").alias("artifact_location"),
        millis_to_timestamp("creation_time").alias("creation_time"),
        millis_to_timestamp("last_update_time").alias("last_update_time"),
        tags.alias("tags"))


def read_export(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan an exported experiments or runs table."""
    return spark.read.format(fmt).options(**options).load(path)


# Fixed names: the columns of a runs export, and its column families with the type of their values.
RUN_TEXTS = ("run_id", "status", "artifact_uri")
RUN_TIMES = ("start_time", "end_time")
FAMILIES = {"params": "string", "metrics": "double", "tags": "string"}


def _members(df: DataFrame, family: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(f"{family}.") and len(c) > len(family) + 1)


def _family_map(df: DataFrame, family: str, kind: str) -> Column:
    """The columns ``family.*`` as one map; a null cell is a key that the run never set."""
    pairs = [F.struct(F.lit(c[len(family) + 1:]).alias("key"), col(c).try_cast(kind).alias("value")) for c in _members(df, family)]
    if not pairs:
        return F.create_map().cast(f"map<string,{kind}>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def _lost(df: DataFrame, family: str, kind: str) -> list[Column]:
    """Cells of a family that do not convert to its type."""
    return [col(c).isNotNull() & col(c).try_cast(kind).isNull() for c in _members(df, family)]


def fold_run_columns(df: DataFrame, strict: bool = True) -> DataFrame:
    """One export as ``run_id, experiment_id, status, artifact_uri, start_time, end_time,
    params, metrics, tags`` (maps) and ``others`` (map: any further column as text).

    Times may be timestamps, text or epoch milliseconds; a column that the export
    lacks is null; NaN is a metric's value, null is none.  A metric that is no number
    raises (``strict=False``: the run has no such metric).
    """
    if "run_id" not in df.columns:
        raise ValueError("run export lacks the column run_id")
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = [(col(c).cast("string") if c in fields else F.lit(None).cast("string")).alias(c) for c in RUN_TEXTS]
    out.insert(1, (to_bigint(col("experiment_id").cast("string")) if "experiment_id" in fields else F.lit(None).cast("bigint")).alias("experiment_id"))
    out += [(_reading(c, fields[c]) if c in fields else F.lit(None).cast("timestamp_ntz")).alias(c) for c in RUN_TIMES]
    for family, kind in FAMILIES.items():
        folded, lost = _family_map(df, family, kind), _lost(df, family, kind)
        if strict and kind != "string" and lost:
            said = F.concat(F.lit(f"a value of {family}.* is no {kind} in run "), F.coalesce(col("run_id").cast("string"), F.lit("null")))
            folded = F.when(reduce(lambda x, y: x | y, lost), F.raise_error(said).cast(f"map<string,{kind}>")).otherwise(folded)
        out.append(folded.alias(family))
    known = {*RUN_TEXTS, *RUN_TIMES, "experiment_id", *(c for f in FAMILIES for c in _members(df, f))}
    nested = (T.MapType, T.ArrayType, T.StructType)
    rest = [F.struct(F.lit(c).alias("key"), (F.to_json(col(c)) if isinstance(t, nested) else col(c).cast("string")).alias("value"))
            for c, t in fields.items() if c not in known]
    others = F.map_from_entries(F.filter(F.array(*rest), lambda p: p["value"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    return df.select(*out, others.alias("others"))


def _reading(name: str, dtype: T.DataType) -> Column:
    """A time column as its UTC reading, whatever the export made of it."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(col(name)), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return coerce_datetime(name, dtype)


def merge_runs(exports: list[DataFrame], strict: bool = True) -> DataFrame:
    """All runs of all experiments, from exports of any columns (see
    :func:`fold_run_columns`).  One scan an export, no shuffle; rows are not
    deduplicated (see :func:`latest_runs`)."""
    if not exports:
        raise ValueError("no export")
    folded = [fold_run_columns(e, strict) for e in exports]
    return reduce(lambda x, y: x.unionByName(y), folded)


def latest_runs(all_runs: DataFrame) -> DataFrame:
    """One row a run: of a run that several exports hold, the row that ended last
    (one that has not ended counts as the oldest; ties: the latest start, then any)."""
    order = F.struct(F.col("end_time").isNotNull(), F.col("end_time"), F.col("start_time"))
    rest = [c for c in all_runs.columns if c != "run_id"]
    picked = all_runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select("run_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def runs(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", strict: bool = True, **options) -> DataFrame:
    """All runs of the exported tables at ``paths`` as one typed table (:func:`merge_runs`);
    each path keeps its own schema."""
    paths = [paths] if isinstance(paths, str) else paths
    return merge_runs([read_export(spark, p, fmt, **options) for p in paths], strict)


def has_rows(df: DataFrame) -> bool:
    """Emptiness test without counting the table."""
    return not df.isEmpty()
