"""Bounded id lists per run and the view links built from them.

A selection table holds a run id and, optionally, one id per row (e.g. a
building).  Per run we keep the ``cap`` smallest non-null ids as an ascending
comma list and a flag that says whether more non-null ids exist.  A URL is
then formatted from a fixed path template.

Plan: a ``row_number`` window filtered to ``rn <= cap + 1`` becomes
``WindowGroupLimit`` (partial before the shuffle, final after it), so at most
``cap + 1`` rows per run and task cross the network and the final collect per
run holds at most ``cap`` ids.  The ``cap + 1``-th row is the overflow signal;
no ``count(*) over (...)`` is computed (it would disable the group limit).

Hot runs: when one run holds a large share of all rows, every map task would send
``cap + 1`` rows of it to the same reducer.  The limit is therefore always applied in
two levels, one plan on every cluster: first per ``(run, salt)`` where the salt is
derived from the input partition (so each first-level group combines only a slice
of the map tasks), then per run.  The top-``cap`` of a union equals the top-``cap`` of
the parts' top-``cap``s, so the result is exact.  Ids past ``cap`` are counted
(``n_ids``, on request) and are all in :func:`id_pages`.  Caps beyond the session's group
limit take range slices instead: no window limit and no whole run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.scalar import joined_or_default, sorted_id_list
from driftwise.functions.sqltext import col
from driftwise.operators.contract import SELECTION_GROUPS, require_contract
from driftwise.session import scratch_path

CAP = 130          # list cap of the reference (ids per link)
_RN = "_rn"
_SALT = "_salt"
SALTS = 16         # first-level groups of a run
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

# The link kinds of the reference in its order, as
# (registered name, path below the base URL, shape).  Shape "list" links
# carry ``rechenlauf``, ``gebid`` and ``max``; shape "run" links only
# ``rechenlauf``.
LINKS = (
    ("2d-individuelle-gebaeudefaerbung-wms", "app/2d-db-geb-eigfaerb-wms", "list"),
    ("2d-alle-gebaeude-eingefaerbt-wms", "app/2d-db-geb-allefaerbung-wms", "run"),
    ("2d-alle-gebaeude-eingefaerbt-wms-cookie", "app/2d-db-geb-allefaerbung-wms-cookie", "run"),
    ("25d-gebaeude-basmape-individuelle-faerbung", "app/2d-basemap-geb", "list"),
    ("3d-gelaende-basamp-gebaeude-basmap", "app/3d-base-gel-base-geb", "list"),
    ("3d-gelaende-basamp-gebaeude-db", "app/3d-basemap-gel-db-geb", "list"),
    ("3d-gelaende-eigen-gebaeude-db", "app/3d-eigen-gelaende-db-geb", "list"),
    ("3d-wms-simulationsdaten", "app/3d-wms-base-gel-db-geb", "list"),
    ("3d-wms-simulationsdaten-cookie", "app/3d-wms-base-gel-db-geb-co", "list"),
    ("3d-wms-simulationsdaten-allefaerbung-cookie", "app/3d-wms-base-gel-db-geb-alleFaerbung-co", "run"),
    ("3d-wms-simulationsdaten-allefaerbung", "app/3d-wms-base-gel-db-geb-alleFaerbung", "run"),
    ("25d-individuelle-gebaeudefaerbung-ohne-wms", "app/2d-db-geb-eigfaerb", "list"),
)
LIST_LINKS = {name: path for name, path, shape in LINKS if shape == "list"}
RUN_LINKS = {name: path for name, path, shape in LINKS if shape == "run"}
RUN_PARAM, IDS_PARAM, MAX_PARAM = "rechenlauf", "gebid", "max"


def _group_limited(df: DataFrame, cap: int) -> bool:
    """Whether the group limit that keeps a hot run's rows from meeting in one task
    exists at this cap: it does up to a setting of the session."""
    if cap < 1:
        raise ValueError("cap must be at least 1")
    return cap + 1 <= int(df.sparkSession.conf.get(GROUP_LIMIT, "1000"))


def _limit(df: DataFrame, keys: list[str], id_col: str, cap: int) -> DataFrame:
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(id_col).asc_nulls_last())
    return (df.withColumn(_RN, F.row_number().over(w))
              .where(F.col(_RN) <= cap + 1))


def _listed(ranked: DataFrame, cap: int) -> DataFrame:
    """``run, _ids, max`` from a run's first ``cap + 1`` rows and their ranks."""
    listed = F.when(F.col(_RN) <= cap, F.col("id"))
    over = F.when((F.col(_RN) > cap) & F.col("id").isNotNull(), 1).otherwise(0)
    return ranked.groupBy("run").agg(F.collect_list(listed).alias("_ids"), F.max(over).alias(MAX_PARAM))


def bounded_ids(df: DataFrame, run_col: str, id_col: str, cap: int,
                salts: int = SALTS, count: bool = True) -> DataFrame:
    """Per run: ``run_col, ids, max, n_ids``.

    ``ids`` is the ascending comma list of the ``cap`` smallest non-null ids
    (duplicates kept), or ``'0'`` when the run has none; ``max`` is 1 when the
    run has more than ``cap`` non-null ids, else 0; ``n_ids`` is the number of
    its non-null ids, which costs a second pass over the ids (``count=False``: no
    such column and no such pass).

    A cap beyond ``spark.sql.optimizer.windowGroupLimitThreshold`` has no group limit;
    the ids are then cut into range slices (see :func:`id_slices`), of which a run
    needs only the first ones.
    """
    base = df.select(col(run_col).alias("run"), col(id_col).alias("id"))
    if not _group_limited(df, cap):
        return _sliced_ids(base, run_col, cap, count)
    salted = base.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(max(1, int(salts)))))
    first = _limit(salted, ["run", _SALT], "id", cap).select("run", "id")
    lists = _listed(_limit(first, ["run"], "id", cap), cap)
    if not count:
        return lists.select(F.col("run").alias(run_col), joined_or_default(sorted_id_list(F.col("_ids"))).alias("ids"),
                            F.col(MAX_PARAM).cast("int").alias(MAX_PARAM))
    lists = lists.withColumn("n_ids", F.lit(0).cast("bigint"))
    counts = (base.groupBy("run").agg(F.count("id").alias("n_ids"))
              .select("run", F.lit(None).cast(lists.schema["_ids"].dataType).alias("_ids"), F.lit(None).cast("int").alias(MAX_PARAM), "n_ids"))
    # one row a run on either side: joined by a small aggregation, null runs included
    both = lists.unionByName(counts).groupBy("run").agg(F.max("_ids").alias("_ids"), F.max(MAX_PARAM).alias(MAX_PARAM), F.max("n_ids").alias("n_ids"))
    return both.select(F.col("run").alias(run_col), joined_or_default(sorted_id_list(F.col("_ids"))).alias("ids"),
                       F.col(MAX_PARAM).cast("int").alias(MAX_PARAM), "n_ids")


def id_slices(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Range slices of ``run, id`` over all rows: the rows with their ``slice``, and
    ``_run, _slice, before``, the rows of a run in the slices before.

    A run of any size is spread over as many slices as it fills, in the order of its
    ids.  The slices are stored, so that both uses see the same ones.
    """
    spark = base.sparkSession
    dealt = base.repartitionByRange("run", "id").withColumn("slice", F.spark_partition_id())
    path = scratch_path(spark, "id-slices")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    order = Window.partitionBy("run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("run", "slice").agg(F.count("*").alias("n"))
              .select(F.col("run").alias("_run"), F.col("slice").alias("_slice"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")))
    return rows, before


def _placed(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Rows with ``r``, their number in their run from 1."""
    rank = F.row_number().over(Window.partitionBy("run", "slice").orderBy("id"))
    same = F.col("run").eqNullSafe(F.col("_run")) & (F.col("slice") == F.col("_slice"))
    return rows.join(before, same).withColumn(_RN, rank).withColumn("r", F.col("before") + F.col(_RN))


def _sliced_ids(base: DataFrame, run_col: str, cap: int, count: bool) -> DataFrame:
    """:func:`bounded_ids` for any cap.  Null ids only say that their run exists.  A slice
    that begins past a run's first ``cap + 1`` ids is dropped before its rows are ranked."""
    rows, before = id_slices(base.where(F.col("id").isNotNull()))
    lists = _listed(_placed(rows, before.where(F.col("before") <= cap)).where(F.col("r") <= cap + 1)
                    .select("run", "id", F.col("r").alias(_RN)), cap)
    none = F.lit(None).cast(lists.schema["_ids"].dataType).alias("_ids")
    sizes = base.groupBy("run").agg(F.count("id").alias("n_ids")) if count else base.select("run").distinct().withColumn("n_ids", F.lit(0).cast("bigint"))
    both = (lists.withColumn("n_ids", F.lit(0).cast("bigint"))
            .unionByName(sizes.select("run", none, F.lit(0).alias(MAX_PARAM), "n_ids"))
            .groupBy("run").agg(F.max("_ids").alias("_ids"), F.max(MAX_PARAM).alias(MAX_PARAM), F.max("n_ids").alias("n_ids")))
    return both.select(F.col("run").alias(run_col), joined_or_default(sorted_id_list(F.col("_ids"))).alias("ids"),
                       F.col(MAX_PARAM).cast("int").alias(MAX_PARAM), *(["n_ids"] if count else []))


def id_pages(df: DataFrame, run_col: str, id_col: str, cap: int) -> DataFrame:
    """All non-null ids of every run, ``cap`` to a page: ``run_col, page, ids, n_ids``.

    Page 0 is the list of :func:`bounded_ids`; no id is left out.  The ids are
    range-partitioned by (run, id), ranked inside each slice of a run and moved up by
    the ids in the slices before it, so no task holds a whole run.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    base = df.select(col(run_col).alias("run"), col(id_col).alias("id")).where(F.col("id").isNotNull())
    rows, before = id_slices(base)
    placed = _placed(rows, before).withColumn("page", F.floor((F.col("r") - 1) / cap).cast("bigint"))
    return (placed.groupBy("run", "page").agg(F.collect_list("id").alias("_ids"))
            .select(F.col("run").alias(run_col), "page", sorted_id_list(F.col("_ids")).alias("ids"), F.size("_ids").cast("bigint").alias("n_ids")))


def _url(base_url: str, path: str, run: Column, ids: Column | None = None,
         flag: Column | None = None) -> Column:
    parts = [F.lit(f"{base_url}{path}?{RUN_PARAM}="), run.cast("string")]
    if ids is not None:
        parts += [F.lit(f"&{IDS_PARAM}="), ids, F.lit(f"&{MAX_PARAM}="), flag.cast("string")]
    return F.concat(*parts)


def view_links(df: DataFrame, kinds: list[str] | tuple[str, ...], run_col: str,
               id_col: str | None = None, base_url: str = "/", *, cap: int,
               salts: int = SALTS) -> DataFrame:
    """One row per run and link kind: ``run_col, link, ids, max, url``.

    The selection must meet the reference's contract: an integer run id and
    at most one integer id column.

    List kinds need ``id_col``; without it the list is ``'0'`` and ``max`` 0
    (the reference's answer when no id column is selected).  Run-only kinds
    give ``ids``/``max`` as null.  Several kinds share one pass: the per-run
    row is expanded with ``inline`` (a generator, not a join).
    """
    unknown = [k for k in kinds if k not in LIST_LINKS and k not in RUN_LINKS]
    if unknown:
        raise ValueError(f"unknown link kinds: {unknown}")
    run_group, id_group = (g.name for g in SELECTION_GROUPS)
    require_contract(df, {run_group: [run_col], id_group: [id_col] if id_col else []},
                     SELECTION_GROUPS)
    if any(k in LIST_LINKS for k in kinds):
        if id_col is not None:
            per_run = bounded_ids(df, run_col, id_col, cap, salts, count=False)
        else:
            per_run = df.select(col(run_col)).distinct().select(
                col(run_col), F.lit("0").alias("ids"), F.lit(0).alias(MAX_PARAM))
    else:
        per_run = df.select(col(run_col)).distinct().select(
            col(run_col), F.lit(None).cast("string").alias("ids"), F.lit(None).cast("int").alias(MAX_PARAM))
    run, ids, flag = col(run_col), F.col("ids"), F.col(MAX_PARAM)
    rows = []
    for k in kinds:
        if k in LIST_LINKS:
            rows.append(F.struct(F.lit(k).alias("link"), ids.alias("ids"), flag.alias(MAX_PARAM),
                                 _url(base_url, LIST_LINKS[k], run, ids, flag).alias("url")))
        else:
            rows.append(F.struct(F.lit(k).alias("link"), F.lit(None).cast("string").alias("ids"),
                                 F.lit(None).cast("int").alias(MAX_PARAM),
                                 _url(base_url, RUN_LINKS[k], run).alias("url")))
    return per_run.select(run, F.inline(F.array(*rows)))


def first_cell(df: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """The first value of ``value_col`` by ``order_col`` (one row, or none).

    ``orderBy().limit(1)`` plans as a ``TakeOrderedAndProject``: each task
    keeps its own minimum, so no full sort happens.
    """
    return df.orderBy(col(order_col).asc_nulls_last()).select(col(value_col)).limit(1)
