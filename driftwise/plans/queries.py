"""The registered queries: each takes ``(spark, sf_dir)`` and returns a
DataFrame over the driver's tables, and each has a DuckDB twin in
:data:`ORACLE_SQL`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.functions.scalar import millis_to_timestamp, parse_timestamp, to_bigint
from driftwise.operators.align import ColumnGroups, pair_by_condition, project_side, split_groups
from driftwise.operators.align import align_positional as align
from driftwise.operators.align import prepare_pair
from driftwise.operators.classify import define, definition_table
from driftwise.operators.compare import compare_frames, compare_groups, compare_split
from driftwise.operators.drift import category_counts, numeric_bins
from driftwise.operators.links import CAP, LIST_LINKS, RUN_LINKS, bounded_ids, first_cell, id_pages, view_links
from driftwise.operators.roundtrip import column_differences, compare_tables, roundtrip_check, row_differences
from driftwise.plans import oracle
from driftwise.session import scratch_path
from driftwise.sources.files import csv_to_parquet, read_exact_csv, write_csv
from driftwise.sources.report import write_report
from driftwise.sources.split_document import read_split_document
from driftwise.sources.split_json import read_split_json, write_split_json
from driftwise.sources.tracking import experiments, merge_runs
from driftwise.spec import DatasetSpec
from driftwise.streaming.monitor import drift_stream, read_stream_results


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


# ---------------------------------------------------------------- drift: orders
ORDERS_SPEC = DatasetSpec(features=("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"),
                          id="o_orderkey", datetimes=("o_orderdate",))
ORDERS_SPLIT = "1998-01-01 00:00:00"
ORDERS_SRC = ("SELECT CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1 "
              "WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 0 END AS side, * FROM orders "
              "WHERE o_orderdate IS NOT NULL")


def _orders_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return compare_split(orders, ORDERS_SPEC, F.col("o_orderdate") >= _ntz(ORDERS_SPLIT))


def drift_columns_orders(spark, sf_dir):
    return _orders_report(spark, sf_dir).columns


def drift_summary_orders(spark, sf_dir):
    return _orders_report(spark, sf_dir).summary


# orders with nulls, NaN, infinities, a constant column and a column that one side lacks
EDGES_SPEC = DatasetSpec(features=("odd", "same", "one_side", "shifted", "status"))
EDGES_SRC = """SELECT side, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE)
  WHEN o_orderkey % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 19 = 0 THEN CAST('-Infinity' AS DOUBLE)
  ELSE CAST(o_totalprice AS DOUBLE) END AS odd, CAST(1 AS DOUBLE) AS same,
  CASE WHEN side = 0 THEN CAST(o_totalprice AS DOUBLE) END AS one_side,
  CAST(o_totalprice AS DOUBLE) * (1 + side) AS shifted, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status
FROM (""" + ORDERS_SRC + ") o"


def _edges_report(spark, sf_dir):
    price, key = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    later = F.col("o_orderdate") >= _ntz(ORDERS_SPLIT)
    odd = (F.when(key % 11 == 0, None).when(key % 13 == 0, float("nan")).when(key % 17 == 0, float("inf"))
           .when(key % 19 == 0, float("-inf")).otherwise(price))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderdate", odd.alias("odd"), F.lit(1.0).alias("same"), F.when(~later, price).alias("one_side"),
        (price * F.when(later, 2).otherwise(1)).alias("shifted"), F.when(key % 7 != 0, F.col("o_orderstatus")).alias("status"))
    return compare_split(rows, EDGES_SPEC, later)


def drift_columns_edges(spark, sf_dir):
    return _edges_report(spark, sf_dir).columns


def drift_tests_edges(spark, sf_dir):
    return _edges_report(spark, sf_dir).tests


def drift_tests_orders(spark, sf_dir):
    return _orders_report(spark, sf_dir).tests


def _orders_paired(spark, sf_dir, features):
    orders = table(spark, sf_dir, "orders")
    spec = DatasetSpec(features=features, id="o_orderkey", datetimes=("o_orderdate",))
    _, definition = define(project_side(orders, spec), spec.id, spec.datetimes)
    return pair_by_condition(orders, F.col("o_orderdate") >= _ntz(ORDERS_SPLIT), definition), definition


def drift_numeric_bins(spark, sf_dir):
    paired, definition = _orders_paired(spark, sf_dir, ("o_totalprice",))
    return numeric_bins(paired, definition)


def drift_category_counts(spark, sf_dir):
    paired, definition = _orders_paired(spark, sf_dir, ("o_orderpriority",))
    return category_counts(paired, definition)


# ------------------------------------------------------------- drift: lineitem
LINEITEM_SPEC = DatasetSpec(features=("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                      "l_returnflag", "l_linestatus"),
                            datetimes=("l_shipdate",))
LINEITEM_SRC = ("SELECT CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 1 "
                "WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 END AS side, * FROM lineitem "
                "WHERE l_shipdate IS NOT NULL")


def drift_columns_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return compare_split(li, LINEITEM_SPEC, F.col("l_shipdate") >= _ntz("1998-01-01 00:00:00")).columns


LINEITEM_ALL_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax")
LINEITEM_ALL_CAT = ("l_returnflag", "l_linestatus")


def drift_columns_lineitem_all(spark, sf_dir):
    """Every lineitem column but the split date scored at once."""
    li = table(spark, sf_dir, "lineitem")
    spec = DatasetSpec(features=LINEITEM_ALL_NUM + LINEITEM_ALL_CAT, datetimes=("l_shipdate",))
    return compare_split(li, spec, F.col("l_shipdate") >= _ntz("1998-01-01 00:00:00")).columns


# --------------------------------------------------------------- drift: events
EVENTS_SPEC = DatasetSpec(features=("user_id", "event_type", "value"), id="event_id", datetimes=("ts",))
EVENTS_SRC = ("SELECT CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 "
              "WHEN ts < TIMESTAMP '2024-01-16' THEN 0 END AS side, * FROM events WHERE ts IS NOT NULL")


def drift_columns_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return compare_split(ev, EVENTS_SPEC, F.col("ts") >= _ntz("2024-01-16 00:00:00")).columns


# -------------------------------------------------- drift: two frames, shifted
SHIFT_SPEC = DatasetSpec(features=("o_totalprice", "o_orderpriority"), id="o_orderkey")
SHIFT_SRC = ("SELECT 0 AS side, o_totalprice, o_orderpriority FROM orders UNION ALL "
             "SELECT 1, o_totalprice * 1.5, o_orderpriority FROM orders")


def drift_shifted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shifted = orders.withColumn("o_totalprice", F.col("o_totalprice") * 1.5)
    return compare_frames(orders, shifted, SHIFT_SPEC, SHIFT_SPEC).columns


# ----------------------------------------- drift: column groups of one table
LINEITEM_GROUPS = ColumnGroups(
    new_features=("l_quantity", "l_linestatus"),
    ref_features=("l_extendedprice", "l_returnflag"),
    labels={"l_quantity": "amount", "l_linestatus": "status",
            "l_extendedprice": "price", "l_returnflag": "flag"},
)
GROUPS_SRC = ("SELECT 0 AS side, l_extendedprice AS amount, l_returnflag AS status FROM lineitem "
              "UNION ALL SELECT 1, l_quantity, l_linestatus FROM lineitem")


def drift_column_groups(spark, sf_dir):
    return compare_groups(table(spark, sf_dir, "lineitem"), LINEITEM_GROUPS).columns


def align_positional(spark, sf_dir):
    ref, cur, ref_spec, cur_spec = split_groups(table(spark, sf_dir, "lineitem"), LINEITEM_GROUPS)
    return align(ref, cur, ref_spec, cur_spec).ref


# a reference with a feature more and a datetime less, both sides with an id that is not in front
LOOSE_REF = DatasetSpec(features=("o_custkey", "o_orderpriority", "o_totalprice"), id="o_orderkey")
LOOSE_CUR = DatasetSpec(features=("half", "status"), id="key", datetimes=("day",))
LOOSE_SRC = ("SELECT 0 AS side, o_custkey AS half, o_orderpriority AS status FROM orders UNION ALL "
             "SELECT 1, o_custkey / 2, o_orderstatus FROM orders")


def _loose_sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cur = orders.select((F.col("o_custkey") / 2).alias("half"), F.col("o_orderstatus").alias("status"),
                        F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"))
    return orders, cur


def drift_unpaired(spark, sf_dir):
    """Sides of different shape: what has a partner is scored, the rest is listed."""
    return compare_frames(*_loose_sides(spark, sf_dir), LOOSE_REF, LOOSE_CUR, strict=False).columns


def aligned_sides(spark, sf_dir):
    """Both sides as they are compared, column by column: the id moved to the front under the current
    names, a declared datetime that the table lacks left out of the definition."""
    orders, cur = _loose_sides(spark, sf_dir)
    _, _, al = prepare_pair(project_side(orders, LOOSE_REF), project_side(cur, LOOSE_CUR), LOOSE_REF, LOOSE_CUR, strict=False)
    parts = []
    for side, frame in (("reference", al.ref), ("current", al.cur)):
        _, definition = define(frame, al.spec.id, ("gone", *al.spec.datetimes))
        place = F.array_position(F.array(*[F.lit(c) for c in frame.columns]), F.col("column_name")).cast("int")
        parts.append(definition_table(frame, definition).select(F.lit(side).alias("side"), place.alias("position"), "column_name", "kind", "non_null"))
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------- definitions
def classify_columns(spark, sf_dir):
    coerced, definition = define(table(spark, sf_dir, "orders"), "o_orderkey", ("o_orderdate",))
    return definition_table(coerced, definition)


def coerce_datetime(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    swapped = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    text = F.when(swapped, F.date_format("o_orderdate", "yyyy-dd-MM")) \
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return (orders.select("o_orderkey", text.alias("date_text"))
                  .select("o_orderkey", "date_text",
                          parse_timestamp("date_text").alias("parsed"),
                          parse_timestamp("date_text", "yyyy-dd-MM").alias("parsed_dm")))


def millis_to_ts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ms = (F.col("o_orderkey") * 1000).alias("ms")
    return orders.select(to_bigint(F.col("o_orderkey").cast("string")).alias("o_orderkey"), ms,
                         millis_to_timestamp(F.col("o_orderkey") * 1000).alias("ts"))


# --------------------------------------------------------------- view links
SELECTION_SQL = ("SELECT CAST(year(o_orderdate) * 100 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 10 "
                 "+ instr('FOP', o_orderstatus) AS BIGINT) AS run_id, o_orderkey AS building_id FROM orders")


def selection(spark, sf_dir) -> DataFrame:
    """Runs from orders: one run per (year, priority, status), its orders as ids."""
    o = table(spark, sf_dir, "orders")
    run = (F.year("o_orderdate") * 100 + F.substring("o_orderpriority", 1, 1).cast("int") * 10
           + F.expr("instr('FOP', o_orderstatus)"))
    return o.select(run.cast("bigint").alias("run_id"), F.col("o_orderkey").alias("building_id"))


SELECTION_NULLS_SQL = (f"SELECT run_id, CASE WHEN run_id % 7 = 0 OR building_id % 5 = 0 THEN NULL ELSE building_id END "
                       f"AS building_id FROM ({SELECTION_SQL}) s")


def selection_with_nulls(spark, sf_dir) -> DataFrame:
    """The selection with null ids, and with runs that have none."""
    gone = (F.col("run_id") % 7 == 0) | (F.col("building_id") % 5 == 0)
    return selection(spark, sf_dir).withColumn("building_id", F.when(~gone, F.col("building_id")))


def first_run_cell(spark, sf_dir):
    """The selection's first cell: the run id of the lowest id (one row)."""
    return first_cell(selection(spark, sf_dir), "building_id", "run_id")


def bounded_id_list(spark, sf_dir):
    return bounded_ids(selection(spark, sf_dir), "run_id", "building_id", CAP)


def id_list_pages(spark, sf_dir):
    """Every id of every run, 130 to a page; some ids null, some runs with none."""
    return id_pages(selection_with_nulls(spark, sf_dir), "run_id", "building_id", CAP)


LARGE_CAP = 5000
STATUS_SQL = "SELECT CAST(instr('FOP', o_orderstatus) AS BIGINT) AS run_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS building_id FROM orders"


def bounded_id_list_large(spark, sf_dir):
    """Three runs of many ids, cut at a number beyond the session's group limit."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.expr("instr('FOP', o_orderstatus)").cast("bigint").alias("run_id"),
                    F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("building_id"))
    return bounded_ids(rows, "run_id", "building_id", LARGE_CAP)


def bounded_id_list_nulls(spark, sf_dir):
    return bounded_ids(selection_with_nulls(spark, sf_dir), "run_id", "building_id", CAP)


def view_links_no_ids(spark, sf_dir):
    """No id column selected: every list is the default."""
    return view_links(selection(spark, sf_dir), list(LIST_LINKS), "run_id", cap=CAP)


def view_links_list(spark, sf_dir):
    return view_links(selection(spark, sf_dir), list(LIST_LINKS), "run_id", "building_id", cap=CAP)


def view_links_run(spark, sf_dir):
    # run-only links carry no id list: keep the meaningful columns
    return view_links(selection(spark, sf_dir), list(RUN_LINKS), "run_id", cap=CAP).select("run_id", "link", "url")


# ------------------------------------------------------ conversion, scans
def _roundtrip_sql(name: str) -> str:
    """What a lossless copy must give, whatever the table: a constant (the queries with
    planted differences are the ones whose SQL can differ)."""
    copy = f"SELECT * FROM {name}"
    return f"""WITH d AS (
  SELECT (SELECT count(*) FROM ({copy} EXCEPT ALL {copy}) l) + (SELECT count(*) FROM ({copy} EXCEPT ALL {copy}) r) AS n)
SELECT k AS "check", CASE WHEN k <> 'contents' OR n = 0 THEN 'identical' ELSE 'different' END AS result,
       CASE WHEN k = 'contents' THEN n ELSE 0 END AS differences
FROM d, (VALUES ('columns'), ('types'), ('contents')) t(k)"""


PLANTED_CHANGED = "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END"
PLANTED_SQL = f"""WITH b AS (SELECT * REPLACE ({PLANTED_CHANGED} AS o_orderpriority) FROM orders WHERE o_orderkey % 101 <> 0),
d AS (SELECT (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM b) l)
           + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM orders) r) AS n)
SELECT k AS "check", CASE WHEN k <> 'contents' OR n = 0 THEN 'identical' ELSE 'different' END AS result,
       CASE WHEN k = 'contents' THEN n ELSE 0 END AS differences
FROM d, (VALUES ('columns'), ('types'), ('contents')) t(k)"""


def compare_planted(spark, sf_dir):
    """Orders against a copy with cells set to null and rows left out."""
    orders = table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderpriority"))
    return compare_tables(spark, orders, orders.where("o_orderkey % 101 <> 0").withColumn("o_orderpriority", changed))


def differing_rows(spark, sf_dir):
    """The rows themselves of that comparison, each with how often one side has it more."""
    orders = table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderpriority"))
    return row_differences(orders, orders.where("o_orderkey % 101 <> 0").withColumn("o_orderpriority", changed))


DIFFERING_SQL = f"""WITH b AS (SELECT * REPLACE ({PLANTED_CHANGED} AS o_orderpriority) FROM orders WHERE o_orderkey % 101 <> 0)
SELECT count(*) AS only_left, CAST(0 AS BIGINT) AS only_right, l.* FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM b) l GROUP BY ALL
UNION ALL
SELECT CAST(0 AS BIGINT), count(*), r.* FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM orders) r GROUP BY ALL"""


def differing_columns(spark, sf_dir):
    """Orders against a copy with a column renamed, one retyped, one with other values and one more."""
    orders = table(spark, sf_dir, "orders")
    other = (orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))
             .withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderpriority")))
             .withColumnRenamed("o_totalprice", "price").withColumn("extra", F.lit(1)))
    return column_differences(orders, other)


def _differing_columns_sql() -> str:
    """Names and types as DuckDB describes both tables; values by EXCEPT ALL, column by column."""
    other = (f"SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey, {PLANTED_CHANGED} AS o_orderpriority) "
             "RENAME (o_totalprice AS price), 1 AS extra FROM orders")
    pairs = [(c, "price" if c == "o_totalprice" else c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")]
    counts = " UNION ALL ".join(
        f"SELECT '{x}' AS c, (SELECT count(*) FROM (SELECT {x} FROM orders EXCEPT ALL SELECT {y} FROM o) l) AS only_left, "
        f"(SELECT count(*) FROM (SELECT {y} FROM o EXCEPT ALL SELECT {x} FROM orders) r) AS only_right" for x, y in pairs)
    described = "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name, column_type FROM (DESCRIBE {})"
    return f"""WITH o AS ({other}), a AS ({described.format("SELECT * FROM orders")}), b AS ({described.format(other)}), n AS ({counts})
SELECT position, a.column_name AS left_column, b.column_name AS right_column,
       coalesce(a.column_name = b.column_name, false) AS same_name, coalesce(a.column_type = b.column_type, false) AS same_type, only_left, only_right
FROM a FULL JOIN b USING (position) LEFT JOIN n ON n.c = a.column_name"""


# Text that a CSV is apt to lose: breaks, quotes, the null marker, blanks, nothing.  One text for both engines.
AWKWARD = """CASE doc_id % 6 WHEN 0 THEN replace(text, ' ', chr(13) || chr(10)) WHEN 1 THEN replace(text, 'e', chr(92) || 'N","' || chr(92))
WHEN 2 THEN chr(92) || 'N' WHEN 3 THEN '  ' || text || chr(9) WHEN 4 THEN '' END"""


def csv_text_scan(spark, sf_dir):
    """Documents with awkward text through a CSV that splits, row by row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(AWKWARD).alias("text"))
    path = scratch_path(spark, "csv-text")
    write_csv(docs, path)
    back = read_exact_csv(spark, path, docs.schema)
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def roundtrip_parquet(spark, sf_dir):
    return roundtrip_check(spark, table(spark, sf_dir, "customer"), scratch_path(spark, "roundtrip-parquet"))


def roundtrip_csv(spark, sf_dir):
    return roundtrip_check(spark, table(spark, sf_dir, "supplier"), scratch_path(spark, "roundtrip-csv"),
                           fmt="csv", options={"header": "true"})


def convert_csv_parquet(spark, sf_dir):
    """The conversion script: orders to CSV, CSV to Parquet, then names,
    types and contents of the Parquet table against the original."""
    orders = table(spark, sf_dir, "orders")
    csv_path = scratch_path(spark, "convert-csv")
    write_csv(orders, csv_path)
    parquet = csv_to_parquet(spark, csv_path, scratch_path(spark, "convert-parquet"), orders.schema, exact=True)
    return compare_tables(spark, orders, parquet)


def report_roundtrip(spark, sf_dir):
    """The orders report written as tables and read back (its tests table)."""
    stored = write_report(spark, _orders_report(spark, sf_dir), scratch_path(spark, "report"))
    return stored.tests


def split_json_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "split-json")
    write_split_json(orders, path, rows_per_doc=500)
    return read_split_json(spark, path, orders.schema, index_col=None)


def split_document_scan(spark, sf_dir):
    """Documents as whole-file split documents, one a partition, read back by byte ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    path = scratch_path(spark, "split-documents")
    write_split_json(docs, path, rows_per_doc=2 ** 31)
    back = read_split_document(spark, path, docs.schema, index_col=None, range_bytes=1 << 20)
    return back.select("doc_id", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def drift_stream_events(spark, sf_dir):
    """Events from 2024-01-16 on arrive as a stream (the events file is the
    source); each micro-batch is scored against the earlier events."""
    events = table(spark, sf_dir, "events")
    split = _ntz("2024-01-16 00:00:00")
    # a pattern matches the table as one file and as a folder of part files alike
    stream = (spark.readStream.schema(events.schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
              .where(F.col("ts") >= split))
    out = scratch_path(spark, "drift-stream-out")
    q = drift_stream(spark, stream, events.where(F.col("ts") < split), EVENTS_SPEC, out)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_stream_results(spark, out).select(
        "epoch", "column_name", "kind", "bins", "ref_count", "cur_count", "psi", "threshold", "drifted")


def _experiment_export(spark, sf_dir) -> DataFrame:
    """Raw experiment records derived from customer (an export's shape)."""
    c = table(spark, sf_dir, "customer")
    created = F.lit(1_700_000_000_000) + F.col("c_custkey") * 60_000
    return c.select(
        F.col("c_custkey").cast("string").alias("experiment_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active").alias("lifecycle_stage"),
        F.concat(F.lit("artifacts/"), F.col("c_custkey").cast("string")).alias("artifact_location"),
        created.alias("creation_time"),
        (created + F.col("c_nationkey") * 3_600_000).alias("last_update_time"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"),
                           F.col("c_nationkey").cast("string").alias("nation"))).alias("tags"))


def experiments_table(spark, sf_dir):
    e = experiments(_experiment_export(spark, sf_dir))
    return e.select("experiment_id", "name", "lifecycle_stage", "artifact_location",
                    "creation_time", "last_update_time",
                    F.col("tags")["segment"].alias("tag_segment"),
                    F.col("tags")["nation"].alias("tag_nation"),
                    F.size("tags").alias("n_tags"))


def _run_exports(spark, sf_dir) -> list[DataFrame]:
    """Three run exports with different columns, derived from customer, supplier and orders."""
    c, s, o = (table(spark, sf_dir, n) for n in ("customer", "supplier", "orders"))
    start = F.lit(1_700_000_000_000)
    return [
        c.select(F.concat(F.lit("c"), "c_custkey").alias("run_id"), F.col("c_nationkey").cast("string").alias("experiment_id"),
                 F.lit("FINISHED").alias("status"), (start + F.col("c_custkey") * 1000).alias("start_time"),
                 F.col("c_mktsegment").alias("params.segment"), F.col("c_acctbal").alias("metrics.balance"),
                 F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("tags.owner")),
        s.select(F.concat(F.lit("s"), "s_suppkey").alias("run_id"), F.col("s_nationkey").cast("bigint").alias("experiment_id"),
                 F.col("s_acctbal").cast("string").alias("metrics.balance"), F.lit(1).alias("metrics.rank"),
                 F.lit("x").alias("stage")),
        o.select(F.concat(F.lit("o"), "o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"),
                 F.col("o_orderdate").alias("end_time"), F.col("o_custkey").alias("params.customer"),
                 F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("metrics.price"), F.col("o_orderpriority").alias("tags.priority"))]


def runs_table(spark, sf_dir):
    """Runs of three exports as one typed table, its maps listed as text."""
    def listed(name):
        pairs = F.transform(F.array_sort(F.map_keys(name)), lambda k: F.concat(k, F.lit("="), F.col(name)[k].cast("string")))
        return F.array_join(pairs, ";").alias(name)

    every = merge_runs(_run_exports(spark, sf_dir))
    return every.select("run_id", "experiment_id", "status", "start_time", "end_time", listed("params"), listed("tags"), listed("others"),
                        F.col("metrics")["balance"].alias("balance"), F.col("metrics")["price"].alias("price"), F.size("metrics").alias("n_metrics"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "drift_columns_orders": drift_columns_orders,
    "drift_summary_orders": drift_summary_orders,
    "drift_tests_orders": drift_tests_orders,
    "drift_columns_lineitem": drift_columns_lineitem,
    "drift_columns_lineitem_all": drift_columns_lineitem_all,
    "drift_columns_events": drift_columns_events,
    "drift_numeric_bins": drift_numeric_bins,
    "drift_category_counts": drift_category_counts,
    "drift_shifted": drift_shifted,
    "drift_column_groups": drift_column_groups,
    "align_positional": align_positional,
    "classify_columns": classify_columns,
    "coerce_datetime": coerce_datetime,
    "millis_to_timestamp": millis_to_ts,
    "first_run_cell": first_run_cell,
    "bounded_id_list": bounded_id_list,
    "bounded_id_list_nulls": bounded_id_list_nulls,
    "id_list_pages": id_list_pages,
    "view_links_no_ids": view_links_no_ids,
    "view_links_list": view_links_list,
    "view_links_run": view_links_run,
    "roundtrip_parquet": roundtrip_parquet,
    "roundtrip_csv": roundtrip_csv,
    "split_json_scan": split_json_scan,
    "convert_csv_parquet": convert_csv_parquet,
    "report_roundtrip": report_roundtrip,
    "experiments_table": experiments_table,
    "compare_planted": compare_planted,
    "drift_tests_edges": drift_tests_edges,
    "drift_columns_edges": drift_columns_edges,
    "drift_stream_events": drift_stream_events,
    "differing_rows": differing_rows,
    "differing_columns": differing_columns,
    "csv_text_scan": csv_text_scan,
    "split_document_scan": split_document_scan,
    "runs_table": runs_table,
    "bounded_id_list_large": bounded_id_list_large,
    "drift_unpaired": drift_unpaired,
    "aligned_sides": aligned_sides,
}

_ORDERS_COLS = oracle.drift_columns_sql(ORDERS_SRC, ["o_custkey", "o_totalprice"],
                                        ["o_orderstatus", "o_orderpriority"])

_EVENTS_COLS = oracle.drift_columns_sql(EVENTS_SRC, ["user_id", "value"], ["event_type"])

_EDGES_COLS = oracle.drift_columns_sql(EDGES_SRC, ["odd", "same", "one_side", "shifted"], ["status"])

_NULL_RUN = "CAST(NULL AS VARCHAR)"

ORACLE_SQL: dict[str, str] = {
    "differing_rows": DIFFERING_SQL,
    "differing_columns": _differing_columns_sql(),
    "csv_text_scan": f"""SELECT doc_id, lang, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT *, {AWKWARD} AS t FROM documents) d""",
    "split_document_scan": "SELECT doc_id, lang, n_chars, sha256(text) AS text_sha256 FROM documents",
    "bounded_id_list_large": oracle.bounded_ids_sql(STATUS_SQL, 5000),
    "drift_unpaired": f"""{oracle.drift_columns_sql(LOOSE_SRC, ["half"], ["status"])}
UNION ALL SELECT 'o_totalprice', 'unpaired', CAST(0 AS BIGINT), count(o_totalprice), CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(NULL AS BOOLEAN) FROM orders
UNION ALL SELECT 'day', 'unpaired', CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(o_orderdate), CAST(NULL AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(NULL AS BOOLEAN) FROM orders""",
    "aligned_sides": """
WITH n AS (SELECT count(o_orderkey) AS k, count(o_custkey) AS c, count(o_orderpriority) AS p, count(o_orderstatus) AS s FROM orders)
SELECT 'reference' AS side, CAST(1 AS INTEGER) AS position, 'key' AS column_name, 'id' AS kind, k AS non_null FROM n
UNION ALL SELECT 'reference', 2, 'half', 'numerical', c FROM n UNION ALL SELECT 'reference', 3, 'status', 'categorical', p FROM n
UNION ALL SELECT 'current', 1, 'key', 'id', k FROM n UNION ALL SELECT 'current', 2, 'half', 'numerical', c FROM n
UNION ALL SELECT 'current', 3, 'status', 'categorical', s FROM n""",
    "runs_table": f"""
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS run_id, CAST(c_nationkey AS BIGINT) AS experiment_id, 'FINISHED' AS status,
       epoch_ms(1700000000000 + c_custkey * 1000) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time, 'segment=' || c_mktsegment AS params,
       CASE WHEN c_custkey % 3 = 0 THEN 'owner=' || c_name ELSE '' END AS tags, '' AS others, CAST(c_acctbal AS DOUBLE) AS balance,
       CAST(NULL AS DOUBLE) AS price, CAST(1 AS INTEGER) AS n_metrics FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS BIGINT), {_NULL_RUN}, NULL, NULL, '', '', 'stage=x', CAST(s_acctbal AS DOUBLE),
       NULL, 2 FROM supplier
UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus, NULL, CAST(o_orderdate AS TIMESTAMP), 'customer=' || CAST(o_custkey AS VARCHAR),
       'priority=' || o_orderpriority, '', NULL, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DOUBLE) END,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) FROM orders""",
    "compare_planted": PLANTED_SQL,
    "drift_columns_edges": _EDGES_COLS,
    "drift_tests_edges": oracle.drift_tests_sql(_EDGES_COLS),
    "drift_columns_orders": _ORDERS_COLS,
    "drift_summary_orders": oracle.drift_summary_sql(_ORDERS_COLS),
    "drift_tests_orders": oracle.drift_tests_sql(_ORDERS_COLS),
    "drift_columns_lineitem": oracle.drift_columns_sql(
        LINEITEM_SRC, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"]),
    "drift_columns_lineitem_all": oracle.drift_columns_sql(LINEITEM_SRC, list(LINEITEM_ALL_NUM),
                                                           list(LINEITEM_ALL_CAT)),
    "drift_columns_events": _EVENTS_COLS,
    "drift_stream_events": f"SELECT CAST(0 AS BIGINT) AS epoch, * FROM ({_EVENTS_COLS}) r",
    "drift_numeric_bins": oracle.numeric_bins_sql(ORDERS_SRC, "o_totalprice"),
    "drift_category_counts": oracle.category_counts_sql(ORDERS_SRC, "o_orderpriority"),
    "drift_shifted": oracle.drift_columns_sql(SHIFT_SRC, ["o_totalprice"], ["o_orderpriority"]),
    "drift_column_groups": oracle.drift_columns_sql(GROUPS_SRC, ["amount"], ["status"]),
    "align_positional": "SELECT l_extendedprice AS amount, l_returnflag AS status FROM lineitem",
    "classify_columns": """
SELECT 'o_orderkey' AS column_name, 'id' AS kind, count(o_orderkey) AS non_null FROM orders UNION ALL
SELECT 'o_custkey', 'numerical', count(o_custkey) FROM orders UNION ALL
SELECT 'o_totalprice', 'numerical', count(o_totalprice) FROM orders UNION ALL
SELECT 'o_orderstatus', 'categorical', count(o_orderstatus) FROM orders UNION ALL
SELECT 'o_orderpriority', 'categorical', count(o_orderpriority) FROM orders UNION ALL
SELECT 'o_orderdate', 'datetime', count(o_orderdate) FROM orders""",
    "coerce_datetime": """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                  THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
           FROM orders)
SELECT o_orderkey, date_text, try_strptime(date_text, '%Y-%m-%d') AS parsed,
       try_strptime(date_text, '%Y-%d-%m') AS parsed_dm FROM t""",
    "millis_to_timestamp": "SELECT o_orderkey, o_orderkey * 1000 AS ms, epoch_ms(o_orderkey * 1000) AS ts FROM orders",
    "first_run_cell": f"SELECT run_id FROM ({SELECTION_SQL}) s ORDER BY building_id NULLS LAST LIMIT 1",
    "bounded_id_list": oracle.bounded_ids_sql(SELECTION_SQL),
    "bounded_id_list_nulls": oracle.bounded_ids_sql(SELECTION_NULLS_SQL),
    "id_list_pages": oracle.id_pages_sql(SELECTION_NULLS_SQL),
    "view_links_no_ids": oracle.view_links_no_ids_sql(SELECTION_SQL),
    "view_links_list": oracle.view_links_list_sql(SELECTION_SQL),
    "view_links_run": oracle.view_links_run_sql(SELECTION_SQL),
    "roundtrip_parquet": _roundtrip_sql("customer"),
    "roundtrip_csv": _roundtrip_sql("supplier"),
    "split_json_scan": "SELECT * FROM orders",
    "convert_csv_parquet": _roundtrip_sql("orders"),
    "report_roundtrip": oracle.drift_tests_sql(_ORDERS_COLS),
    "experiments_table": """
SELECT CAST(c_custkey AS BIGINT) AS experiment_id, c_name AS name, 'active' AS lifecycle_stage,
       'artifacts/' || CAST(c_custkey AS VARCHAR) AS artifact_location,
       epoch_ms(1700000000000 + c_custkey * 60000) AS creation_time,
       epoch_ms(1700000000000 + c_custkey * 60000 + c_nationkey * 3600000) AS last_update_time,
       c_mktsegment AS tag_segment, CAST(c_nationkey AS VARCHAR) AS tag_nation, CAST(2 AS INTEGER) AS n_tags
FROM customer WHERE c_acctbal >= 0""",
}
