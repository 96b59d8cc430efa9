"""Population Stability Index per column, the dataset verdict and the tests.

Input is a *paired* frame: a ``_side`` column (0 = reference, 1 = current)
plus the scored columns (numerical ones as double, categorical ones as
string); see :mod:`driftwise.operators.align`.

PSI over bins *i* is ``sum_i (c_i - r_i) * ln(c_i / r_i)`` with ``r_i``,
``c_i`` the shares of reference and current rows in bin *i*.

Plan shape (every step is a built-in operator, no UDF), for any number of columns.

Numerical columns, two passes over their columns:

1. every row becomes one narrow row per column, ``posexplode`` of an array: the
   column's number and its usable double.  They are aggregated by number to
   min / max and the count per side; partial aggregation leaves one row per
   column and task before the exchange.
2. the same narrow rows are joined on the number with that per-column table
   (broadcast: its size is the number of columns, fixed by the schema); values get
   an equal-width bin over the pooled range and are counted per
   ``(column number, bin)`` and side.  Partial aggregation shrinks every task's
   output to at most columns x bins rows before the shuffle.

No aggregate grows with the number of columns, so the generated code stays small
and the table is scanned twice, however wide it is.

Categorical columns, one pass: the same narrow rows with the text value, counted
per ``(column number, value)`` and side; partial aggregation folds a hot value
map-side.  The per-side totals are a per-column sum over those counts (one row per
column), broadcast back.

Finally both counts (small) are unioned and a second aggregation sums
the PSI terms per column; names and kinds come back from the column number
through literal arrays.  Nothing is collected to the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.sqltext import quote as ident
from driftwise.functions.sqltext import sql_str
from driftwise.operators.align import CUR, REF, SIDE
from driftwise.spec import DataDefinition

# Fixed parameters of the drift definition (our choice; the reference hands
# the statistics to a third-party library and shows none of them).
EMPTY_SHARE = 0.0001        # share used for a bin that is empty on one side
COLUMN_THRESHOLD = 0.1      # a column drifts when psi >= this
DATASET_SHARE = 0.5         # the dataset drifts when this share of columns drifts
ROUND_DIGITS = 8

def _sturges_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 1 ELSE length(bin({n} - 1)) + 1 END"


def sturges_bins(n: str) -> Column:
    """``ceil(log2 n) + 1`` for the count in column ``n``, exact on integers.

    For n >= 2, ceil(log2 n) is the bit length of n - 1, which ``bin`` gives
    without a floating-point logarithm (a float log2 can land a hair above an
    exact power of two and add a bin).
    """
    return F.expr(_sturges_sql(ident(n)))


def _usable_sql(name: str) -> str:
    c = f"CAST({ident(name)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < CAST('Infinity' AS DOUBLE) THEN {c} END"


def _columns(definition: DataDefinition) -> list[tuple[str, str]]:
    """(name, kind) of every scored column; the list index is the column id."""
    return ([(c, "numerical") for c in definition.numerical]
            + [(c, "categorical") for c in definition.categorical])


def _markers(paired: DataFrame, definition: DataDefinition) -> DataFrame:
    """One empty group per scored column (counts 0, constants null).

    Added after the first aggregation, so a column without any row still
    appears in the result (``psi`` null, 0 bins) while the statistics
    subtree is used once only.  Built from the column list on a
    one-partition ``range(1)``: no scan, no shuffle.
    """
    ids = ", ".join(f"named_struct('cid', {i})" for i in range(len(_columns(definition))))
    return (paired.sparkSession.range(0, 1, 1, 1)
            .selectExpr(f"inline(array({ids}))")
            .selectExpr("cid", "CAST(NULL AS INT) AS bin", "CAST(NULL AS STRING) AS value",
                        "CAST(0 AS BIGINT) AS ref_count", "CAST(0 AS BIGINT) AS cur_count",
                        "CAST(NULL AS BIGINT) AS nr", "CAST(NULL AS BIGINT) AS nc",
                        "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi",
                        "CAST(NULL AS INT) AS k"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """``UNION ALL`` of many frames with the same columns, as a balanced
    tree: each step re-analyzes only its own subtree, so building the plan
    stays O(n log n) in the number of parts instead of O(n^2)."""
    if not parts:
        raise ValueError("nothing to union")
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0]


def _long(paired: DataFrame, first: int, cells: list[str], value: str) -> DataFrame:
    """One row per row and column: side, ``cid`` (``first``, ``first + 1``, ...) and the non-null value."""
    exploded = paired.selectExpr(SIDE, f"posexplode(array({', '.join(cells)})) AS (pos, {value})")
    return exploded.where(F.col(value).isNotNull()).selectExpr(SIDE, f"pos + {first} AS cid", value)


def _stats(long: DataFrame) -> DataFrame:
    """``cid, lo, hi, nr, nc, k``: range and per-side count of a column's usable
    values, and its number of equal-width bins."""
    found = long.groupBy("cid").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    F.expr(f"count_if({SIDE} = {REF})").alias("nr"), F.expr(f"count_if({SIDE} = {CUR})").alias("nc"))
    return found.selectExpr("*", f"{_sturges_sql('(nr + nc)')} AS k")


# Equal-width bin of v over [lo, hi] in k bins, the top edge in the last bin.
# When the range itself overflows (hi - lo = infinity, values near the double
# limits) the operands are halved first, which is exact in binary floating
# point and keeps the quotient finite.
_BIN_SQL = ("CASE WHEN v IS NULL THEN NULL WHEN hi = lo THEN 0 "
            "WHEN abs(hi - lo) < CAST('Infinity' AS DOUBLE) "
            "THEN least(CAST(floor((v - lo) / ((hi - lo) / k)) AS INT), CAST(k - 1 AS INT)) "
            "ELSE least(CAST(floor((v / 2 - lo / 2) / ((hi / 2 - lo / 2) / k)) AS INT), CAST(k - 1 AS INT)) END")


def _categorical_counts(paired: DataFrame, first: int, cols: list[tuple[str, str]],
                        totals: bool = True) -> DataFrame:
    """Value counts of categorical columns, in one pass over the data.

    No range is needed, so instead of a statistics pass the per-side totals
    come from the counts themselves: a per-column sum over the (already
    aggregated) counts, broadcast back on the column id (one row per
    column).  Both read the same counts exchange, which Spark reuses.
    """
    long = _long(paired, first, [f"CAST({ident(c)} AS STRING)" for c, _ in cols], "value")
    counts = (long.groupBy("cid", "value")
                  .agg(F.expr(f"count_if({SIDE} = {REF})").alias("ref_count"),
                       F.expr(f"count_if({SIDE} = {CUR})").alias("cur_count")))
    if totals:
        sums = counts.groupBy("cid").agg(F.sum("ref_count").alias("nr"), F.sum("cur_count").alias("nc"))
        counts = counts.join(F.broadcast(sums), "cid")
    else:
        counts = counts.selectExpr("*", "CAST(NULL AS BIGINT) AS nr", "CAST(NULL AS BIGINT) AS nc")
    return counts.selectExpr("cid", "CAST(NULL AS INT) AS bin", "value", "ref_count", "cur_count",
                             "nr", "nc", "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi",
                             "CAST(NULL AS INT) AS k")


def _numerical_counts(paired: DataFrame, first: int, cols: list[tuple[str, str]]) -> DataFrame:
    long = _long(paired, first, [_usable_sql(c) for c, _ in cols], "v")
    joined = long.join(F.broadcast(_stats(long)), "cid")      # a row a column
    counts = (joined.groupBy("cid", F.expr(_BIN_SQL).alias("bin"))
                    .agg(F.expr(f"count_if({SIDE} = {REF})").alias("ref_count"),
                         F.expr(f"count_if({SIDE} = {CUR})").alias("cur_count"),
                         F.max("nr").alias("nr"), F.max("nc").alias("nc"),
                         F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("k").alias("k")))
    return counts.selectExpr("cid", "bin", "CAST(NULL AS STRING) AS value", "ref_count", "cur_count",
                             "nr", "nc", "lo", "hi", "k")


def bin_counts(paired: DataFrame, definition: DataDefinition, totals: bool = True) -> DataFrame:
    """Counts per side of every bin (numerical) and value (categorical):
    ``cid, bin, value, ref_count, cur_count, nr, nc, lo, hi, k``.

    ``bin`` is set for numerical columns, ``value`` for categorical ones; unusable
    values (null, NaN, infinity) are in no row.  Without ``totals`` the categorical
    ``nr`` / ``nc`` stay null.  The per-column constants of numerical columns ride
    along as ``max`` aggregates instead of widening the grouping key.
    """
    cols, n = _columns(definition), len(definition.numerical)
    if not cols:
        raise ValueError("nothing to score: no numerical or categorical column")
    parts = [_numerical_counts(paired, 0, cols[:n])] if n else []
    if cols[n:]:
        parts.append(_categorical_counts(paired, n, cols[n:], totals))
    return union_all(parts)


def _lookup(definition: DataDefinition, which: int, cid: str = "cid") -> Column:
    """Column name (``which=0``) or kind (``which=1``) of a column id."""
    values = ", ".join(sql_str(t[which]) for t in _columns(definition))
    return F.expr(f"element_at(array({values}), {cid} + 1)")


def numeric_bins(paired: DataFrame, definition: DataDefinition) -> DataFrame:
    """``column_name, bin, lower, upper, ref_count, cur_count`` for every
    non-empty bin of every numerical column."""
    only = DataDefinition(definition.id_column, definition.numerical, (), ())
    counts = bin_counts(paired, only).where(F.col("bin").isNotNull())
    # bin width; computed from halves when hi - lo overflows (see _BIN_SQL)
    width = F.expr("CASE WHEN abs(hi - lo) < CAST('Infinity' AS DOUBLE) THEN (hi - lo) / k "
                   "ELSE ((hi / 2 - lo / 2) / k) * 2 END")
    return counts.select(
        _lookup(only, 0).alias("column_name"), F.col("bin").cast("bigint").alias("bin"),
        F.round(F.col("lo") + F.col("bin") * width, ROUND_DIGITS).alias("lower"),
        F.round(F.when(F.col("hi") == F.col("lo"), F.col("hi"))
                 .otherwise(F.col("lo") + (F.col("bin") + 1) * width), ROUND_DIGITS).alias("upper"),
        "ref_count", "cur_count")


def category_counts(paired: DataFrame, definition: DataDefinition) -> DataFrame:
    """``column_name, value, ref_count, cur_count`` per distinct non-null value."""
    only = DataDefinition(definition.id_column, (), definition.categorical, ())
    return (bin_counts(paired, only, totals=False).where(F.col("value").isNotNull())
                .select(_lookup(only, 0).alias("column_name"), "value", "ref_count", "cur_count"))


def _share(n: Column, total: Column) -> Column:
    return F.when(n == 0, F.lit(EMPTY_SHARE)).otherwise(F.try_divide(n.cast("double"), total))


def drift_columns(paired: DataFrame, definition: DataDefinition,
                  threshold: float = COLUMN_THRESHOLD) -> DataFrame:
    """Per-column result:
    ``column_name, kind, bins, ref_count, cur_count, psi, threshold, drifted``.

    ``psi`` is null (and ``drifted`` null) when either side has no usable
    value in that column.
    """
    counts = bin_counts(paired, definition).unionByName(_markers(paired, definition))
    in_bin = F.col("bin").isNotNull() | F.col("value").isNotNull()
    pr, pc = _share(F.col("ref_count"), F.col("nr")), _share(F.col("cur_count"), F.col("nc"))
    term = F.when(in_bin, (pc - pr) * F.ln(pc / pr))
    per_col = (counts.groupBy("cid")
                     .agg(F.coalesce(F.max("nr"), F.lit(0)).alias("nr"),
                          F.coalesce(F.max("nc"), F.lit(0)).alias("nc"),
                          F.sum(term).alias("psi_raw"), F.count_if(in_bin).alias("bins")))
    scored = (F.col("nr") > 0) & (F.col("nc") > 0)
    value = F.when(scored, F.round(F.col("psi_raw"), ROUND_DIGITS))
    return per_col.select(_lookup(definition, 0).alias("column_name"),
                          _lookup(definition, 1).alias("kind"),
                          F.col("bins").cast("bigint").alias("bins"),
                          F.col("nr").cast("bigint").alias("ref_count"),
                          F.col("nc").cast("bigint").alias("cur_count"),
                          value.alias("psi"),
                          F.lit(float(threshold)).alias("threshold"),
                          (value >= F.lit(float(threshold))).alias("drifted"))


def drift_summary(columns: DataFrame, share: float = DATASET_SHARE) -> DataFrame:
    """``scored_columns, drifted_columns, drifted_share, dataset_drifted``."""
    scored = F.count_if(F.col("psi").isNotNull())
    drifted = F.count_if(F.col("drifted"))
    agg = columns.agg(scored.alias("scored_columns"), drifted.alias("drifted_columns"))
    ratio = F.when(F.col("scored_columns") > 0,
                   F.round(F.col("drifted_columns") / F.col("scored_columns"), ROUND_DIGITS))
    return agg.select(F.col("scored_columns").cast("bigint"), F.col("drifted_columns").cast("bigint"),
                      ratio.alias("drifted_share"),
                      (ratio >= F.lit(float(share))).alias("dataset_drifted"))


def drift_tests(columns: DataFrame, share: float = DATASET_SHARE) -> DataFrame:
    """One pass/fail row per column plus one for the dataset:
    ``test, column_name, value, limit, status`` with status SUCCESS / FAIL,
    or SKIPPED for a column that could not be scored.

    One ``rollup`` over the per-column table yields both: a group per column
    (one row each) and the grand total, so the per-column plan runs once.
    """
    agg = columns.rollup("column_name").agg(
        F.first("psi").alias("psi"), F.first("threshold").alias("threshold"),
        F.first("drifted").alias("drifted"),
        F.count_if(F.col("psi").isNotNull()).alias("scored"),
        F.count_if(F.col("drifted")).alias("n_drifted"),
        F.grouping("column_name").alias("total"))
    total = F.col("total") == 1
    ratio = F.when(F.col("scored") > 0, F.round(F.col("n_drifted") / F.col("scored"), ROUND_DIGITS))
    value = F.when(total, ratio).otherwise(F.col("psi"))
    failed = F.when(total, ratio >= F.lit(float(share))).otherwise(F.col("drifted"))
    return agg.select(
        F.when(total, "drifted_share").otherwise("column_drift").alias("test"),
        F.when(~total, F.col("column_name")).alias("column_name"),
        value.alias("value"),
        F.when(total, F.lit(float(share))).otherwise(F.col("threshold")).alias("limit"),
        F.when(value.isNull(), "SKIPPED").when(failed, "FAIL").otherwise("SUCCESS").alias("status"))


class DriftReport:
    """The three result tables of one comparison.

    All are lazy; ``summary`` and ``tests`` are derived from ``columns`` and
    only built when asked for.
    """

    def __init__(self, columns: DataFrame, definition: DataDefinition,
                 share: float = DATASET_SHARE):
        self.columns = columns
        self.definition = definition
        self.share = share

    @cached_property
    def summary(self) -> DataFrame:
        return drift_summary(self.columns, self.share)

    @cached_property
    def tests(self) -> DataFrame:
        return drift_tests(self.columns, self.share)


def drift_report(paired: DataFrame, definition: DataDefinition,
                 threshold: float = COLUMN_THRESHOLD, share: float = DATASET_SHARE) -> DriftReport:
    return DriftReport(drift_columns(paired, definition, threshold), definition, share)
