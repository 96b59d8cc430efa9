"""Entry points of a drift comparison: two tables, one table with column
groups, or one table split by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.sqltext import quote, sql_str
from driftwise.operators.align import (
    CUR,
    REF,
    SIDE,
    Alignment,
    ColumnGroups,
    check_reserved,
    pair_columns,
    pair_selected,
    prepare_pair,
    project_side,
    split_groups,
)
from driftwise.operators.classify import define
from driftwise.operators.contract import DRIFT_GROUPS, require_contract
from driftwise.operators.drift import COLUMN_THRESHOLD, DATASET_SHARE, DriftReport, drift_columns, union_all
from driftwise.spec import DatasetSpec


UNPAIRED = "unpaired"     # kind of a column that only one side has


def _require(df: DataFrame | None, what: str, empty: str) -> DataFrame:
    """The side, if it is there and holds a row (one row is looked for, no more)."""
    if empty not in ("raise", "null"):
        raise ValueError("empty is 'raise' or 'null'")
    if df is None:
        raise ValueError(f"missing {what}")
    if empty == "raise" and df.isEmpty():
        raise ValueError(f"empty {what}")
    return df


def _unpaired(frame: DataFrame, names: tuple[str, ...], side: int, threshold: float, chunk: int = 64) -> list[DataFrame]:
    """Report rows of the columns that have no partner: their non-null values are
    counted on their own side, and there is no score."""
    parts = []
    for at in range(0, len(names), chunk):
        part = names[at:at + chunk]
        counts = frame.selectExpr(*[f"count({quote(c)}) AS n{i}" for i, c in enumerate(part)])
        rows = ", ".join(f"named_struct('column_name', {sql_str(c)}, 'kind', '{UNPAIRED}', 'bins', 0L, "
                         f"'ref_count', {f'n{i}' if side == REF else '0L'}, 'cur_count', {f'n{i}' if side == CUR else '0L'}, "
                         f"'psi', CAST(NULL AS DOUBLE), 'threshold', CAST({float(threshold)!r} AS DOUBLE), 'drifted', CAST(NULL AS BOOLEAN))"
                         for i, c in enumerate(part))
        parts.append(counts.selectExpr(f"inline(array({rows}))"))
    return parts


def _report(paired: DataFrame, definition, ref: DataFrame, cur: DataFrame, aligned: Alignment, threshold: float, share: float) -> DriftReport:
    scored = [drift_columns(paired, definition, threshold)] if definition.numerical or definition.categorical else []
    parts = scored + _unpaired(ref, aligned.ref_alone, REF, threshold) + _unpaired(cur, aligned.cur_alone, CUR, threshold)
    if not scored:
        raise ValueError("nothing to score: no numerical or categorical column")
    return DriftReport(union_all(parts), definition, share)


def compare_frames(reference: DataFrame, current: DataFrame, ref_spec: DatasetSpec,
                   cur_spec: DatasetSpec | None = None, *, strict: bool = True,
                   datetime_format: str | None = None, threshold: float = COLUMN_THRESHOLD,
                   share: float = DATASET_SHARE, empty: str = "raise") -> DriftReport:
    """Drift of ``current`` against ``reference`` (two tables).

    ``cur_spec`` defaults to ``ref_spec`` (same column names on both sides).

    Each side is cut to its spec's columns in role order and relabelled; the
    reference columns then take the current names by position.  A missing side
    and one without rows raise (``empty="null"``: a side without rows gives null
    scores).  Without ``strict`` a column that only one side has is a row of kind
    ``unpaired``.
    """
    cur_spec = cur_spec or ref_spec
    reference = _require(reference, "reference data", empty)
    current = _require(current, "current data", empty)
    ref = project_side(reference, ref_spec)
    cur = project_side(current, cur_spec)
    paired, definition, aligned = prepare_pair(ref, cur, ref_spec, cur_spec, strict, datetime_format)
    return _report(paired, definition, ref, cur, aligned, threshold, share)


def compare_groups(df: DataFrame, groups: ColumnGroups, *, strict: bool = True,
                   datetime_format: str | None = None, threshold: float = COLUMN_THRESHOLD,
                   share: float = DATASET_SHARE, empty: str = "raise") -> DriftReport:
    """Drift between two column groups of one table (the combined-table form).

    Both sides come from the same scan (see :func:`pair_columns`).  A table without
    rows raises (``empty="null"``: null scores).
    """
    require_contract(df, groups.assignment(), DRIFT_GROUPS)
    df = _require(df, "data", empty)
    ref, cur, ref_spec, cur_spec = split_groups(df, groups)
    _, definition, aligned = prepare_pair(ref, cur, ref_spec, cur_spec, strict, datetime_format)
    ref_names, cur_names = ({spec.label(c): c for c in spec.columns()} for spec in (ref_spec, cur_spec))
    paired = pair_columns(df, definition, {c: ref_names[r] for c, r in aligned.ref_labels.items()}, cur_names)
    return _report(paired, definition, ref, cur, aligned, threshold, share)


def compare_split(df: DataFrame, spec: DatasetSpec, current_when: Column, *,
                  datetime_format: str | None = None,
                  threshold: float = COLUMN_THRESHOLD, share: float = DATASET_SHARE) -> DriftReport:
    """Drift between the rows where ``current_when`` is false (reference) and
    true (current) of one table, in a single scan.  Rows where it is null
    belong to neither side.  Columns carry their labels in the result."""
    labelled = spec.labelled()
    check_reserved(labelled.columns())
    side = F.when(current_when, F.lit(CUR)).otherwise(F.lit(REF)).cast("tinyint")
    base = (df.where(current_when.isNotNull())
              .select(side.alias(SIDE), *[F.col(quote(c)).alias(spec.label(c)) for c in spec.columns()]))
    _, definition = define(base.drop(SIDE), labelled.id, labelled.datetimes, datetime_format)
    return DriftReport(drift_columns(pair_selected(base, definition), definition, threshold), definition, share)
