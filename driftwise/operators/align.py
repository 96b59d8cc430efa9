"""Splitting, relabelling and aligning the two sides of a comparison.

All of this is projection work: ``select`` / ``alias`` / ``toDF`` on the plan,
so Catalyst prunes every column that is not used and pushes it into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.sqltext import quote
from driftwise.operators.classify import define
from driftwise.spec import DataDefinition, DatasetSpec

SIDE = "_side_of_row"       # reserved: no scored column may have this name
REF, CUR = 0, 1


def project_side(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Keep one side's columns in role order (id, features, datetimes),
    renamed from physical names to labels."""
    missing = [c for c in spec.columns() if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.selectExpr(*[f"{quote(c)} AS {quote(spec.label(c))}" for c in spec.columns()])


def id_first(df: DataFrame, id_col: str | None) -> DataFrame:
    """Move the id column to position 0 (no-op without an id)."""
    if id_col is None:
        return df
    return df.selectExpr(quote(id_col), *[quote(c) for c in df.columns if c != id_col])


@dataclass(frozen=True)
class Alignment:
    """Both sides under the current side's names, plus the shared spec."""

    ref: DataFrame
    cur: DataFrame
    spec: DatasetSpec            # roles in current-side names, paired columns only
    ref_labels: dict[str, str]   # current-side name -> the reference's own label
    ref_alone: tuple[str, ...] = ()     # labels that only one side has (loose alignment)
    cur_alone: tuple[str, ...] = ()


def align_positional(ref: DataFrame, cur: DataFrame, ref_spec: DatasetSpec,
                     cur_spec: DatasetSpec, strict: bool = True) -> Alignment:
    """Give reference column *i* the name of current column *i*.

    Both frames must already be in role order with label names (see
    :func:`project_side`).  With ``strict`` the two sides must agree on
    whether they have an id and on the number of features and of datetimes.
    Without it columns are paired by position within their role; what only one
    side has is not compared but named in ``ref_alone`` and ``cur_alone``; a name
    clash raises.
    """
    r_spec, c_spec = ref_spec.labelled(), cur_spec.labelled()
    if strict:
        shape_r = (r_spec.id is not None, len(r_spec.features), len(r_spec.datetimes))
        shape_c = (c_spec.id is not None, len(c_spec.features), len(c_spec.datetimes))
        if shape_r != shape_c:
            raise ValueError(
                f"sides differ in shape (has id, features, datetimes): reference {shape_r}, current {shape_c}")
    # id with id, features with features, datetimes with datetimes
    has_id = r_spec.id is not None and c_spec.id is not None
    features = list(zip(r_spec.features, c_spec.features))
    datetimes = list(zip(r_spec.datetimes, c_spec.datetimes))
    pairs = ([(r_spec.id, c_spec.id)] if has_id else []) + features + datetimes
    ref_cols, cur_cols = [r for r, _ in pairs], [c for _, c in pairs]
    renamed = cur_cols + [c for c in r_spec.columns() if c not in ref_cols]
    if len(set(renamed)) != len(renamed):
        raise ValueError(f"positional alignment produces duplicate names: {renamed}")
    keep = [quote(c) for c in cur_cols]
    ref_aligned = ref.selectExpr(*[quote(c) for c in ref_cols]).toDF(*cur_cols)
    spec = DatasetSpec(features=tuple(c for _, c in features), id=c_spec.id if has_id else None,
                       datetimes=tuple(c for _, c in datetimes))
    alone = [tuple(c for c in own.columns() if c not in paired) for own, paired in ((r_spec, ref_cols), (c_spec, cur_cols))]
    return Alignment(ref=ref_aligned, cur=cur.selectExpr(*keep), spec=spec, ref_labels=dict(zip(cur_cols, ref_cols)),
                     ref_alone=alone[0], cur_alone=alone[1])


def reconcile(ref_def: DataDefinition, cur_def: DataDefinition, strict: bool = True) -> DataDefinition:
    """One definition for both sides.  A column that is numerical on one side
    and categorical on the other is an error under ``strict``, else ``other``."""
    numerical, categorical, other = [], [], list(cur_def.other)
    for c in cur_def.numerical + cur_def.categorical:
        kc, kr = cur_def.kind(c), ref_def.kind(c)
        if kc == kr:
            (numerical if kc == "numerical" else categorical).append(c)
        elif strict:
            raise ValueError(f"column {c!r} is {kr} in the reference and {kc} in the current data")
        else:
            other.append(c)
    return DataDefinition(id_column=cur_def.id_column, numerical=tuple(numerical),
                          categorical=tuple(categorical), datetime=cur_def.datetime,
                          other=tuple(other))


def _scored(definition: DataDefinition) -> list[str]:
    """SQL text casting the scored columns to one type per kind."""
    return ([f"CAST({quote(c)} AS DOUBLE) AS {quote(c)}" for c in definition.numerical]
            + [f"CAST({quote(c)} AS STRING) AS {quote(c)}" for c in definition.categorical])


def check_reserved(names: Iterable[str]) -> None:
    if SIDE in names:
        raise ValueError(f"a column may not be named {SIDE}: give it a label")


def pair_frames(ref: DataFrame, cur: DataFrame, definition: DataDefinition) -> DataFrame:
    """One frame with a ``_side`` column (0 reference, 1 current) holding only
    the scored columns, cast to one type per kind.  ``UNION ALL``: no shuffle."""
    check_reserved((*definition.numerical, *definition.categorical))
    left = ref.selectExpr(f"CAST({REF} AS TINYINT) AS {SIDE}", *_scored(definition))
    right = cur.selectExpr(f"CAST({CUR} AS TINYINT) AS {SIDE}", *_scored(definition))
    return left.unionByName(right)


def pair_selected(sided: DataFrame, definition: DataDefinition) -> DataFrame:
    """Keep ``_side`` and the scored columns of a frame that already has a
    side column, cast to one type per kind."""
    check_reserved((*definition.numerical, *definition.categorical))
    return sided.selectExpr(SIDE, *_scored(definition))


def pair_columns(df: DataFrame, definition: DataDefinition, ref_of: dict[str, str], cur_of: dict[str, str]) -> DataFrame:
    """Both sides of a combined table in one scan: every row gives a reference
    row and a current row.  ``ref_of`` and ``cur_of`` give each scored
    column's physical name on either side."""
    check_reserved((*definition.numerical, *definition.categorical))
    typed = [(c, "DOUBLE") for c in definition.numerical] + [(c, "STRING") for c in definition.categorical]
    sides = [", ".join([f"CAST({side} AS TINYINT)", *[f"CAST({quote(of[c])} AS {kind})" for c, kind in typed]])
             for side, of in ((REF, ref_of), (CUR, cur_of))]
    return df.selectExpr(f"stack(2, {', '.join(sides)}) AS ({', '.join([SIDE, *[quote(c) for c, _ in typed]])})")


def pair_by_condition(df: DataFrame, current_when: Column, definition: DataDefinition) -> DataFrame:
    """Split one table by rows: ``current_when`` true -> current, false ->
    reference, null -> neither.  One scan instead of two."""
    side = F.when(current_when, F.lit(CUR)).otherwise(F.lit(REF)).cast("tinyint")
    # ``current_when IS NOT NULL`` lets Catalyst derive null checks on the
    # split column and push them into the scan.
    return (df.where(current_when.isNotNull()).withColumn(SIDE, side)
              .selectExpr(SIDE, *_scored(definition)))


@dataclass(frozen=True)
class ColumnGroups:
    """The six column groups of one combined table (physical names).

    ``*_labels`` optionally map physical names to labels.
    """

    new_features: tuple[str, ...]
    ref_features: tuple[str, ...]
    new_id: str | None = None
    ref_id: str | None = None
    new_datetimes: tuple[str, ...] = ()
    ref_datetimes: tuple[str, ...] = ()
    labels: dict | None = None

    def specs(self) -> tuple[DatasetSpec, DatasetSpec]:
        labels = dict(self.labels or {})
        ref = DatasetSpec(self.ref_features, self.ref_id, self.ref_datetimes,
                          {k: v for k, v in labels.items() if k in self._ref_cols()})
        cur = DatasetSpec(self.new_features, self.new_id, self.new_datetimes,
                          {k: v for k, v in labels.items() if k in self._new_cols()})
        return ref, cur

    def assignment(self) -> dict[str, list[str]]:
        """Group name -> physical columns, as the contract names the groups."""
        return {
            "newdata_id": [self.new_id] if self.new_id else [],
            "newdata": list(self.new_features),
            "newdata_date": list(self.new_datetimes),
            "refdata_id": [self.ref_id] if self.ref_id else [],
            "refdata": list(self.ref_features),
            "refdata_date": list(self.ref_datetimes),
        }

    def _ref_cols(self):
        return set(self.ref_features) | set(self.ref_datetimes) | ({self.ref_id} if self.ref_id else set())

    def _new_cols(self):
        return set(self.new_features) | set(self.new_datetimes) | ({self.new_id} if self.new_id else set())


def split_groups(df: DataFrame, groups: ColumnGroups) -> tuple[DataFrame, DataFrame, DatasetSpec, DatasetSpec]:
    """Split one combined table into its reference and current projections."""
    ref_spec, cur_spec = groups.specs()
    return project_side(df, ref_spec), project_side(df, cur_spec), ref_spec, cur_spec


def prepare_pair(ref: DataFrame, cur: DataFrame, ref_spec: DatasetSpec, cur_spec: DatasetSpec,
                 strict: bool = True, datetime_format: str | None = None):
    """Align two projected sides, classify each, reconcile, and pair them.

    Returns ``(paired, definition, alignment)``.
    """
    al = align_positional(ref, cur, ref_spec, cur_spec, strict=strict)
    ref_c, ref_def = define(al.ref, al.spec.id, al.spec.datetimes, datetime_format)
    cur_c, cur_def = define(al.cur, al.spec.id, al.spec.datetimes, datetime_format)
    definition = reconcile(ref_def, cur_def, strict=strict)
    return pair_frames(ref_c, cur_c, definition), definition, al
