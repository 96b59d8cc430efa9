"""Column classification and datetime coercion (the data definition).

Types come from the DataFrame's schema and are never re-inferred from values:
numeric types are numerical, strings are categorical, declared datetime
columns are coerced to timestamps, the id is excluded, and everything else
(booleans, binary, nested types, undeclared timestamps) is ``other`` and not
scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.scalar import coerce_datetime
from driftwise.spec import DataDefinition


def kind_of(dtype: T.DataType) -> str:
    """Kind of a column from its Spark type alone."""
    if isinstance(dtype, T.NumericType):
        return "numerical"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    return "other"


def classify(schema: T.StructType, id_col: str | None = None,
             datetime_cols: tuple[str, ...] | list[str] = ()) -> DataDefinition:
    """Classify the columns of ``schema`` into a :class:`DataDefinition`.

    Declared datetime columns that are absent from the schema are dropped from
    the definition; an absent id is an error.
    """
    names = [f.name for f in schema.fields]
    if id_col is not None and id_col not in names:
        raise ValueError(f"id column {id_col!r} is not in the table")
    present_dt = tuple(c for c in datetime_cols if c in names)
    numerical, categorical, other = [], [], []
    for f in schema.fields:
        if f.name == id_col or f.name in present_dt:
            continue
        {"numerical": numerical, "categorical": categorical, "other": other}[kind_of(f.dataType)].append(f.name)
    return DataDefinition(id_column=id_col, numerical=tuple(numerical),
                          categorical=tuple(categorical), datetime=present_dt,
                          other=tuple(other))


def define(df: DataFrame, id_col: str | None = None,
           datetime_cols: tuple[str, ...] | list[str] = (),
           datetime_format: str | None = None) -> tuple[DataFrame, DataDefinition]:
    """Coerce the declared datetime columns and classify the rest.

    Returns the coerced DataFrame (same columns, same order) and its
    definition.  Coercion never fails a job: unparsable values become null.
    """
    definition = classify(df.schema, id_col, datetime_cols)
    if not definition.datetime:
        return df, definition
    types = {f.name: f.dataType for f in df.schema.fields}
    coerced = df.withColumns({c: coerce_datetime(c, types[c], datetime_format)
                              for c in definition.datetime})
    return coerced, definition


def definition_table(df: DataFrame, definition: DataDefinition, chunk: int = 64) -> DataFrame:
    """The definition as rows ``column_name, kind, non_null``, where
    ``non_null`` counts the non-null values of the (coerced) column.

    One global aggregate per chunk of columns (one row per task before the
    exchange; chunks keep the generated code small on wide tables),
    unrolled into one row per column with ``inline``.
    """
    from driftwise.functions.sqltext import quote as ident
    from driftwise.functions.sqltext import sql_str
    from driftwise.operators.drift import union_all

    rows = definition.rows()
    parts = []
    for start in range(0, len(rows), chunk):
        part = rows[start:start + chunk]
        counts = df.selectExpr(*[f"count({ident(c)}) AS n{i}" for i, (c, _) in enumerate(part)])
        structs = ", ".join(f"named_struct('column_name', {sql_str(c)}, 'kind', {sql_str(k)}, "
                            f"'non_null', CAST(n{i} AS BIGINT))" for i, (c, k) in enumerate(part))
        parts.append(counts.selectExpr(f"inline(array({structs}))"))
    return union_all(parts)
