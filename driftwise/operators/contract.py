"""Column-group contracts: which types a group accepts and how many columns
it may hold.  Checked against a DataFrame schema on the driver (metadata
only); violations come back as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STRING, INT64, FLOAT64, ZONEDDATETIME = "STRING", "INT64", "FLOAT64", "ZONEDDATETIME"


def type_class(dtype: T.DataType) -> str | None:
    """Contract type of a Spark type: any integer width is INT64, float and
    double are FLOAT64, both timestamp types are ZONEDDATETIME."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(dtype, T.IntegralType):
        return INT64
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FLOAT64
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ZONEDDATETIME
    return None


@dataclass(frozen=True)
class GroupContract:
    name: str
    types: tuple[str, ...]
    min_columns: int | None = None
    max_columns: int | None = None


# The groups the reference declares, in its order.
DRIFT_GROUPS = (
    GroupContract("newdata_id", (STRING, INT64), 0, 1),
    GroupContract("newdata", (STRING, INT64, FLOAT64), 1, None),
    GroupContract("newdata_date", (ZONEDDATETIME,), None, None),
    GroupContract("refdata_id", (STRING, INT64), 0, 1),
    GroupContract("refdata", (STRING, INT64, FLOAT64), 1, None),
    GroupContract("refdata_date", (ZONEDDATETIME,), None, None),
)
SELECTION_GROUPS = (
    GroupContract("Simulationslauf", (INT64,), 1, 1),
    GroupContract("Gebäude", (INT64,), 0, 1),
)


def check_contract(schema: T.StructType, assignment: dict[str, list[str]],
                   groups=DRIFT_GROUPS) -> list[tuple[str, str | None, str]]:
    """``(group, column, problem)`` for every violation; empty when valid."""
    types = {f.name: f.dataType for f in schema.fields}
    known = {g.name for g in groups}
    out = [(g, None, "unknown group") for g in assignment if g not in known]
    for g in groups:
        cols = list(assignment.get(g.name, []))
        for c in cols:
            if c not in types:
                out.append((g.name, c, "missing column"))
            elif type_class(types[c]) not in g.types:
                out.append((g.name, c, f"type {types[c].simpleString()} not allowed"))
        if g.min_columns is not None and len(cols) < g.min_columns:
            out.append((g.name, None, f"needs at least {g.min_columns} column(s)"))
        if g.max_columns is not None and len(cols) > g.max_columns:
            out.append((g.name, None, f"allows at most {g.max_columns} column(s)"))
    return out


def contract_violations(spark: SparkSession, df: DataFrame, assignment: dict[str, list[str]],
                        groups=DRIFT_GROUPS) -> DataFrame:
    """Violations as a DataFrame ``group, column_name, problem``."""
    return spark.createDataFrame(check_contract(df.schema, assignment, groups),
                                 "group string, column_name string, problem string")


def require_contract(df: DataFrame, assignment: dict[str, list[str]], groups=DRIFT_GROUPS) -> None:
    """Raise ``ValueError`` listing every violation."""
    bad = check_contract(df.schema, assignment, groups)
    if bad:
        raise ValueError("column groups violate the contract: " + "; ".join(
            f"{g}{'.' + c if c else ''}: {p}" for g, c, p in bad))
