"""Quoting for Spark SQL text built from column names and values.

Expressions written as SQL text (``selectExpr`` / ``F.expr``) cost one call
to the JVM per step instead of several per column; names are always quoted
so dots, spaces and backticks in column names stay literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """A column name quoted for Spark SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(text: str) -> str:
    """A string literal for Spark SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    """``F.col`` that takes the name literally (no struct-field parsing)."""
    return F.col(quote(name))
