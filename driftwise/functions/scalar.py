"""Column expressions built only from Spark's own functions.

All of them stay inside whole-stage code generation; none is a Python UDF.
ANSI mode is on by default in Spark 4, so every conversion that may meet bad
input uses a ``try_`` form and yields null instead of failing the job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.sqltext import col

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_to_timestamp(c) -> Column:
    """Epoch milliseconds -> TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_add("MILLISECOND", _col(c).cast("bigint"), F.expr(_EPOCH_NTZ))


def to_bigint(c) -> Column:
    """Integer conversion that yields null for text that is not a number."""
    return _col(c).try_cast("bigint")


# a time of day followed by a zone offset ("10:00+02:00", "10:00:00.5Z")
_OFFSET = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?\s*(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def _pattern_has_zone(fmt: str) -> bool:
    """Whether a datetime pattern parses a zone or offset (letters outside
    quoted literals)."""
    unquoted = re.sub(r"'[^']*'", "", fmt)
    return any(ch in unquoted for ch in "XxZzOV")


def _utc_reading(instant: Column) -> Column:
    """TIMESTAMP -> its reading in UTC, from the instant itself."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ; null where the text does not parse.

    Without ``fmt`` only Spark's ISO-like forms are accepted
    (``yyyy``, ``yyyy-[m]m``, ``yyyy-[m]m-[d]d`` with an optional time), decided
    row by row.  With ``fmt`` (a Spark datetime pattern such as
    ``yyyy-dd-MM``) the text must match it.

    Text with a zone offset (``...+02:00``, ``...Z``) names an instant: it is
    returned as the UTC reading of that instant.  Text without one is taken
    as a wall-clock reading and returned unchanged.
    """
    c = _col(c)
    if fmt is None:
        zoned = _utc_reading(c.try_cast("timestamp"))
        return F.when(c.rlike(_OFFSET), zoned).otherwise(c.try_cast("timestamp_ntz"))
    if _pattern_has_zone(fmt):
        return _utc_reading(F.try_to_timestamp(c, F.lit(fmt)))
    # read as if in UTC: the session zone, with its missing and double hours, has no say
    return _utc_reading(F.try_to_timestamp(F.concat(c, F.lit(" Z")), F.lit(fmt + " X")))


def coerce_datetime(name: str, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Coerce one declared datetime column, whatever its physical type.

    text -> parsed (null on failure); integer -> epoch milliseconds;
    date -> midnight; timestamps stay as they are.
    """
    c = col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.IntegralType):
        return millis_to_timestamp(c)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return parse_timestamp(c, fmt)
    return F.lit(None).cast("timestamp_ntz")


def verdict(c) -> Column:
    """Boolean -> 'identical' / 'different' (null stays null)."""
    c = _col(c)
    return F.when(c, F.lit("identical")).when(~c, F.lit("different"))


def joined_or_default(ids, default: str = "0") -> Column:
    """A comma list, or ``default`` when the list is empty or missing."""
    return F.coalesce(F.nullif(_col(ids), F.lit("")), F.lit(default))


def sorted_id_list(values) -> Column:
    """Array of ids -> ascending comma-separated text (nulls are dropped)."""
    arr = F.array_sort(F.filter(_col(values), lambda x: x.isNotNull()))
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")
