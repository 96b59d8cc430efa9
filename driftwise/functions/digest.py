"""128-bit digests of rows and values, from two seeded ``xxhash64`` chains.

Spark's hash skips nulls, so every value goes in behind a flag that says whether it
is null, also inside arrays, structs and maps (an array behind its size, a map as its
entries in key order).  The type is hashed first: equal readings of different types
have different digests.  As in grouping, ``-0.0`` equals ``0.0`` and ``NaN`` itself.
Everything stays in generated code and the digest is 16 bytes, whatever the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAINS = ("left half", "right half")    # first value of either chain: fixed, or stored digests would not match


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def _sealed(c: Column, dtype: T.DataType) -> Column:
    """A nested value in a form whose hash leaves nothing out."""
    if isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(c))
        return F.struct(F.size(c), F.transform(keys, lambda k: F.struct(_flagged(k, dtype.keyType), _flagged(c[k], dtype.valueType))))
    if isinstance(dtype, T.ArrayType):
        return F.struct(F.size(c), F.transform(c, lambda x: _flagged(x, dtype.elementType)))
    if isinstance(dtype, T.StructType):
        return F.struct(*[_flagged(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dtype.fields)])
    return c


def _flagged(c: Column, dtype: T.DataType) -> Column:
    return F.struct(c.isNull().alias("n"), (_sealed(c, dtype) if _nested(dtype) else c).alias("v"))


def type_text(dtype: T.DataType) -> str:
    """The type without nullability."""
    return dtype.simpleString() if not isinstance(dtype, T.StructType) else "struct<" + ",".join(f"{f.name}:{type_text(f.dataType)}" for f in dtype.fields) + ">"


def digest(values: list[tuple[Column, T.DataType]]) -> list[Column]:
    """The two halves of the digest of some values (of a row: all its columns)."""
    types = F.lit(",".join(type_text(t) for _, t in values))
    parts = [p for c, t in values for p in (c.isNull(), _sealed(c, t))]
    return [F.xxhash64(F.lit(chain), types, *parts) for chain in CHAINS]
