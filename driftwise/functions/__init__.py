"""Scalar column expressions (built-in Spark functions only)."""

from driftwise.functions.scalar import (
    coerce_datetime,
    joined_or_default,
    millis_to_timestamp,
    parse_timestamp,
    sorted_id_list,
    to_bigint,
    verdict,
)

__all__ = [
    "coerce_datetime",
    "joined_or_default",
    "millis_to_timestamp",
    "parse_timestamp",
    "sorted_id_list",
    "to_bigint",
    "verdict",
]
