"""The closed set of declared types, and schemas made of them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "TEXT": T.StringType(),
    "INTEGER": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
}


def without_length(declared: str) -> str:
    """`TEXT (100)` is TEXT. Without the blank the name is left as it is, and isn't a type."""
    return re.sub(r" \([0-9]*\)", "", declared)


def with_length(declared: str) -> str:
    """The form with a length that a bare TEXT gets, for callers that print declarations."""
    return "TEXT (100)" if declared == "TEXT" else declared


def schema_of(field_types: dict[str, str], keys: list[str] | tuple[str, ...] = ()) -> T.StructType:
    """The schema of declared columns, in order; keys aren't nullable. An unknown type raises."""
    fields = []
    for name, declared in field_types.items():
        kind = TYPES.get(without_length(declared))
        if kind is None:
            raise ValueError(f"column {name}: type {declared!r} is not one of {', '.join(TYPES)}")
        fields.append(T.StructField(name, kind, name not in keys))
    return T.StructType(fields)
