"""Keyed, validated tables for PySpark, planned by Catalyst over versioned Parquet snapshots."""

from .functions.validators import (
    ValidationResult,
    field_contents_blank,
    field_contents_v1,
    field_contents_v2,
    field_types_blank,
    field_types_v1,
    field_types_v2,
)
from .sources.store import Store, get_auth_hook, get_table_names_and_info, set_auth_hook
from .table import Table

__all__ = [
    "Store",
    "Table",
    "ValidationResult",
    "field_contents_blank",
    "field_contents_v1",
    "field_contents_v2",
    "field_types_blank",
    "field_types_v1",
    "field_types_v2",
    "get_auth_hook",
    "get_table_names_and_info",
    "set_auth_hook",
]
