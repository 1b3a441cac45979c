"""Validators of declared types and of contents.

A validator of types takes the declared columns (name to type, in order); a validator of contents takes
a DataFrame. Both return a ValidationResult, or any callable's plain bool. The contents of the
surveillance formats are checked in one job, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..naming import quoted


@dataclass(frozen=True)
class ValidationResult:
    """Whether data or types are valid, and else the name of the field that isn't."""

    ok: bool
    var: str | None = None

    def __bool__(self) -> bool:
        return self.ok


VALID = ValidationResult(True)
Validator = Callable[..., "ValidationResult | bool"]

# The leading columns of the two versions of the surveillance format.
TYPES_V1 = {
    "granularity_time": "TEXT", "granularity_geo": "TEXT", "country_iso3": "TEXT", "location_code": "TEXT", "border": "INTEGER", "age": "TEXT", "sex": "TEXT",
    "isoyear": "INTEGER", "isoweek": "INTEGER", "isoyearweek": "TEXT", "season": "TEXT", "seasonweek": "DOUBLE", "calyear": "INTEGER", "calmonth": "INTEGER", "calyearmonth": "TEXT", "date": "DATE",
}
TYPES_V2 = {
    "granularity_time": "TEXT", "granularity_geo": "TEXT", "country_iso3": "TEXT", "location_code": "TEXT", "border": "INTEGER", "age": "TEXT", "sex": "TEXT",
    "isoyear": "INTEGER", "isoweek": "INTEGER", "isoyearweek": "TEXT", "isoquarter": "INTEGER", "isoyearquarter": "TEXT", "season": "TEXT", "seasonweek": "DOUBLE", "calyear": "INTEGER", "calmonth": "INTEGER", "calyearmonth": "TEXT", "date": "DATE",
}
# The patterns and words that the formats allow.
TIMES_V1 = ("date", "isoyear", "isoyearweek", "^event", "total")
TIMES_V2 = ("date", "isoyear", "isoyearweek", "isoquarter", "isoyearquarter", "season", "^event", "total")
AREAS_V1 = ("nation", "region", "hospitaldistrict", "county", "municip", "wardoslo", "extrawardoslo", "wardbergen", "wardtrondheim", "wardstavanger", "missingwardoslo", "missingwardbergen", "missingwardtrondheim", "missingwardstavanger", "ward", "station", "georegion", "baregion", "missingcounty", "missingmunicip", "notmainlandcounty", "notmainlandmunicip", "lab")
AREAS_V2 = ("nation", "georegion", "hospitaldistrict", "county", "municip", "wardoslo", "extrawardoslo", "wardbergen", "wardtrondheim", "wardstavanger", "missingwardoslo", "missingwardbergen", "missingwardtrondheim", "missingwardstavanger", "ward", "station", "baregion", "missingcounty", "missingmunicip", "notmainlandcounty", "notmainlandmunicip", "lab")
BORDERS = ("2020", "2024")
SEXES_V1, SEXES_V2 = ("male", "female", "missing", "total"), ("male", "female", "total")


def field_types_blank(_=None) -> ValidationResult:
    """Everything is valid."""
    return VALID


def field_contents_blank(_=None) -> ValidationResult:
    """Everything is valid."""
    return VALID


def _begins_with(field_types, wanted: dict[str, str]) -> ValidationResult:
    if not isinstance(field_types, dict) or not all(isinstance(x, str) for x in field_types.values()):
        return ValidationResult(False)
    return ValidationResult(list(field_types.items())[: len(wanted)] == list(wanted.items()))


def field_types_v1(field_types) -> ValidationResult:
    """The first 16 columns are those of version 1: names, types and order."""
    return _begins_with(field_types, TYPES_V1)


def field_types_v2(field_types) -> ValidationResult:
    """The first 18 columns are those of version 2."""
    return _begins_with(field_types, TYPES_V2)


def time_matches(column: Column, patterns: tuple[str, ...] = TIMES_V1) -> Column:
    """A pattern is found anywhere in the value; null matches none."""
    found = F.lit(False)
    for p in patterns:
        found = found | column.rlike(p)
    return F.coalesce(found, F.lit(False))


def is_one_of(column: Column, words: tuple[str, ...]) -> Column:
    """The value, as text, is one of the words; null is none."""
    return F.coalesce(column.cast("string").isin(*words), F.lit(False))


def _contents(data: DataFrame, times, areas, sexes) -> ValidationResult:
    """Rules in order; the first that fails names the field. A missing column among the first four
    passes; a date that isn't there or isn't a date fails, with no rows too."""
    rules = {"granularity_time": lambda c: time_matches(c, times), "granularity_geo": lambda c: is_one_of(c, areas), "border": lambda c: is_one_of(c, BORDERS), "sex": lambda c: is_one_of(c, sexes)}
    asked = {k: r for k, r in rules.items() if k in data.columns}
    if asked:
        bad = data.agg(*[F.max(~r(F.col(quoted(k)))).alias(k) for k, r in asked.items()]).first()
        for k in asked:
            if bad[k]:
                return ValidationResult(False, k)
    kind = dict(zip(data.columns, (f.dataType for f in data.schema.fields))).get("date")
    return VALID if isinstance(kind, T.DateType) else ValidationResult(False, "date")


def field_contents_v1(data: DataFrame) -> ValidationResult:
    """Contents of version 1."""
    return _contents(data, TIMES_V1, AREAS_V1, SEXES_V1)


def field_contents_v2(data: DataFrame) -> ValidationResult:
    """Contents of version 2."""
    return _contents(data, TIMES_V2, AREAS_V2, SEXES_V2)
