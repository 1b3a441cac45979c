"""Column transforms: scrubbing, projection, calendar columns, recoding. All stay inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..naming import quoted


def scrub_non_finite(df: DataFrame) -> DataFrame:
    """NaN and the infinities of floating columns become null; other columns stay."""
    made = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(quoted(f.name))
            made[f.name] = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return df.select(*[(made[n] if n in made else F.col(quoted(n))).alias(n) for n in df.columns])


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns, in order and of the declared types; others are dropped, a missing one
    raises."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"Missing from newdata: {', '.join(missing)}")
    return df.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """df with the calendar columns of a date: isoyear, isoweek, isoyearweek, isoquarter, isoyearquarter,
    season, seasonweek, calyear, calmonth, calyearmonth. A season runs from ISO week 30 to week 29;
    seasonweek counts in it from 1."""
    d = F.col(quoted(date))
    year, week = F.extract(F.lit("YEAROFWEEK"), d).cast("long"), F.weekofyear(d).cast("long")
    quarter = F.least(F.lit(4), F.ceil(week / 13)).cast("long")
    begins = F.when(week >= 30, year).otherwise(year - 1)
    # the 28th of December is always in the last ISO week of its year
    last = F.weekofyear(F.make_date(begins.cast("int"), F.lit(12), F.lit(28)))
    return df.withColumns(
        {
            "isoyear": year,
            "isoweek": week,
            "isoyearweek": F.concat(year.cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0")),
            "isoquarter": quarter,
            "isoyearquarter": F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")),
            "season": F.concat(begins.cast("string"), F.lit("/"), (begins + 1).cast("string")),
            "seasonweek": F.when(week >= 30, week - 29).otherwise(week + last - 29).cast("double"),
            "calyear": F.year(d).cast("long"),
            "calmonth": F.month(d).cast("long"),
            "calyearmonth": F.date_format(d, "yyyy-'M'MM"),
        }
    )


def replace_first(column: Column, plain: str, by: str) -> Column:
    """The first finding of a plain text replaced; later ones stay."""
    at = F.instr(column, plain)
    return F.when(at > 0, F.concat(F.substring(column, F.lit(1), at - 1), F.lit(by), F.substring(column, at + len(plain), F.length(column)))).otherwise(column)


def replace_first_match(column: Column, pattern: str, by: str) -> Column:
    """The first finding of a regular expression replaced; later ones stay. $1 and so on in `by` are the
    pattern's groups; backreferences in the pattern itself count from 2."""
    by = re.sub(r"\$([0-9])", lambda m: f"${int(m[1]) + 1}", by)
    # anchored at the text's beginning, so it matches once; what lies ahead of the finding is kept
    return F.regexp_replace(column, rf"\A((?s:.*?))(?:{pattern})", f"$1{by}")


def number_in_text(column: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """The first number in a text, scaled and rounded; null without one."""
    number = F.regexp_extract(column, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double") * F.lit(scale)
    return number if digits is None else F.round(number, digits)


def sum_or_null(column: Column) -> Column:
    """The sum of a group, null if a value of it is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))
