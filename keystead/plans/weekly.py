"""Daily counts to weekly ones, bound together and relabelled, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import calendar, replace_first, sum_or_null
from ..naming import quoted


def weekly_sums(daily: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of the measures by keys and ISO week, labelled isoyearweek, in no order. A null makes the sum
    of its week null. daily has a date."""
    sums = [sum_or_null(F.col(quoted(m))).alias(m) for m in measures]
    return calendar(daily, "date").groupBy(*map(quoted, [*keys, "isoyearweek"])).agg(*sums).withColumn("granularity_time", F.lit("isoyearweek"))


def weekly(daily: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """weekly_sums() in order of keys and week."""
    return weekly_sums(daily, keys, measures).orderBy(*map(quoted, [*keys, "isoyearweek"]))


def daily_and_weekly(daily: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Daily rows, labelled date, and weekly ones below each other, by name, in no order."""
    days = calendar(daily, "date").withColumn("granularity_time", F.lit("date"))
    names = [*keys, "isoyearweek", "granularity_time", *measures]
    return days.select(*map(quoted, names)).unionByName(weekly_sums(daily, keys, measures).select(*map(quoted, names)))


def recode(df: DataFrame, column: str, first: tuple[str, str], equal: dict[str, str]) -> DataFrame:
    """In a column the first finding of a text is replaced, then values that equal a key become its
    value."""
    out = replace_first(F.col(quoted(column)), *first)
    for old, new in equal.items():
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return df.withColumn(column, out)
