"""Changes of tables as plans: each function takes DataFrames and returns one.

Nothing is run here. Table commits what these return; the queries apply them to plain inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..naming import quoted


def _columns(names) -> list[str]:
    return [quoted(x) for x in names]


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left_semi or left_anti on keys; only the keys of the right side are read."""
    r = right.select(*[F.col(q).alias(f"_right_{i}") for i, q in enumerate(_columns(keys))])
    on = F.lit(True)
    for i, q in enumerate(_columns(keys)):
        on = on & (left[q] == r[f"_right_{i}"])
    return left.join(r, on, how)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those of equal keys, and the others added. The join sees
    keys alone of delta; Catalyst broadcasts them if they are small. Where every column is a key there
    is nothing to update, and only new rows are added."""
    if not keys:
        raise ValueError("keys is empty")
    delta = delta.select(*_columns(base.columns))
    if set(keys) == set(base.columns):
        return base.unionByName(matched(delta, base, keys, "left_anti"))
    return matched(base, delta, keys, "left_anti").unionByName(delta)


def last_wins(delta: DataFrame, keys: list[str], order_by: list[str | Column]) -> DataFrame:
    """Of the rows with equal keys the last in order. A DataFrame's own order has no meaning, so the
    order is asked for."""
    order = Window.partitionBy(*_columns(keys)).orderBy(*[(F.col(quoted(c)) if isinstance(c, str) else c).desc() for c in order_by])
    return delta.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def keep_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is true; false and null go."""
    return df.where(condition)


def drop_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition isn't true; false and null stay."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(c, F.lit(False)))


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a null in a key."""
    bad = F.lit(False)
    for q in _columns(keys):
        bad = bad | F.col(q).isNull()
    return df.where(bad)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often (n). Counts are taken before rows move."""
    return df.groupBy(*[F.col(q) for q in _columns(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def count_where(df: DataFrame, condition: str) -> DataFrame:
    """One row: n, the rows for which the condition is true."""
    return df.agg(F.count_if(F.expr(condition)).alias("n"))
