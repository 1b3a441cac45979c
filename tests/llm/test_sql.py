"""The operators' queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from keystead.llm import queries

SF = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or value != value:
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([_plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)
