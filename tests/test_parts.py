"""Names, validators, transforms, staging, plans and the queries with their SQL."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keystead.functions import transforms, validators
from keystead.naming import index_physical_name, path_name
from keystead.plans import catalogue, weekly
from keystead.sources.staging import read_delimited, write_delimited

NAMES = st.text(max_size=90)


@given(st.lists(NAMES, min_size=1, max_size=3), NAMES)
def test_index_names(parts, index):
    name = index_physical_name(parts, index)
    assert name == index_physical_name(tuple(parts), index) and re.fullmatch(r"[a-z][a-z0-9_]*", name) and len(name) <= 63


def test_index_names_differ():
    assert index_physical_name("tab", "ind1").endswith("bca86208963e5fcd")
    assert index_physical_name(("anon", "tab"), "ind1").endswith("f528f80c1c86516f") and index_physical_name("anon.tab", "ind1").endswith("f528f80c1c86516f")
    assert index_physical_name(("a", "b.c"), "i") != index_physical_name(("a.b", "c"), "i") != index_physical_name("a.b.c", "i")
    assert index_physical_name("T", "i") != index_physical_name("t", "i")
    long = "x" * 71
    assert index_physical_name("t", "a" + long) != index_physical_name("t", "b" + long)


@given(NAMES, NAMES)
def test_path_names_differ(a, b):
    assert (path_name(a) == path_name(b)) == (a == b) and re.fullmatch(r"t[A-Za-z0-9_-]*", path_name(a))


SURVEY = "granularity_time string, granularity_geo string, border {}, sex string, date {}"


def survey(spark, rows, border="string", date="date"):
    return spark.createDataFrame(rows, SURVEY.format(border, date))


@pytest.mark.parametrize("version", [1, 2])
def test_contents(spark, version):
    check = validators.field_contents_v1 if version == 1 else validators.field_contents_v2
    day = dt.date(2020, 1, 1)
    good = [("date", "nation", "2020", "total", day), ("isoyearweek", "county", "2024", "male", day), ("event_x", "municip", "2020", "female", None), ("update", "lab", "2020", "total", day)]
    assert check(survey(spark, good))
    assert check(survey(spark, [("total", "ward", 2020, "total", day)], "int"))
    bad = {"granularity_time": ("fortnight", "nation", "2020", "total", day), "granularity_geo": ("date", "parish", "2020", "total", day), "border": ("date", "nation", "1999", "total", day), "sex": ("date", "nation", "2020", "other", day)}
    for var, row in bad.items():
        assert check(survey(spark, [*good, row])) == validators.ValidationResult(False, var)
    for i, var in enumerate(bad):
        row = list(good[0])
        row[i] = None
        assert check(survey(spark, [tuple(row)])).var == var
    assert check(survey(spark, [bad["sex"], bad["border"]])).var == "border"  # the first rule that fails
    assert check(survey(spark, [], date="timestamp")).var == "date" and check(survey(spark, []).drop("date")).var == "date"
    assert check(survey(spark, good).drop("sex", "border"))
    assert bool(check(survey(spark, [("date", "region", "2020", "total", day)]))) == (version == 1)
    assert bool(check(survey(spark, [("date", "nation", "2020", "missing", day)]))) == (version == 1)
    assert bool(check(survey(spark, [("season", "nation", "2020", "total", day)]))) == (version == 2)
    assert not check(survey(spark, [("my_event", "nation", "2020", "total", day)]))


def test_field_types():
    v1, v2 = validators.field_types_v1, validators.field_types_v2
    assert v1(validators.TYPES_V1) and v2(validators.TYPES_V2) and not v1(validators.TYPES_V2) and not v2(validators.TYPES_V1)
    assert v1({**validators.TYPES_V1, "n": "INTEGER"})
    items = list(validators.TYPES_V1.items())
    assert not v1(dict(items[:15])) and not v1(dict([items[1], items[0], *items[2:]])) and not v1({**validators.TYPES_V1, "border": "TEXT"})
    assert not v1(None) and not v1(["a"]) and not v1({"a": 1})
    assert validators.field_types_blank(None) and validators.field_contents_blank(None)


def test_calendar(spark):
    days = [dt.date(2021, 1, 3), dt.date(2020, 7, 20), dt.date(2020, 7, 19), dt.date(2024, 12, 30), None]
    got = [r.asDict() for r in transforms.calendar(spark.createDataFrame([(d,) for d in days], "date date")).collect()]
    assert [(r["isoyearweek"], r["season"], r["seasonweek"]) for r in got] == [("2020-53", "2020/2021", 24.0), ("2020-30", "2020/2021", 1.0), ("2020-29", "2019/2020", 52.0), ("2025-01", "2024/2025", 24.0), (None, None, None)]
    assert (got[0]["isoquarter"], got[0]["isoyearquarter"], got[0]["calyearmonth"]) == (4, "2020-Q4", "2021-M01")


def test_weekly_sums_keep_null(spark):
    rows = [("a", dt.date(2024, 1, 1), 1), ("a", dt.date(2024, 1, 2), 2), ("b", dt.date(2024, 1, 1), None), ("b", dt.date(2024, 1, 2), 2)]
    got = weekly.weekly(spark.createDataFrame(rows, "k string, date date, n long"), ["k"], ["n"]).collect()
    assert [(r["k"], r["isoyearweek"], r["n"]) for r in got] == [("a", "2024-01", 3), ("b", "2024-01", None)]
    df = spark.createDataFrame([("county county",), ("norge",), (None,)], "c string")
    assert [r["c"] for r in weekly.recode(df, "c", ("county", "county_nor"), {"norge": "nation_nor"}).collect()] == ["county_nor county", "nation_nor", None]


def test_delimited_text_is_whole(spark, tmp_path):
    rows = [("a\tb", 1.5, True, dt.datetime(2024, 1, 1, 10)), ('say "hi"\nnext', float("inf"), False, None), (None, None, None, None), ("", float("nan"), True, None), ("\\N x", -1.0, True, None)]
    df = spark.createDataFrame(rows, "a string, b double, c boolean, d timestamp")
    for sep in ("\t", ","):
        path = str(tmp_path / f"x{ord(sep)}")
        write_delimited(df, path, sep=sep)
        got = {tuple(r) for r in read_delimited(spark, path, df.schema, sep=sep).collect()}
        assert got == {tuple(r) for r in transforms.scrub_non_finite(df).collect()}


def test_plans_prune_and_push(spark):
    sf = "/root/testdata/sf0.001"
    plan = catalogue.count_where(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan
    kept = catalogue.keep_rows_where(spark, sf).where("o_orderkey > 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in kept and "o_custkey" not in kept
    for f in (catalogue.upsert, catalogue.primary_key_violations, catalogue.scrub_non_finite):
        assert "Python" not in f(spark, sf)._jdf.queryExecution().executedPlan().toString()


def _plain(value):
    import numpy as np

    if value is None or value != value:
        return None
    return round(float(value), 9) if isinstance(value, (float, np.floating)) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([_plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and [f.name for f in df.schema] == ["o_orderstatus", "isoyearweek", "n", "price"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert F is not None
