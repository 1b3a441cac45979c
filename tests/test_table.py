"""Tables: declaration, writes, reads, guards, indexes, store. Each failure leaves the table as it was."""

from __future__ import annotations

import datetime as dt
import os
import signal
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pyspark
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystead.functions.validators import ValidationResult
from keystead.operators import dml
from keystead.sources import jdbc
from keystead.sources import store as stores
from keystead.sources.snapshot import Snapshots
from keystead.sources.store import Store, get_auth_hook, get_table_names_and_info, set_auth_hook
from keystead.streaming.sink import stream_into
from keystead.table import Table

ROOT = str(Path(__file__).resolve().parents[1])
ABC = {"a": "TEXT", "b": "INTEGER", "c": "DOUBLE"}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "root"))


@pytest.fixture
def abc(store):
    return Table(store, "tab", ABC, ["a", "b"], {"ind1": ["a", "c"], "ind2": ["c"]})


def rows(table):
    return sorted(tuple(r) for r in table.tbl().collect())


def frame(spark, data, schema="a string, b long, c double"):
    return spark.createDataFrame(data, schema)


def test_six_types_round_trip_in_declared_order(spark, store):
    t = Table(store, "six", {"a": "TEXT", "b": "INTEGER", "c": "DOUBLE", "d": "BOOLEAN", "e": "DATE", "f": "DATETIME"}, ["b", "a"])
    when = dt.datetime(2021, 6, 30, 23, 59, 59)
    t.insert_data(frame(spark, [(True, "x", 1, 1.5, dt.date(2020, 1, 1), when), (None, "y", 2, None, None, None)], "d boolean, a string, b int, c double, e date, f timestamp_ntz"))
    assert t.tbl().columns == list("abcdef") and t.tbl().schema["f"].dataType == T.TimestampType()
    assert rows(t) == [("x", 1, 1.5, True, dt.date(2020, 1, 1), when), ("y", 2, None, None, None, None)]
    assert t.keys == ["b", "a"]


def test_non_finite_values_become_null_and_the_source_stays(spark, abc):
    data = frame(spark, [("x", 1, float("inf")), ("y", 2, float("-inf")), ("z", 3, float("nan")), ("", 4, 2.5)])
    abc.insert_data(data.select("c", "a", "b", F.lit(1).alias("extra")))
    assert rows(abc) == [("", 4, 2.5), ("x", 1, None), ("y", 2, None), ("z", 3, None)]
    assert data.where("c = double('inf')").count() == 1


def test_upsert_updates_adds_and_repeats(spark, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0), ("y", 2, 2.0)]))
    delta = frame(spark, [("x", 1, 10.0), ("z", 3, 3.0)])
    for _ in range(2):
        abc.upsert_data(delta)
        assert rows(abc) == [("x", 1, 10.0), ("y", 2, 2.0), ("z", 3, 3.0)]


def test_upsert_rewrites_only_touched_segments(spark, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    abc.insert_data(frame(spark, [("y", 2, 2.0), ("w", 9, 9.0)]))
    first = abc._newest().segments[0]
    abc.upsert_data(frame(spark, [("y", 2, 20.0)]))
    assert first in abc._newest().segments and rows(abc) == [("w", 9, 9.0), ("x", 1, 1.0), ("y", 2, 20.0)]
    abc.drop_rows_where("c = 9")
    assert first in abc._newest().segments and abc.nrow() == 2
    abc.compact()
    assert len(abc._newest().segments) == 1 and rows(abc) == [("x", 1, 1.0), ("y", 2, 20.0)]


def test_segments_out_of_range_are_not_read(spark, store, monkeypatch):
    t = Table(store, "t", {"b": "INTEGER", "c": "DOUBLE"}, ["b"])
    for low in (0, 100, 200):
        t.insert_data(frame(spark, [(low + i, 1.0) for i in range(10)], "b long, c double"))
    names = {s.low: s.name for s in t._newest().segments}
    assert [(s.low, s.high) for s in t._newest().segments] == [(0, 9), (100, 109), (200, 209)]
    read, path = [], Snapshots.path
    monkeypatch.setattr(Snapshots, "path", lambda self, s: read.append(s.name) or path(self, s))
    t.insert_data(frame(spark, [(300, 1.0)], "b long, c double"))
    t.upsert_data(frame(spark, [(105, 5.0), (400, 1.0)], "b long, c double"))
    assert names[0] not in read and names[100] in read
    assert t.nrow() == 32 and t.tbl().where("b = 105").first()["c"] == 5.0
    with pytest.raises(ValueError, match="duplicate key"):
        t.insert_data(frame(spark, [(209, 1.0)], "b long, c double"))
    d = Table(store, "d", {"d": "DATE", "f": "DATETIME"}, ["d"])
    d.insert_data(frame(spark, [(dt.date(2024, 1, 2), None)], "d date, f timestamp"))
    assert d._newest().segments[0].low == "2024-01-02"
    with pytest.raises(ValueError, match="duplicate key"):
        d.insert_data(frame(spark, [(dt.date(2024, 1, 2), None)], "d date, f timestamp"))


def test_ranges_of_another_key_are_not_compared(spark, store):
    fields, schema = {"a": "INTEGER", "b": "INTEGER", "t": "TEXT"}, "a long, b long, t string"
    Table(store, "o", fields, ["a"]).insert_data(frame(spark, [(1, 1000, "x")], schema))
    t = Table(store, "o", fields, ["b"])  # the same columns, another key
    t.insert_data(frame(spark, [(3, 5, "w")], schema))
    with pytest.raises(ValueError, match="duplicate key"):
        t.insert_data(frame(spark, [(2, 1000, "y")], schema))
    t.upsert_data(frame(spark, [(2, 1000, "z")], schema))
    assert rows(t) == [(2, 1000, "z"), (3, 5, "w")]
    t.add_constraint(["t"])  # a text against the numbers of before
    t.upsert_data(frame(spark, [(7, 8, "z")], schema))
    assert rows(t) == [(3, 5, "w"), (7, 8, "z")]


def test_upsert_where_all_columns_are_keys(spark, store):
    t = Table(store, "k", {"a": "TEXT", "b": "INTEGER"}, ["a", "b"])
    t.insert_data(frame(spark, [("x", 1)], "a string, b long"))
    t.upsert_data(frame(spark, [("x", 1), ("y", 2)], "a string, b long"))
    assert rows(t) == [("x", 1), ("y", 2)]
    t.upsert_data(frame(spark, [("x", 1)], "a string, b long"))
    assert rows(t) == [("x", 1), ("y", 2)]


def test_upsert_preconditions(spark, store):
    t = Table(store, "nokeys", ABC)
    t.insert_data(frame(spark, [("x", 1, 1.0)]))
    with pytest.raises(ValueError, match="keys is empty"):
        t.upsert_data(frame(spark, [("x", 1, 2.0)]))
    assert rows(t) == [("x", 1, 1.0)]
    t.keys = ["nope"]
    with pytest.raises(ValueError, match="Missing from fields"):
        t.upsert_data(frame(spark, [("x", 1, 2.0)]))
    t.keys = ["a"]
    t.field_types = {"a": "TEXT", "b": "INTEGER"}
    t._ensure = lambda: None
    with pytest.raises(ValueError, match="In the table but not fields"):
        t.upsert_data(frame(spark, [("x", 1, 2.0)]))


def test_repeated_keys_in_a_batch(spark, abc):
    batch = frame(spark, [("x", 1, 1.0), ("x", 1, 2.0)])
    for write in (abc.insert_data, abc.upsert_data):
        with pytest.raises(ValueError, match="duplicate key"):
            write(batch)
        assert rows(abc) == []
    with pytest.raises(ValueError, match="order_by"):
        abc.upsert_data(batch, on_duplicate="last")
    abc.upsert_data(batch, on_duplicate="last", order_by=["c"])
    assert rows(abc) == [("x", 1, 2.0)]


def test_primary_key_is_enforced(spark, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    with pytest.raises(ValueError, match="duplicate key"):
        abc.insert_data(frame(spark, [("x", 1, 5.0)]))
    with pytest.raises(ValueError, match="NOT NULL"):
        abc.insert_data(frame(spark, [(None, 1, 5.0)]))
    with pytest.raises(ValueError, match="NOT NULL"):
        abc.upsert_data(frame(spark, [(None, 1, 5.0)]))
    assert rows(abc) == [("x", 1, 1.0)]
    data = abc.store.autoconnection.names(f"{abc._snapshots().folder}/data")
    assert len(data) == 1  # what failed left no files


def test_keep_and_drop_are_complements_on_null(spark, abc):
    data = frame(spark, [("x", 1, 5.0), ("y", 2, None), ("z", 3, -5.0)])
    abc.insert_data(data)
    abc.drop_rows_where("c < 0")
    assert rows(abc) == [("x", 1, 5.0), ("y", 2, None)]
    abc.keep_rows_where("c > 0")
    assert rows(abc) == [("x", 1, 5.0)]
    assert dml.keep_where(data, "c > 0").count() + dml.drop_where(data, "c > 0").count() == 3
    assert len(abc.get_indexes()) == 2
    with pytest.raises(ValueError, match="duplicate key"):
        abc.insert_data(frame(spark, [("x", 1, 5.0)]))


def test_truncate_keeps_keys_and_indexes(spark, abc):
    abc.insert_data(frame(spark, [("x", 1, 5.0)]))
    abc.drop_all_rows()
    assert rows(abc) == [] and len(abc.get_indexes()) == 2
    abc.insert_data(frame(spark, [("x", 1, 5.0)]))
    with pytest.raises(ValueError, match="duplicate key"):
        abc.insert_data(frame(spark, [("x", 1, 6.0)]))


def test_reserved_words_and_dotted_names(spark, store):
    t = Table(store, "order", {"select": "TEXT", "group": "INTEGER", "where": "DOUBLE"}, ["select", "group"], {"from": ["where"]})
    t.insert_data(frame(spark, [("x", 1, 1.0), ("y", 2, 2.0)], "select string, group long, where double"))
    t.upsert_data(frame(spark, [("x", 1, 9.0)], "select string, group long, where double"))
    t.keep_rows_where("`where` > 5")
    t.drop_rows_where("`group` = 7")
    assert rows(t) == [("x", 1, 9.0)] and t.nrow() == 1
    d = Table(store, "an.on.tab", ABC, ["a", "b"], {"ind1": ["c"]})
    d.insert_data(frame(spark, [("x", 1, 1.0)]))
    assert [r["table_name"] for r in store.table_info().collect()] == ["an.on.tab", "order"] and d.info().first()["nrow"] == 1
    one, two = Table(store, ("a", "b.c"), ABC), Table(store, ("a.b", "c"), ABC)
    one.insert_data(frame(spark, [("x", 1, 1.0)]))
    assert two.nrow() == 0 and one.nrow() == 1


def test_types_are_a_closed_set(store):
    for bad in ("VARCHAR(100)", "TEXT(100)"):
        t = Table(store, "bad", {"x": bad}, ["x"])
        with pytest.raises(ValueError, match="column x"):
            t.create_table()
        assert not t.table_exists()
    t = Table(store, "good", {"x": "TEXT (100)"}, ["x"])
    t.create_table()
    assert t.table_exists() and t.field_types == {"x": "TEXT"}


def test_column_drift_makes_the_table_anew(spark, store, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    assert Table(store, "tab", ABC, ["a", "b"]).nrow() == 1
    other = Table(store, "tab", {"b": "INTEGER", "a": "TEXT", "c": "DOUBLE"}, ["a"])
    assert not other.check_fields_match()
    assert other.nrow() == 0 and other.tbl().columns == ["b", "a", "c"]


def test_nothing_to_write_returns_before_validation(spark, store):
    def never(_):
        raise AssertionError("validated")

    t = Table(store, "t", ABC, ["a"], validator_field_contents=never)
    for write in (t.insert_data, t.upsert_data):
        write(None)
        write(frame(spark, []))
    assert t.table_exists()
    t.validator_field_contents = lambda _: ValidationResult(False, "c")
    for write in (t.insert_data, t.upsert_data):
        with pytest.raises(ValueError, match=r"load_data_infile not validated in t\. c"):
            write(frame(spark, [("x", 1, 1.0)]))
    assert t.nrow() == 0


def refuses_bad(d):
    if "c" not in d.columns:
        return ValidationResult(False, "c")
    return ValidationResult(False, "a") if not d.where("a = 'bad'").isEmpty() else True


@pytest.mark.parametrize("method", ["drop_all_rows_and_then_upsert_data", "drop_all_rows_and_then_insert_data"])
def test_guarded_reload(spark, store, method, monkeypatch):
    t = Table(store, "t", ABC, ["a", "b"], {"ind1": ["c"]}, validator_field_contents=refuses_bad)
    with pytest.raises(ValueError, match="newdata is NULL"):
        getattr(t, method)(None)
    assert not t.table_exists()
    sentinels = [("s1", 1, 1.5), ("s2", 2, 2.5), ("s3", 3, 3.5)]
    t.insert_data(frame(spark, sentinels))
    refused = [
        (None, ValueError, "newdata is NULL"), ("text", TypeError, "not a data frame"), ([("x", 1, 1.0)], TypeError, "not a data frame"),
        (frame(spark, [("bad", 1, 1.0)]), ValueError, "not validated in t. a"), (frame(spark, [], "a string, b long"), ValueError, "not validated in t. c"),
        (frame(spark, [("x", 1, 1.0), ("x", 1, 2.0)]), ValueError, "duplicate key"), (frame(spark, [(None, 1, 1.0)]), ValueError, "NOT NULL"),
    ]
    for data, kind, said in refused:
        with pytest.raises(kind, match=said):
            getattr(t, method)(data)
        assert rows(t) == sentinels
    t.validator_field_contents = lambda d: 1
    with pytest.raises(ValueError, match="not named by the validator"):
        getattr(t, method)(frame(spark, [("x", 1, 1.0)]))
    t.validator_field_contents = refuses_bad
    unstable = frame(spark, [("x", 1, 1.0)])
    counts = iter([3, 5])
    monkeypatch.setattr(unstable, "count", lambda: next(counts), raising=False)
    with pytest.raises(ValueError, match="two reads"):
        getattr(t, method)(unstable)
    assert rows(t) == sentinels
    before = t.tbl()
    getattr(t, method)(frame(spark, [("n", 7, 7.0)]))
    assert rows(t) == [("n", 7, 7.0)]
    assert before.count() == 3  # a lazy read keeps its version
    getattr(t, method)(pd.DataFrame({"a": ["p"], "b": [8], "c": [8.0]}))
    assert rows(t) == [("p", 8, 8.0)]
    getattr(t, method)(frame(spark, []))
    assert rows(t) == [] and len(t.get_indexes()) == 1


def test_confirmed_insert(spark, abc, monkeypatch):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]), confirm_insert_via_nrow=True)
    assert abc.nrow(True) == 1
    monkeypatch.setattr(abc, "nrow", lambda use_count=False: 0)
    with pytest.raises(RuntimeError, match="Upsert failed"):
        abc.insert_data(frame(spark, [("y", 1, 1.0)]), confirm_insert_via_nrow=True)


def test_two_writers_cannot_commit_one_version(spark, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    shots, old = abc._snapshots(), abc._newest()
    shots.commit(old, old)
    with pytest.raises(Exception, match="(?i)exist"):
        shots.commit(old, old)
    assert rows(abc) == [("x", 1, 1.0)]


def test_old_versions_go_by_age(spark, abc):
    abc.upsert_data(frame(spark, [("x", 1, 0.0), ("y", 2, 0.0)]))
    reader = abc.tbl()
    for i in range(10):
        abc.upsert_data(frame(spark, [("x", 1, float(i))]))
    abc.drop_indexes()
    assert sorted(tuple(r) for r in reader.collect()) == [("x", 1, 0.0), ("y", 2, 0.0)]  # ten commits later
    files, folder = abc.store.autoconnection, abc._snapshots().folder
    before = rows(abc)
    abc._snapshots().stage(frame(spark, [("left", 1, 1.0)]))  # by a writer that failed
    abc.vacuum(3600)
    assert len(files.names(f"{folder}/manifests")) > 10
    abc.vacuum(0)
    assert len(files.names(f"{folder}/manifests")) == 1 and rows(abc) == before == [("x", 1, 9.0), ("y", 2, 0.0)]
    assert set(files.names(f"{folder}/data")) == {s.name for s in abc._newest().segments}


def test_a_key_touches_one_file(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "files"), file_bytes=20_000)
    t = Table(store, "t", {"k": "INTEGER", "v": "TEXT"}, ["k"])
    t.insert_data(spark.range(20_000).selectExpr("id * 7919 % 20000 as k", "uuid() as v"))
    t.compact()
    before = t._newest().segments
    assert len(before) == 1 and len(before[0].files) > 5 and not before[0].overlaps()
    read, real = [], Snapshots.read
    monkeypatch.setattr(Snapshots, "read", lambda self, m, schema, segments=None: read.extend(segments or ()) or real(self, m, schema, segments))
    t.upsert_data(frame(spark, [(7777, "new")], "k long, v string"))
    monkeypatch.undo()
    kept, after = before[0].names(), t._newest().segments
    gone = kept - after[0].names()
    assert len(gone) == 1 and after[0].name == before[0].name and t.nrow(True) == 20_000
    assert {n for s in read if s.name == before[0].name for n in s.names()} == gone
    assert t.tbl().where("v = 'new'").first()["k"] == 7777
    t.drop_rows_where("k between 100 and 110")
    assert len(kept - t._newest().segments[0].names()) <= 3 and t.nrow() == 20_000 - 11 == t.nrow(True)
    with pytest.raises(ValueError, match="duplicate key"):
        t.insert_data(frame(spark, [(7777, "again")], "k long, v string"))
    t.insert_data(frame(spark, [(20_001, "one")], "k long, v string"))
    large = spark.range(0, 40_000, 2).selectExpr("id as k", "uuid() as v")  # more keys than are looked up one by one
    t.upsert_data(large)
    assert t.nrow(True) == t.tbl().select("k").distinct().count() == 20_000 + 10_000 - 5 + 1


def test_what_is_validated_is_what_is_loaded(spark, store):
    """A source that gives other rows on each reading, and is counted while it is read."""
    reads = spark.sparkContext.accumulator(0)

    def rows_of(it):
        reads.add(1)
        yield from it

    def source():
        return frame(spark, [("x", 1, 1.0)]).rdd.coalesce(1).mapPartitions(rows_of).toDF("a string, b long, c double").withColumn("c", F.rand())

    seen = []

    def validator(d):
        seen.append(d.first()["c"])
        return True

    t = Table(store, "t", ABC, ["a"], validator_field_contents=validator)
    t.insert_data(source())
    assert reads.value == 1 and rows(t)[0][2] == seen[-1]
    t.upsert_data(source())
    assert reads.value == 2 and rows(t)[0][2] == seen[-1]
    t.upsert_data(source(), on_duplicate="last", order_by=["c"])
    assert reads.value == 3 and rows(t)[0][2] == seen[-1]
    for load in (t.drop_all_rows_and_then_insert_data, t.drop_all_rows_and_then_upsert_data):
        load(source())
        assert rows(t)[0][2] == seen[-1]
    plain = Table(store, "plain", ABC, ["a"])
    plain.insert_data(source())
    assert reads.value == 8  # a reload counts its source and copies it


def test_a_forked_child_does_not_use_its_parents_session(spark, store):
    store.connect()
    handle = store.connection
    r, w = os.pipe()
    if (pid := os.fork()) == 0:
        said = []
        signal.alarm(60)  # a child that hangs ends
        try:
            said.append(str(store.is_connected()))
            said.append(str(store.connection))
            store.connect(attempts=1)
            said.append("connected")
        except ConnectionError as e:
            said += [str(store.parked == [handle]), str("forked" in str(e.__cause__))]
        finally:
            os.write(w, ",".join(said).encode())
            os._exit(0)
    os.waitpid(pid, 0)
    assert os.read(r, 1000).decode() == "False,None,True,True"
    assert store.is_connected() and store.connection is handle and spark.range(3).count() == 3


def test_an_embedded_database_on_a_cluster(tmp_path):
    """Executors are processes of their own, which can't reach a database inside of the driver."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
rows = __spark_entry__.queries()["server_round_trip"](spark, "/root/testdata/sf0.001")
print("found", rows.count(), rows.where("c_custkey <= 10").count(), rows.where("c_acctbal is null").count() > 0)
spark.stop()
"""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "found 139 0 True" in ran.stdout, ran.stderr[-3000:]


def test_rows_of_an_embedded_database_through_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jdbc, "_out_of_reach", lambda spark, config: True)
    monkeypatch.setattr(jdbc, "PART", 2)
    s = Store(spark, str(tmp_path / "r"), driver="jdbc:derby:memory:through;create=true")
    data = frame(spark, [("x", 1, 1.5), ("y", 2, float("inf")), (None, 3, None)])
    shown = lambda: sorted(str(tuple(r)) for r in s.server_tbl("tab").collect())
    want = ["('x', 1, 1.5)", "('y', 2, None)", "(None, 3, None)"]
    s.copy_to_server(data, "tab")
    assert shown() == want
    s.copy_to_server(data, "tab", mode="ignore")
    assert shown() == want
    with pytest.raises(Exception, match="already exists"):
        s.copy_to_server(data, "tab", mode="error")
    s.copy_to_server(data.limit(1), "tab")
    assert shown() == sorted([*want, "('x', 1, 1.5)"])
    assert s.server_tbl("(SELECT * FROM tab WHERE \"b\" > 3) x").count() == 0
    s.copy_to_server(data.where("b = 2"), "tab", mode="overwrite")
    assert shown() == ["('y', 2, None)"]


def test_embedded_databases_by_address():
    assert all(jdbc.EMBEDDED.match(x) for x in ("jdbc:derby:memory:a", "jdbc:derby:/a/b;create=true", "jdbc:sqlite:a.db", "jdbc:h2:mem:a", "jdbc:hsqldb:file:a"))
    assert not any(jdbc.EMBEDDED.match(x) for x in ("jdbc:derby://h:1527/a", "jdbc:h2:tcp://h/a", "jdbc:hsqldb:hsql://h/a", "jdbc:postgresql://h/a"))


def test_tables_of_a_server(spark, tmp_path):
    s = Store(spark, str(tmp_path / "r"), driver="jdbc:derby:memory:keystead;create=true")
    data = frame(spark, [("x", 1, 1.5), ("y", 2, float("inf")), (None, 3, None)])
    s.copy_to_server(data, "tab")
    s.copy_to_server(data.limit(1), "tab")
    assert sorted(str(tuple(r)) for r in s.server_tbl("tab").collect()) == sorted(["('x', 1, 1.5)", "('y', 2, None)", "(None, 3, None)", "('x', 1, 1.5)"])
    parts = s.server_tbl("tab", partition_by="b", low=1, high=4, partitions=3)
    assert parts.rdd.getNumPartitions() == 3 and parts.where("b > 1").count() == 2
    t = Table(s, "copy", ABC)
    t.insert_data(s.server_tbl("tab"))
    assert t.nrow() == 4
    config = {"driver": "PostgreSQL Unicode", "server": "h", "db": "d", "sslmode": "require"}
    assert jdbc.address(config) == "jdbc:postgresql://h:5432/d?sslmode=require"
    assert jdbc.address({"driver": "ODBC Driver 17 for SQL Server", "server": "h", "port": 99, "db": "d", "trusted_connection": "yes"}) == "jdbc:sqlserver://h:99;databaseName=d;integratedSecurity=true"
    for bad in ({"driver": "none"}, {"driver": "mysql", "server": "h"}):
        with pytest.raises(ValueError):
            jdbc.address(bad)


def test_drift_is_one_commit(spark, store, abc):
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    reader = abc.tbl()
    other = Table(store, "tab", {"b": "INTEGER", "a": "TEXT", "c": "DOUBLE"}, ["a"])
    assert other.nrow() == 0 and reader.count() == 1  # files of the version before stay for its readers


def test_index_columns_have_three_answers(spark, store, abc, monkeypatch):
    assert abc.get_index_columns(abc.index_physical_name("ind1")) is None
    abc.create_table()
    assert abc.get_index_columns(abc.index_physical_name("ind1")) == ["a", "c"] and abc.get_index_columns("nope") == []
    abc.drop_indexes()
    monkeypatch.setattr(Snapshots, "commit", lambda self, old, new: new)  # a commit that gets lost
    with pytest.raises(RuntimeError, match="is not on table tab"):
        abc.add_indexes()
    monkeypatch.undo()
    assert not abc._adding


def test_both_lists_are_printed_where_columns_differ(store, abc, capsys):
    abc.create_table()
    assert abc.check_fields_match() and not capsys.readouterr().out
    other = Table(store, "tab", {"b": "INTEGER", "a": "TEXT"})
    assert not other.check_fields_match() and capsys.readouterr().out == "fields in tab: a, b, c\nfields declared: b, a\n"


def test_indexes(spark, store, abc, monkeypatch):
    commits = []
    commit = Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda self, a, b: commits.append(b) or commit(self, a, b))
    abc.create_table()
    assert [abc.get_index_columns(x) for x in abc.get_indexes()] == [["a", "c"], ["c"]] and len(commits) == 3
    abc.confirm_indexes()
    assert len(commits) == 3
    other = Table(store, "tab2", ABC, ["a", "b"], {"ind1": ["c"]})
    other.create_table()
    assert set(abc.get_indexes()).isdisjoint(other.get_indexes())
    abc.drop_indexes()
    assert abc.get_indexes() == [] and abc.get_index_columns("nope") == []
    foreign = Table(store, "tab", ABC, ["a", "b"], {"theirs": ["b"]})
    foreign.confirm_indexes()
    abc.confirm_indexes()
    assert len(abc.get_indexes()) == 3
    abc.drop_indexes()
    assert len(abc.get_indexes()) == 1
    foreign.indexes = {"theirs": ["B"]}
    foreign.confirm_indexes()
    foreign.indexes = {"theirs": ["c"]}
    with pytest.raises(ValueError, match="covers b"):
        foreign.confirm_indexes()
    late = Table(store, "late", ABC, ["a"], {"bad": ["zzz"]})
    with pytest.raises(ValueError, match="no such column"):
        late.create_table()
    assert late.table_exists() and not late._adding
    late.indexes = {"good": ["c"]}
    late.add_indexes()
    assert len(late.get_indexes()) == 1


def test_constraints(spark, store):
    t = Table(store, "t", ABC)
    t.insert_data(frame(spark, [("x", 1, 1.0), ("x", 2, 1.0)]))
    with pytest.raises(ValueError, match="duplicate key"):
        t.add_constraint(["a"])
    assert t.keys == []
    t.add_constraint(["a", "b"])
    assert t._newest().keys == ("a", "b")
    t.drop_constraint()
    assert t._newest().keys == () and t.keys == []


def test_catalogue(spark, store, abc):
    assert [(f.name, f.dataType.simpleString()) for f in get_table_names_and_info(store).schema] == [("table_name", "string"), ("nrow", "bigint"), ("size_total_gb", "double"), ("size_data_gb", "double"), ("size_index_gb", "double")]
    assert store.table_info().count() == 0
    Table(store, "sqlite_like", ABC).create_table()
    abc.insert_data(frame(spark, [("x", 1, 1.0), ("y", 1, 1.0), ("z", 1, 1.0)]))
    got = store.table_info().collect()
    assert [(r["table_name"], r["nrow"]) for r in got] == [("sqlite_like", 0), ("tab", 3)] and got[1]["size_total_gb"] > 0
    assert abc.nrow() == abc.nrow(use_count=True) == 3 and abc.head(2).count() == 2
    inside = Store(spark, store.config["root"], schema="anon")
    assert inside.table_info().count() == 0


def test_shared_store_and_removal(spark, store, abc):
    abc.connect()
    abc.disconnect()
    assert store.is_connected()  # a borrower leaves it open
    owner = Table(store, "own", ABC, owns_store=True)
    owner.connect()
    owner.disconnect()
    owner.disconnect()
    assert not store.is_connected() and store.connection is None and spark.range(3).count() == 3
    abc.insert_data(frame(spark, [("x", 1, 1.0)]))
    assert store.is_connected()
    abc.remove_table()
    assert not abc.table_exists()
    abc.insert_data(frame(spark, [("x", 1, 2.0)]))
    assert rows(abc) == [("x", 1, 2.0)]


def test_handles_of_another_process_are_put_aside(spark, store, monkeypatch):
    store.connect()
    handle = store.connection
    monkeypatch.setattr(os, "getpid", lambda pid=os.getpid(): pid + 1)
    assert not store.is_connected() and store.connection is None
    assert store.autoconnection is not handle and store.parked == [handle]


def test_connect_retries(spark, tmp_path, monkeypatch):
    slept, calls = [], []
    monkeypatch.setattr(stores.time, "sleep", slept.append)
    s = Store(spark, str(tmp_path))
    monkeypatch.setattr(s, "connect_once", lambda: (_ for _ in ()).throw(ConnectionError("down")))
    assert set_auth_hook(lambda: calls.append(1)) is None and get_auth_hook() is not None
    with pytest.raises(ConnectionError, match="after 3 attempts"):
        s.connect(attempts=3)
    assert slept == [1, 2] and calls == [1]
    with pytest.raises(TypeError):
        set_auth_hook("no")
    assert set_auth_hook(None) is not None and get_auth_hook() is None


def test_shown_forms(spark, tmp_path, abc):
    s = Store(spark, str(tmp_path / "p"), password="secret", server="db")
    assert "******" in repr(s) and "secret" not in repr(s) and "disconnected" in repr(s)
    assert "1: a TEXT (KEY)" in repr(abc) and "3: c DOUBLE" in repr(abc)
    assert abc.print_dplyr_select() == ".select(\n    'a',\n    'b',\n    'c',\n)"
    with pytest.raises(TypeError):
        Store(spark, "x", colour="red")
    with pytest.raises(ValueError, match="field_types not validated in t"):
        Table(s, "t", ABC, validator_field_types=lambda _: False)


def test_censors_and_lists(spark, store):
    t = Table(store, "t", ABC, ["a"], censors=[lambda d: d.withColumn("c", F.lit(0.0))])
    t.insert_data([("x", 1, 5.0)])
    assert rows(t) == [("x", 1, 0.0)]


def test_stream_into_a_table(spark, store, abc, tmp_path):
    source = tmp_path / "in"
    frame(spark, [("x", 1, 1.0), ("x", 1, 2.0), ("y", 1, 3.0)]).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        stream_into(spark.readStream.schema("a string, b long, c double").parquet(str(source)), abc, str(tmp_path / "cp"), order_by=["c"]).awaitTermination()
        assert rows(abc) == [("x", 1, 2.0), ("y", 1, 3.0)]
