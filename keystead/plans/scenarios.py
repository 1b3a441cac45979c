"""Queries that go through the table interface step by step: what each step leaves, as rows.

The SQL of a step that only declares something is a list of the values that the interface promises; rows
and counts are worked out from the input tables.
"""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms, validators
from ..naming import index_physical_name
from ..sources.shared import scratch
from ..sources.store import Store, get_auth_hook, set_auth_hook
from ..streaming.sink import stream_into
from ..table import Table
from . import surveillance
from .catalogue import _ALL, _BASE, _DELTA, _THREE, _base, _delta, _orders, _query, _table

# the physical name of an index: sha1 makes the UUID of a name, whose 13th digit is its version
_KNOWN = "'1:1' || length(t) || ':' || t || length(i) || ':' || i"
_SHA = f"sha1(unhex('3f2a6c1e7d544b989a0f6c5d2e8b41a7') || encode({_KNOWN}))"
_PHYSICAL = f"'ix_' || ltrim(right(trim(regexp_replace(lower(t || '_' || i), '[^a-z0-9]+', '_', 'g'), '_'), 43), '_') || '_' || substr({_SHA}, 1, 12) || '5' || substr({_SHA}, 14, 3)"
_VALUES = ", ".join(f"('{t}', '{i}')" for t in _ALL for i in ("ind1", "by.date", "an_index_whose_name_is_much_longer_than_a_name_may_be"))


@_query(f"SELECT t AS table_name, i AS index_name, {_PHYSICAL} AS physical_name FROM (VALUES {_VALUES}) AS x(t, i)")
def index_physical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical names of indexes on every table."""
    indexes = ("ind1", "by.date", "an_index_whose_name_is_much_longer_than_a_name_may_be")
    return spark.createDataFrame([(t, i, index_physical_name(t, i)) for t in _ALL for i in indexes], "table_name string, index_name string, physical_name string")


def _said(action) -> str:
    """done, or the kind of the error."""
    try:
        action()
    except Exception as e:
        return type(e).__name__
    return "done"


_INDEXES = "('by_customer', 'o_custkey'), ('by.price', 'o_totalprice,o_custkey')"


@_query(
    f"WITH n AS (SELECT i, c, 'orders' AS t FROM (VALUES {_INDEXES}) AS x(i, c)), own AS (SELECT {_PHYSICAL} AS physical, c AS columns FROM n), theirs AS (SELECT {_PHYSICAL} AS physical, 'o_orderkey' AS columns FROM (SELECT 'orders' AS t, 'theirs' AS i)) "
    "SELECT 'created' AS step, * FROM own UNION ALL SELECT 'added again', * FROM own UNION ALL SELECT 'dropped', 'none', '' UNION ALL SELECT 'confirmed', * FROM own UNION ALL SELECT 'with foreign', * FROM own UNION ALL SELECT 'with foreign', * FROM theirs "
    "UNION ALL SELECT 'own dropped', * FROM theirs UNION ALL SELECT 'other columns', 'ValueError', '' UNION ALL SELECT 'no such column', 'ValueError', '' UNION ALL SELECT 'upper case', 'done', ''"
)
def table_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declare, add, drop and confirm indexes; those of others are left."""
    store, out = Store(spark, scratch(spark)), []
    declared = {"by_customer": ["o_custkey"], "by.price": ["o_totalprice", "o_custkey"]}

    def note(step: str) -> None:
        found = [(step, n, ",".join(table.get_index_columns(n))) for n in table.get_indexes()]
        out.extend(found or [(step, "none", "")])

    table = Table(store, "orders", _THREE, ["o_orderkey"], declared)
    table.insert_data(_base(spark, sf_dir))
    note("created")
    table.add_indexes()
    note("added again")
    table.drop_indexes()
    note("dropped")
    table.confirm_indexes()
    note("confirmed")
    Table(store, "orders", _THREE, ["o_orderkey"], {"theirs": ["o_orderkey"]}).confirm_indexes()
    table.confirm_indexes()
    note("with foreign")
    table.drop_indexes()
    note("own dropped")
    table.confirm_indexes()
    for step, columns in (("other columns", ["o_orderkey"]), ("no such column", ["nope"]), ("upper case", ["O_CUSTKEY"])):
        name = "missing" if columns == ["nope"] else "by_customer"
        out.append((step, _said(Table(store, "orders", _THREE, ["o_orderkey"], {name: columns}).confirm_indexes), ""))
    return spark.createDataFrame(out, "step string, physical string, columns string")


@_query("SELECT count(*) AS counted, count(*) AS listed, count(*) AS in_info, least(6, count(*)) AS in_head FROM orders")
def table_nrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by counting, by the catalogue, and in the first six."""
    table = _orders(spark, _THREE)
    table.insert_data(_base(spark, sf_dir))
    rows = [(table.nrow(use_count=True), table.nrow(), table.info().first()["nrow"], table.head().count())]
    return spark.createDataFrame(rows, "counted long, listed long, in_info long, in_head long")


@_query("SELECT r_regionkey, r_name FROM region")
def table_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table that has fewer."""
    table = Table(Store(spark, scratch(spark)), "region", {"r_regionkey": "INTEGER", "r_name": "TEXT"}, ["r_regionkey"])
    table.insert_data(_table(spark, sf_dir, "region"))
    return table.head()


_STEPS = "UNION ALL SELECT"


@_query(
    f"SELECT 'made' AS step, false AS there, CAST(0 AS BIGINT) AS n {_STEPS} 'connected', true, 0 {_STEPS} 'loaded', true, (SELECT count(*) FROM orders) {_STEPS} 'declared alike', true, (SELECT count(*) FROM orders) "
    f"{_STEPS} 'removed', false, 0 {_STEPS} 'written again', true, (SELECT count(*) FROM orders) {_STEPS} 'other order', true, 0 {_STEPS} 'nothing written', true, 0"
)
def table_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made, connected, loaded, removed and made anew."""
    store, out = Store(spark, scratch(spark)), []
    table, rows = Table(store, "orders", _THREE, ["o_orderkey"]), _base(spark, sf_dir)
    note = lambda step, t: out.append((step, there := t.table_exists(), t.nrow() if there else 0))
    note("made", table)
    table.connect()
    note("connected", table)
    table.insert_data(rows)
    note("loaded", table)
    note("declared alike", Table(store, "orders", _THREE, ["o_orderkey"]).connect())
    table.remove_table()
    note("removed", table)
    table.insert_data(rows)
    note("written again", table)
    other = Table(store, "orders", dict(sorted(_THREE.items())), ["o_orderkey"]).connect()
    note("other order", other)
    other.insert_data(rows.limit(0))
    other.upsert_data(None)
    note("nothing written", other)
    return spark.createDataFrame(out, "step string, there boolean, n long")


_N = "(SELECT count(*) FROM orders)"


@_query(
    f"SELECT 'nothing' AS step, 'ValueError' AS said, {_N} AS n {_STEPS} 'no frame', 'TypeError', {_N} {_STEPS} 'missing column', 'ValueError', {_N} {_STEPS} 'refused by the validator', 'ValueError', {_N} {_STEPS} 'repeated keys', 'ValueError', {_N} "
    f"{_STEPS} 'null key', 'ValueError', {_N} {_STEPS} 'truthy validator', 'ValueError', {_N} {_STEPS} 'good rows', 'done', (SELECT count(*) FROM {_DELTA}) {_STEPS} 'no rows', 'done', 0"
)
def table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guarded reload refuses leaves every row there."""
    out = []

    def strict(d: DataFrame):
        fine = "o_totalprice" in d.columns and d.where("o_totalprice < 0").isEmpty()
        return True if fine else validators.ValidationResult(False, "o_totalprice")

    table = _orders(spark, _THREE, validator_field_contents=strict)
    base, delta = _base(spark, sf_dir), _delta(spark, sf_dir)
    table.insert_data(base)

    def attempt(step: str, rows, validator=strict) -> None:
        table.validator_field_contents = validator
        for load in (table.drop_all_rows_and_then_insert_data, table.drop_all_rows_and_then_upsert_data):
            said = _said(lambda: load(rows))
        out.append((step, said, table.nrow(use_count=True)))

    attempt("nothing", None)
    attempt("no frame", "rows")
    attempt("missing column", delta.drop("o_totalprice"))
    attempt("refused by the validator", delta.withColumn("o_totalprice", -F.col("o_totalprice")))
    attempt("repeated keys", delta.unionByName(delta))
    attempt("null key", delta.withColumn("o_orderkey", F.lit(None).cast("long")))
    attempt("truthy validator", delta, lambda d: 1)
    attempt("good rows", delta)
    attempt("no rows", delta.limit(0))
    return spark.createDataFrame(out, "step string, said string, n long")


@_query(
    f"SELECT 'key that repeats' AS step, 'ValueError' AS said, '' AS keys, {_N} AS n {_STEPS} 'key', 'done', 'o_orderkey', {_N} {_STEPS} 'rows that are there', 'ValueError', 'o_orderkey', {_N} {_STEPS} 'dropped', 'done', '', {_N} {_STEPS} 'rows twice', 'done', '', 2 * {_N} {_STEPS} 'key again', 'ValueError', '', 2 * {_N}"
)
def table_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary key that is added, enforced, dropped, and can't come back."""
    table, base, out = Table(Store(spark, scratch(spark)), "orders", _THREE), _base(spark, sf_dir), []
    table.insert_data(base)
    note = lambda step, action: out.append((step, _said(action), ",".join(table.keys), table.nrow()))
    note("key that repeats", lambda: table.add_constraint(["o_custkey"]))
    note("key", lambda: table.add_constraint(["o_orderkey"]))
    note("rows that are there", lambda: table.insert_data(base))
    note("dropped", table.drop_constraint)
    note("rows twice", lambda: table.insert_data(base))
    note("key again", lambda: table.add_constraint(["o_orderkey"]))
    return spark.createDataFrame(out, "step string, said string, keys string, n long")


@_query(f"SELECT 'compacted' AS step, {_N} AS n, true AS apart {_STEPS} 'upserted', (SELECT count(*) FROM ({_BASE} UNION SELECT * FROM {_DELTA} WHERE o_orderkey < 0)), true {_STEPS} 'reader', {_N}, true {_STEPS} 'vacuumed', (SELECT count(*) FROM ({_BASE} UNION SELECT * FROM {_DELTA} WHERE o_orderkey < 0)), true")
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout by key range, a change beside a reader of the version before, and removal of old versions."""
    table, out = Table(Store(spark, scratch(spark), file_bytes=64 << 10), "orders", _THREE, ["o_orderkey"]), []
    note = lambda step, n: out.append((step, n, not any(s.overlaps() for s in table._newest().segments[:1])))
    table.insert_data(_base(spark, sf_dir))
    table.compact()
    note("compacted", table.nrow(use_count=True))
    reader = table.tbl()
    table.upsert_data(_delta(spark, sf_dir))
    note("upserted", table.nrow(use_count=True))
    note("reader", reader.count())
    table.vacuum(0)
    note("vacuumed", table.nrow(use_count=True))
    return spark.createDataFrame(out, "step string, n long, apart boolean")


@_query(
    "SELECT * FROM (VALUES ('new', false, false), ('connected', true, true), ('connected again', true, true), ('disconnected', false, false), ('disconnected again', false, false), ('used', true, true), ('shared table closed', true, true), ('owner closed', false, false), ('hook set', true, false), ('hook taken away', false, false)) AS x(step, one, two)"
)
def store_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection states (connected, handle there), and the hook (set, one before)."""
    store, out = Store(spark, scratch(spark)), []
    note = lambda step: out.append((step, store.is_connected(), store.connection is not None))
    note("new")
    store.connect()
    note("connected")
    store.connect()
    note("connected again")
    store.disconnect()
    note("disconnected")
    store.disconnect()
    note("disconnected again")
    table = Table(store, "region", {"r_regionkey": "INTEGER", "r_name": "TEXT"}, ["r_regionkey"])
    table.insert_data(_table(spark, sf_dir, "region"))
    note("used")
    table.disconnect()
    note("shared table closed")
    Table(store, "region", {"r_regionkey": "INTEGER", "r_name": "TEXT"}, ["r_regionkey"], owns_store=True).disconnect()
    note("owner closed")
    held = set_auth_hook(None)
    out.append(("hook set", (set_auth_hook(lambda: None), get_auth_hook())[1] is not None, False))
    set_auth_hook(None)
    out.append(("hook taken away", get_auth_hook() is not None, False))
    set_auth_hook(held)
    return spark.createDataFrame(out, "step string, one boolean, two boolean")


_BRANCHES = {
    # case: (fields that differ from a good row, what version 1 says, what version 2 says)
    "good": ({}, None, None), "time": ({"granularity_time": "fortnight"}, "granularity_time", "granularity_time"), "no time": ({"granularity_time": None}, "granularity_time", "granularity_time"),
    "season": ({"granularity_time": "season"}, "granularity_time", None), "event": ({"granularity_time": "event_x"}, None, None), "event inside": ({"granularity_time": "my_event"}, "granularity_time", "granularity_time"),
    "area": ({"granularity_geo": "parish"}, "granularity_geo", "granularity_geo"), "region": ({"granularity_geo": "region"}, None, "granularity_geo"), "border": ({"border": 1999}, "border", "border"), "border 2024": ({"border": 2024}, None, None),
    "sex": ({"sex": "other"}, "sex", "sex"), "sex missing": ({"sex": "missing"}, None, "sex"), "two bad": ({"sex": "other", "granularity_geo": "parish"}, "granularity_geo", "granularity_geo"),
}
_SAID = ", ".join(f"({v}, '{case}', {'true' if x[v] is None else 'false'}, {'NULL' if x[v] is None else repr(x[v])})" for case, x in _BRANCHES.items() for v in (1, 2))
_MORE = ", ".join(f"({v}, '{case}', {str(ok).lower()}, {'NULL' if ok else repr('date')})" for v in (1, 2) for case, ok in (("no rows", True), ("columns missing", True), ("date a time", False), ("no date", False)))


@_query(f"SELECT CAST(version AS BIGINT) AS version, step, ok, CAST(var AS VARCHAR) AS var FROM (VALUES {_SAID}, {_MORE}) AS x(version, step, ok, var)")
def validator_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of both contents validators, one bad row among the daily counts of events."""
    good = {"granularity_time": "date", "granularity_geo": "nation", "border": 2020, "sex": "total"}
    rows = _table(spark, sf_dir, "events").select(*[F.lit(v).alias(k) for k, v in good.items()], F.to_date("ts").alias("date"))
    checks, out = {1: validators.field_contents_v1, 2: validators.field_contents_v2}, []
    frames = {}
    for case, (changed, _, _) in _BRANCHES.items():
        one = spark.createDataFrame([(*(changed.get(k, v) for k, v in good.items()), dt.date(2024, 1, 1))], "granularity_time string, granularity_geo string, border int, sex string, date date")
        frames[case] = rows.unionByName(one)
    frames |= {"no rows": rows.limit(0), "columns missing": rows.drop("sex", "border"), "date a time": rows.withColumn("date", F.col("date").cast("timestamp")), "no date": rows.drop("date")}
    for version, check in checks.items():
        for case, frame in frames.items():
            said = check(frame)
            out.append((version, case, said.ok, said.var))
    return spark.createDataFrame(out, "version long, step string, ok boolean, var string")


@_query(
    "SELECT * FROM (VALUES ('as they are', true, true), ('more behind', true, true), ('too few', false, false), ('other order', false, false), ('another type', false, false), ('of the other version', false, false), ('no names', false, false), ('blank', true, true)) AS x(step, v1, v2)"
)
def validator_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validators of declared columns of both versions."""
    own = {1: validators.TYPES_V1, 2: validators.TYPES_V2}
    checks = {1: validators.field_types_v1, 2: validators.field_types_v2}
    items = {v: list(t.items()) for v, t in own.items()}
    cases = {
        "as they are": lambda v: own[v], "more behind": lambda v: own[v] | {"cases_n": "INTEGER"}, "too few": lambda v: dict(items[v][:-1]), "other order": lambda v: dict([items[v][1], items[v][0], *items[v][2:]]),
        "another type": lambda v: own[v] | {"border": "TEXT"}, "of the other version": lambda v: own[3 - v], "no names": lambda v: list(own[v]),
    }
    out = [(case, *[bool(checks[v](make(v))) for v in (1, 2)]) for case, make in cases.items()]
    out.append(("blank", bool(validators.field_types_blank(None)), bool(validators.field_contents_blank(None))))
    return spark.createDataFrame(out, "step string, v1 boolean, v2 boolean")


# --- what a lazy read of stored tables reaches --------------------------------


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables of one store, read lazily."""
    store, kinds = Store(spark, scratch(spark)), {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "DATETIME"}
    out = []
    for name in names:
        rows = _table(spark, sf_dir, name)
        table = Table(store, name, {c: kinds[k] for c, k in rows.dtypes})
        table.insert_data(rows)
        out.append(table.tbl())
    return out


@_query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def tbl_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = _stored(spark, sf_dir, "customer", "nation", "region")
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@_query("SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def tbl_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = _stored(spark, sf_dir, "customer", "supplier")
    a, b = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").union(a.subtract(b).select(F.lit("customers only").alias("kind"), "k"))


@_query("SELECT 'cube' AS kind, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) UNION ALL SELECT 'rollup', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def tbl_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _stored(spark, sf_dir, "orders")
    by, n = ("o_orderstatus", "o_orderpriority"), F.count(F.lit(1)).alias("n")
    return orders.cube(*by).agg(n).select(F.lit("cube").alias("kind"), *by, "n").union(orders.rollup(*by).agg(n).select(F.lit("rollup").alias("kind"), *by, "n"))


@_query(r"SELECT event_id FROM events WHERE event_type || '_' || CAST(user_id AS VARCHAR) LIKE 'click\_1%' ESCAPE '\'")
def tbl_like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _stored(spark, sf_dir, "events")
    return events.where(r"concat(event_type, '_', user_id) LIKE 'click\\_1%' ESCAPE '\\'").select("event_id")


# --- servers, streams, numbers in texts, the surveillance data --------------------


@_query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey > 10")
def server_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to a database server and read from it; the filter is the server's work."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="keystead-"))  # the server's own disk: no task opens it on a cluster
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    store = Store(spark, scratch(spark), driver=f"jdbc:derby:{folder}/round_trip;create=true")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("inf")))
    store.copy_to_server(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", balance.alias("c_acctbal")), "customer", mode="overwrite")
    return store.server_tbl('(SELECT * FROM customer WHERE "c_custkey" > 10) x')


@_query("SELECT event_id, event_type, value FROM events")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, each sent twice, upserted into a table."""
    folder = scratch(spark)
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.union(events).write.parquet(f"{folder}/in")
    table = Table(Store(spark, f"{folder}/store"), "events", {"event_id": "INTEGER", "event_type": "TEXT", "value": "DOUBLE"}, ["event_id"])
    stream_into(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), table, f"{folder}/offsets", order_by=["value"]).awaitTermination()
    return table.tbl()


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE round(p_size * 1000 / 1024.0 / 1024.0, 2) END AS gb FROM part")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in texts, such as `12000 KB`, as rounded gigabytes."""
    text = F.when(F.col("p_size") % 3 == 0, F.lit("unknown")).otherwise(F.concat((F.col("p_size") * 1000).cast("string"), F.lit(" KB")))
    return _table(spark, sf_dir, "part").select("p_partkey", transforms.number_in_text(text, scale=1 / 1024 / 1024, digits=2).alias("gb"))


@_query("SELECT n_name, r_name, total - coalesce(own, 0) AS rest FROM (SELECT n_name, n_regionkey, count(*) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) LEFT JOIN (SELECT r_regionkey, r_name FROM region WHERE r_name <> 'ASIA') ON r_regionkey = n_regionkey LEFT JOIN (SELECT n_name AS k, count(*) AS own FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) ON k = n_name")
def derived_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total less its part, with names from a catalogue that lacks some."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    n = F.count(F.lit(1))
    total = nation.join(_table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey").agg(n.alias("total"))
    own = nation.join(_table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("k")).agg(n.alias("own"))
    out = total.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(own, F.col("k") == F.col("n_name"), "left")
    return out.select("n_name", "r_name", (F.col("total") - F.coalesce("own", F.lit(0))).alias("rest"))


@_query("SELECT p_partkey, regexp_replace(p_type, '[A-M]+[AEIOU]', '<>') AS p_type FROM part")
def recode_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first finding of a pattern is replaced."""
    return _table(spark, sf_dir, "part").select("p_partkey", transforms.replace_first_match(F.col("p_type"), "[A-M]+[AEIOU]", "<>").alias("p_type"))


_query(surveillance.SQL)(surveillance.surveillance_data)
