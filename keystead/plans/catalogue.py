"""The queries of the table engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms, validators
from ..operators import dml
from ..sources.shared import scratch
from ..sources.staging import read_delimited, write_delimited
from ..sources.store import Store
from ..table import Table
from . import weekly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ORDERS = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "TEXT", "o_totalprice": "DOUBLE", "o_orderdate": "DATETIME", "o_orderpriority": "TEXT"}


def _query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose price is null where the status is P."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))


_PRICES = "(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders at twice the price, and pending ones under new keys."""
    orders = _table(spark, sf_dir, "orders")
    changed = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return changed.unionByName(orders.where("o_orderstatus = 'P'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", "o_totalprice"))


_BASE = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"
_DELTA = "(SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT -o_orderkey - 1, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')"
_UPSERTED = f"SELECT * FROM {_DELTA} UNION ALL SELECT * FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_DELTA} d WHERE d.o_orderkey = b.o_orderkey)"
_THREE = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_totalprice": "DOUBLE"}


def _orders(spark: SparkSession, columns: dict[str, str], **more) -> Table:
    """A table of orders in a store of its own."""
    return Table(Store(spark, scratch(spark)), "orders", columns, ["o_orderkey"], {"by_customer": ["o_custkey"]}, **more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declare orders, load them, upsert a delta, sum by status and ISO week."""
    orders = _table(spark, sf_dir, "orders")
    table = _orders(spark, ORDERS)
    table.insert_data(orders)
    table.upsert_data(orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    rows = transforms.calendar(table.tbl().withColumn("date", F.to_date("o_orderdate")))
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("o_orderstatus", "isoyearweek").agg(F.count(F.lit(1)).alias("n"), price.alias("price"))


_query(
    "SELECT o_orderstatus, CAST(isoyear(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS isoyearweek, count(*) AS n, "
    "CAST(sum(CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders GROUP BY ALL"
)(flagship)


# --- tables: declare, write, read ---------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def table_insert_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk insert under a primary key, and a lazy read."""
    table = _orders(spark, ORDERS)
    table.insert_data(_table(spark, sf_dir, "orders"))
    return table.tbl().withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@_query(_UPSERTED)
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert into a stored table; only touched segments are rewritten."""
    table = _orders(spark, _THREE)
    table.insert_data(_base(spark, sf_dir))
    table.upsert_data(_delta(spark, sf_dir))
    return table.tbl()


@_query(f"SELECT * FROM {_DELTA}")
def table_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded truncate and load, in one commit."""
    table = _orders(spark, _THREE)
    table.insert_data(_base(spark, sf_dir))
    table.drop_all_rows_and_then_upsert_data(_delta(spark, sf_dir))
    return table.tbl()


@_query(f"SELECT * FROM {_DELTA}")
def table_reload_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with insert."""
    table = _orders(spark, _THREE)
    table.insert_data(_base(spark, sf_dir))
    table.drop_all_rows_and_then_insert_data(_delta(spark, sf_dir))
    return table.tbl()


@_query(f"SELECT * FROM {_PRICES} WHERE price > 100000 AND (o_orderkey < 5000) IS NOT TRUE")
def table_keep_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional keep, then conditional delete, in a stored table."""
    table = Table(Store(spark, scratch(spark)), "prices", {"o_orderkey": "INTEGER", "o_orderstatus": "TEXT", "price": "DOUBLE"}, ["o_orderkey"])
    table.insert_data(_prices(spark, sf_dir))
    table.keep_rows_where("price > 100000")
    table.drop_rows_where("o_orderkey < 5000")
    return table.tbl()


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE false")
def table_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncate: the table stays, without rows."""
    table = _orders(spark, _THREE)
    table.insert_data(_base(spark, sf_dir))
    table.drop_all_rows()
    return table.tbl()


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE false")
def table_create_on_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with other columns than declared is made anew and empty."""
    store = Store(spark, scratch(spark))
    Table(store, "orders", _THREE, ["o_orderkey"]).insert_data(_base(spark, sf_dir))
    return Table(store, "orders", {k: _THREE[k] for k in ("o_custkey", "o_orderkey", "o_totalprice")}, ["o_orderkey"]).tbl()


_ALL = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS nrow, count(*) > 0 AS has_bytes, true AS adds_up, 0.0::DOUBLE AS size_index_gb FROM {t}" for t in _ALL))
def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, rows and sizes of all tables of a store."""
    store = Store(spark, scratch(spark))
    for t in _ALL:
        rows = _table(spark, sf_dir, t)
        kinds = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "DATETIME"}
        Table(store, t, {c: kinds[k] for c, k in rows.dtypes}).insert_data(rows)
    adds_up = F.col("size_total_gb") == F.col("size_data_gb") + F.col("size_index_gb")
    return store.table_info().select("table_name", "nrow", (F.col("size_total_gb") > 0).alias("has_bytes"), adds_up.alias("adds_up"), "size_index_gb")


@_query("SELECT c_custkey, c_name, c_acctbal, c_acctbal > 0 AS in_credit FROM customer")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as delimited text and read by a declared schema."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("in_credit"))
    write_delimited(rows, path := scratch(spark))
    return read_delimited(spark, path, rows.schema)


# --- changes as plans -----------------------------------------------------------


@_query(f"SELECT * FROM {_PRICES} WHERE price > 100000")
def keep_rows_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null conditions go."""
    return dml.keep_where(_prices(spark, sf_dir), "price > 100000")


@_query(f"SELECT * FROM {_PRICES} WHERE (price > 100000) IS NOT TRUE")
def drop_rows_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null conditions stay."""
    return dml.drop_where(_prices(spark, sf_dir), "price > 100000")


@_query(_UPSERTED)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(_base(spark, sf_dir), _delta(spark, sf_dir), ["o_orderkey"])


@_query(f"WITH b AS (SELECT o_orderkey, o_custkey FROM orders), d AS (SELECT o_orderkey, o_custkey FROM {_DELTA}) SELECT * FROM b UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = d.o_orderkey AND b.o_custkey = d.o_custkey)")
def upsert_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column is a key: nothing is updated."""
    keys = ["o_orderkey", "o_custkey"]
    return dml.upsert(_base(spark, sf_dir).select(*keys), _delta(spark, sf_dir).select(*keys), keys)


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated keys the last row by a stated order."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dml.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def primary_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_totalprice END AS price FROM orders")
def scrub_non_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite and undefined prices become null."""
    status = F.col("o_orderstatus")
    price = F.when(status == "F", F.lit(float("inf"))).when(status == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return transforms.scrub_non_finite(_table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")))


@_query("SELECT count(*) AS n FROM lineitem")
def count_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT count(CASE WHEN l_quantity > 25 THEN 1 END) AS n FROM lineitem")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.count_where(_table(spark, sf_dir, "lineitem"), "l_quantity > 25")


# --- validation -------------------------------------------------------------------


@_query("SELECT DISTINCT event_type AS value FROM events WHERE event_type NOT IN ('click', 'view')")
def contents_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside of a set."""
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").where(~validators.is_one_of(kind, ("click", "view"))).select(kind.alias("value")).distinct()


@_query("SELECT event_type, CAST(event_type LIKE '%date%' OR event_type LIKE '%isoyear%' OR event_type LIKE 'event%' OR event_type LIKE '%total%' AS BOOLEAN) AS fits, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT 'event_' || event_type FROM events UNION ALL SELECT 'up' || 'date' FROM events) GROUP BY ALL")
def granularity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time labels that match a pattern of the format."""
    kinds = _table(spark, sf_dir, "events").select("event_type")
    rows = kinds.union(kinds.select(F.concat(F.lit("event_"), "event_type"))).union(kinds.select(F.lit("update")))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("fits", validators.time_matches(F.col("event_type")))


_SURVEY = "SELECT CASE event_type WHEN 'click' THEN 'date' WHEN 'view' THEN 'event_view' ELSE event_type END AS granularity_time, 'nation' AS granularity_geo, 2020 AS border, CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'total' END AS sex FROM events"


@_query(
    f"WITH d AS ({_SURVEY}) SELECT (SELECT count(*) FROM d WHERE NOT (granularity_time LIKE '%date%' OR granularity_time LIKE '%isoyear%' OR granularity_time LIKE 'event%' OR granularity_time LIKE '%total%')) AS bad_time, "
    "(SELECT count(*) FROM d WHERE sex NOT IN ('male', 'female', 'missing', 'total')) AS bad_sex_v1, (SELECT count(*) FROM d WHERE sex NOT IN ('male', 'female', 'total')) AS bad_sex_v2, "
    "(SELECT count(*) FROM d WHERE CAST(border AS VARCHAR) NOT IN ('2020', '2024')) AS bad_border, 'granularity_time' AS var_v1, 'granularity_time' AS var_v2"
)
def surveillance_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, and the field that the validators of both versions name."""
    kind = F.col("event_type")
    d = _table(spark, sf_dir, "events").select(
        F.when(kind == "click", F.lit("date")).when(kind == "view", F.lit("event_view")).otherwise(kind).alias("granularity_time"), F.lit("nation").alias("granularity_geo"), F.lit(2020).alias("border"),
        F.when(kind == "error", F.lit("unknown")).otherwise(F.lit("total")).alias("sex"), F.to_date("ts").alias("date"),
    )
    v1, v2 = validators.field_contents_v1(d).var, validators.field_contents_v2(d).var
    rules = {"bad_time": validators.time_matches(F.col("granularity_time")), "bad_sex_v1": validators.is_one_of(F.col("sex"), validators.SEXES_V1), "bad_sex_v2": validators.is_one_of(F.col("sex"), validators.SEXES_V2), "bad_border": validators.is_one_of(F.col("border"), validators.BORDERS)}
    return d.agg(*[F.count_if(~r).alias(k) for k, r in rules.items()]).withColumns({"var_v1": F.lit(v1), "var_v2": F.lit(v2)})


# --- data preparation -----------------------------------------------------------


_CALENDAR = (
    "isoyear, isoweek, CAST(isoyear AS VARCHAR) || '-' || lpad(CAST(isoweek AS VARCHAR), 2, '0') AS isoyearweek, CAST(least(4, ceil(isoweek / 13.0)) AS BIGINT) AS isoquarter, "
    "CAST(isoyear AS VARCHAR) || '-Q' || CAST(CAST(least(4, ceil(isoweek / 13.0)) AS BIGINT) AS VARCHAR) AS isoyearquarter, "
    "CAST(begins AS VARCHAR) || '/' || CAST(begins + 1 AS VARCHAR) AS season, CAST(CASE WHEN isoweek >= 30 THEN isoweek - 29 ELSE isoweek + week(make_date(begins, 12, 28)) - 29 END AS DOUBLE) AS seasonweek, "
    "CAST(year(ts) AS BIGINT) AS calyear, CAST(month(ts) AS BIGINT) AS calmonth, strftime(ts, '%Y-M%m') AS calyearmonth"
)


@_query(f"SELECT event_id, {_CALENDAR} FROM (SELECT event_id, ts, isoyear, isoweek, CASE WHEN isoweek >= 30 THEN isoyear ELSE isoyear - 1 END AS begins FROM (SELECT event_id, ts, CAST(isoyear(ts) AS BIGINT) AS isoyear, CAST(week(ts) AS BIGINT) AS isoweek FROM events))")
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calendar columns of a date."""
    return transforms.calendar(_table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))).drop("date")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("cases_n"))


_WEEK = "CAST(isoyear(ts) AS VARCHAR) || '-' || lpad(CAST(week(ts) AS VARCHAR), 2, '0')"


@_query(f"SELECT event_type, {_WEEK} AS isoyearweek, CAST(count(*) AS BIGINT) AS cases_n, 'isoyearweek' AS granularity_time FROM events GROUP BY ALL")
def weekly_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.weekly(_daily(spark, sf_dir), ["event_type"], ["cases_n"])


@_query(f"SELECT event_type, {_WEEK} AS isoyearweek, 'isoyearweek' AS granularity_time, CAST(count(*) AS BIGINT) AS cases_n FROM events GROUP BY ALL UNION ALL SELECT event_type, isoyearweek, 'date', n FROM (SELECT event_type, CAST(ts AS DATE) AS d, {_WEEK} AS isoyearweek, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)")
def daily_and_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row bind of daily and weekly rows, by name."""
    return weekly.daily_and_weekly(_daily(spark, sf_dir), ["event_type"], ["cases_n"])


@_query("SELECT n_nationkey, regexp_replace(n_name, 'N', 'M') AS n_name FROM nation")
def recode_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first finding is replaced."""
    return _table(spark, sf_dir, "nation").select("n_nationkey", transforms.replace_first(F.col("n_name"), "N", "M").alias("n_name"))


@_query("SELECT c_custkey, CASE WHEN m = 'BUILDINGS' THEN 'HOUSES' ELSE m END AS c_mktsegment FROM (SELECT c_custkey, regexp_replace(c_mktsegment, 'BUILDING', 'BUILDINGS') AS m FROM customer)")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.recode(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ("BUILDING", "BUILDINGS"), {"BUILDINGS": "HOUSES"})


@_query("SELECT DISTINCT lang, source FROM documents")
def distinct_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("lang", "source").distinct()


# --- what a lazy read reaches ------------------------------------------------------


@_query("SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def left_join_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@_query(r"SELECT event_id, name FROM (SELECT event_id, event_type || CASE WHEN value > 50 THEN '_' ELSE '-' END || CAST(user_id AS VARCHAR) AS name FROM events) WHERE name NOT LIKE 'click\_%' ESCAPE '\'")
def like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The underscore stands for itself."""
    name = F.concat("event_type", F.when(F.col("value") > 50, "_").otherwise("-"), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", name.alias("name")).where(r"name NOT LIKE 'click\\_%' ESCAPE '\\'")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(6).select("o_orderkey", "o_totalprice")


@_query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("r"))


@_query("SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return suppliers.unionByName(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))).select("name", "balance")


from . import scenarios  # noqa: E402, F401  registers its queries
