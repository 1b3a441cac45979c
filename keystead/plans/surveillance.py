"""The surveillance data set: daily counts by place, their weeks, rates, and labels, in 18 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import calendar, replace_first_match, sum_or_null
from ..functions.validators import TYPES_V1
from ..sources.shared import scratch
from ..sources.store import Store
from ..table import Table

MEASURES = {"cases_n": "INTEGER", "cases_pr100000": "DOUBLE"}
KEYS = ["granularity_time", "location_code", "date", "age", "sex"]


def prepare(daily: DataFrame, people: DataFrame) -> DataFrame:
    """The data set from daily (location_code, date as text, cases_n) and people (location_code, pop).

    Daily rows and the sums of each ISO week, on the week's Monday, below each other; a count that is
    null makes its week null. The rate is for each 100,000 people, null where nobody is known. A location
    `county...` counts as a county, all others as the nation, and their codes get the country's ending."""
    constants = {"granularity_geo": F.when(F.col("location_code").startswith("county"), F.lit("county")).otherwise(F.lit("nation")), "country_iso3": F.lit("nor"), "border": F.lit(2020).cast("long"), "age": F.lit("total"), "sex": F.lit("total")}
    days = daily.select("location_code", F.to_date("date").alias("date"), F.col("cases_n").cast("long").alias("cases_n")).withColumns(constants)
    weeks = days.groupBy("location_code", *constants, F.date_trunc("week", "date").cast("date").alias("date")).agg(sum_or_null(F.col("cases_n")).alias("cases_n"))
    both = days.withColumn("granularity_time", F.lit("date")).unionByName(weeks.withColumn("granularity_time", F.lit("isoyearweek")))
    rated = calendar(both).join(people, "location_code", "left").withColumn("cases_pr100000", F.when(F.col("pop") > 0, 100_000 * F.col("cases_n") / F.col("pop")))
    code = replace_first_match(F.col("location_code"), "^(county|nation)?", "$1_nor_")
    return rated.withColumn("location_code", code).select(*TYPES_V1, *MEASURES)


def surveillance_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set of events, through a validated, keyed table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = F.when(F.col("event_type") == "click", F.lit("county03")).otherwise(F.col("event_type")).alias("location_code")
    daily = events.groupBy(place, F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("cases_n"))
    people = events.groupBy(place).agg(F.count_distinct("user_id").alias("pop")).where("location_code <> 'error'")
    table = Table(Store(spark, scratch(spark)), "cases", TYPES_V1 | MEASURES, KEYS, {"ind1": ["granularity_time", "location_code", "date"]})
    table.insert_data(prepare(daily, people))
    return table.tbl().withColumn("date", F.col("date").cast("string"))


SQL = """
WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'county03' ELSE event_type END AS p, CAST(ts AS DATE) AS d, user_id FROM events),
people AS (SELECT p, count(DISTINCT user_id) AS pop FROM e WHERE p <> 'error' GROUP BY p),
c AS (SELECT 'date' AS granularity_time, p, d, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'isoyearweek', p, CAST(date_trunc('week', d) AS DATE) AS d, count(*) FROM e GROUP BY ALL),
y AS (SELECT *, CAST(isoyear(d) AS BIGINT) AS isoyear, CAST(week(d) AS BIGINT) AS isoweek, CASE WHEN week(d) >= 30 THEN isoyear(d) ELSE isoyear(d) - 1 END AS begins FROM c LEFT JOIN people USING (p))
SELECT granularity_time, CASE WHEN p LIKE 'county%' THEN 'county' ELSE 'nation' END AS granularity_geo, 'nor' AS country_iso3, CASE WHEN p LIKE 'county%' THEN 'county_nor_' || substr(p, 7) ELSE '_nor_' || p END AS location_code,
  CAST(2020 AS BIGINT) AS border, 'total' AS age, 'total' AS sex, isoyear, isoweek, CAST(isoyear AS VARCHAR) || '-' || lpad(CAST(isoweek AS VARCHAR), 2, '0') AS isoyearweek, CAST(begins AS VARCHAR) || '/' || CAST(begins + 1 AS VARCHAR) AS season,
  CAST(CASE WHEN isoweek >= 30 THEN isoweek - 29 ELSE isoweek + week(make_date(begins, 12, 28)) - 29 END AS DOUBLE) AS seasonweek, CAST(year(d) AS BIGINT) AS calyear, CAST(month(d) AS BIGINT) AS calmonth, strftime(d, '%Y-M%m') AS calyearmonth,
  CAST(d AS VARCHAR) AS date, CAST(n AS BIGINT) AS cases_n, CASE WHEN pop > 0 THEN 100000 * CAST(n AS DOUBLE) / pop END AS cases_pr100000 FROM y
"""
