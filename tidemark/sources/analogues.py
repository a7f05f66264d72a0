"""The model's tables, derived from the supplied ones, and the same definitions as SQL.

Times are microseconds since 1970 in UTC, whatever the session's time zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1_706_659_200_000_000  # 2024-01-31 00:00:00
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
VALUES = {"click": "open", "view": "slow", "purchase": "congested", "error": "closed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State observations: (obs_id, place_id, kind, direction, value, t, source_id, modality)."""
    e = table(spark, sf_dir, "events")
    value = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in VALUES.items()], F.lit("other"))
    direction = F.when(F.col("event_id") % 3 == 0, "both").when(F.col("event_id") % 3 == 1, "inbound").otherwise("outbound")
    return e.select(
        F.col("event_id").alias("obs_id"), F.col("user_id").alias("place_id"), F.lit("flow").alias("kind"), direction.alias("direction"), value.alias("value"),
        micros("ts").alias("t"), (F.col("event_id") % 7).alias("source_id"), F.when(F.col("event_id") % 11 == 0, "question").otherwise("assertion").alias("modality"), F.col("value").alias("num"),
    )


OBS = """obs AS (
  SELECT event_id AS obs_id, user_id AS place_id, 'flow' AS kind,
    CASE event_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'inbound' ELSE 'outbound' END AS direction,
    CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'slow' WHEN 'purchase' THEN 'congested' WHEN 'error' THEN 'closed' ELSE 'other' END AS value,
    epoch_us(ts) AS t, event_id % 7 AS source_id, CASE WHEN event_id % 11 = 0 THEN 'question' ELSE 'assertion' END AS modality, value AS num
  FROM events)"""


def sources(spark: SparkSession) -> DataFrame:
    """Seven reporters: (source_id, source_kind, unit, trust). unit: the independence group, else the source."""
    i = F.col("id")
    return spark.range(7).select(
        i.alias("source_id"), F.when(i == 6, "crowd").otherwise("telegram").alias("source_kind"),
        F.when(i <= 2, "g0").otherwise(F.concat(F.lit("src:"), i.cast("string"))).alias("unit"),
        F.when(i % 3 == 1, 0.9).when(i % 3 == 2, 0.5).alias("trust"),
    )


SRC = """src AS (
  SELECT i AS source_id, CASE WHEN i = 6 THEN 'crowd' ELSE 'telegram' END AS source_kind,
    CASE WHEN i <= 2 THEN 'g0' ELSE 'src:' || CAST(i AS VARCHAR) END AS unit,
    CASE i % 3 WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS trust FROM range(7) AS r(i))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations (indicator, place_id, mon, value): order value by priority and customer's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    mon = F.expr("cast(date_trunc('MONTH', cast(o_orderdate AS timestamp_ntz)) AS date)")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("o_orderpriority").alias("indicator"), F.col("c_nationkey").cast("long").alias("place_id"), mon.alias("mon")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n"))


SERIES = """series AS (
  SELECT o_orderpriority AS indicator, CAST(c_nationkey AS BIGINT) AS place_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon,
    round(sum(o_totalprice), 2) AS value, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table (key, value, sys_from, sys_to): orders; F versions close after 30 days. sys_to null: open."""
    o = table(spark, sf_dir, "orders")
    t = micros("o_orderdate")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), t.alias("sys_from"), F.when(F.col("o_orderstatus") == "F", t + 30 * DAY).alias("sys_to"))


VERSIONS = """versions AS (
  SELECT o_orderkey AS key, o_custkey AS owner, o_orderstatus AS status, o_totalprice AS value, epoch_us(o_orderdate) AS sys_from,
    CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) + 2592000000000 END AS sys_to FROM orders)"""
