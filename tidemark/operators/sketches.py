"""Quantiles of arrival gaps over a rolling window, from daily tables that add up.

A day's table counts a feed's gaps by logarithmic buckets: bucket b holds gaps of over GAMMA^(b-1)
up to GAMMA^b seconds, and the middle of a bucket lies within ERROR of all of it. Counts of days
add up, so that a window of any number of days is a sum, and a quantile is the bucket that holds
its rank: within ERROR of the exact one. A gap belongs to the day of its later arrival. The last
arrival of every feed is carried from day to day, so that a refresh reads new days only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import AS_OF, DAY, OBS, observations

ERROR = 0.02
GAMMA = (1 + ERROR) / (1 - ERROR)
LAST = AS_OF // DAY - 1


def bucket(micros: Column) -> Column:
    """Of a gap in microseconds; gaps of a microsecond and less are bucket 0."""
    return F.when(micros <= 1, 0).otherwise(F.ceil(F.log(micros.cast("double")) / F.lit(math.log(GAMMA)))).cast("int")


def middle(b: Column) -> Column:
    """The value that stands for a bucket, in microseconds."""
    return F.when(b == 0, F.lit(1.0)).otherwise(2 * F.pow(F.lit(GAMMA), b.cast("double")) / (GAMMA + 1))


def daily(arrivals: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """arrivals: (feed, t) of some days; before: (feed, t), the last arrivals of earlier days. Daily counts (feed, day, bucket, n) and the last arrivals after."""
    rows = arrivals.select("feed", "t", F.lit(True).alias("new"))
    if before is not None:
        rows = rows.unionByName(before.select("feed", "t", F.lit(False).alias("new")))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("feed").orderBy("t"))
    counted = rows.withColumn("gap", gap).where("new AND gap IS NOT NULL")
    counts = counted.groupBy("feed", F.expr(f"cast(t div {DAY} AS int)").alias("day"), bucket(F.col("gap")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts, rows.groupBy("feed").agg(F.max("t").alias("t"))


def refresh(path: str, arrivals: DataFrame, upto: int) -> None:
    """Adds the days after the last refreshed one, up to and with `upto`, to the tables at path. A refresh that is run again for a day is no change."""
    spark = arrivals.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(f"{path}/last")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [int(x.getPath().getName().split("=")[1]) for x in store.listStatus(root) if store.exists(fs.Path(x.getPath(), "_SUCCESS"))] if store.exists(root) else []
    done = max(days, default=None)
    if done is not None and done >= upto:
        return
    new = arrivals.where(F.col("t") < (upto + 1) * DAY)
    before = None
    if done is not None:
        new, before = new.where(F.col("t") >= (done + 1) * DAY), spark.read.parquet(f"{path}/last/upto={done}").select("feed", "t")
    counts, last = daily(new, before)
    counts.write.mode("overwrite").parquet(f"{path}/counts/upto={upto}")  # a run that was cut short writes it again
    last.write.mode("overwrite").parquet(f"{path}/last/upto={upto}")


def window(path: str, spark, first: int, last: int) -> DataFrame:
    """Summed counts (feed, bucket, n) of days first to last."""
    counts = spark.read.parquet(f"{path}/counts")
    done = spark.read.parquet(f"{path}/last").select("upto").distinct()
    return counts.join(F.broadcast(done.limit(10**6)), "upto", "left_semi").where(F.col("day").between(first, last)).groupBy("feed", "bucket").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, shares: dict[str, float], least: int = 1) -> DataFrame:
    """counts: (feed, bucket, n). The value at rank share * (n - 1), rounded down, of every feed with `least` gaps; a feed has as many rows as buckets, some hundreds."""
    w = Window.partitionBy("feed").orderBy("bucket")
    rows = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("feed"))).where(F.col("total") >= least)
    at = [middle(F.min(F.when(F.col("upto") > F.floor(share * (F.col("total") - 1)), F.col("bucket")))).alias(name) for name, share in shares.items()]
    return rows.groupBy("feed").agg(F.first("total").alias("gaps"), *at)


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_B = f"CASE WHEN gap <= 1 THEN 0 ELSE CAST(ceil(ln(CAST(gap AS DOUBLE)) / {math.log(GAMMA)!r}) AS INTEGER) END"
_Q = ", ".join(f"min(CASE WHEN upto > floor({s} * (total - 1)) THEN bucket END) AS {n}" for n, s in SHARES.items())
_M = ", ".join(f"round(CASE WHEN {n} = 0 THEN 1.0 ELSE 2 * pow({GAMMA!r}, {n}) / ({GAMMA!r} + 1) END / 1000000, 3) AS {n}" for n in SHARES)


def _sql(days: int) -> str:
    return f"""WITH {OBS}, g AS (SELECT place_id AS feed, t // {DAY} AS day, t - lag(t) OVER (PARTITION BY place_id ORDER BY t) AS gap FROM obs),
c AS (SELECT feed, {_B} AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL AND day BETWEEN {LAST - days + 1} AND {LAST} GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY feed ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY feed) AS total FROM c),
q AS (SELECT feed, CAST(any_value(total) AS BIGINT) AS gaps, {_Q} FROM u GROUP BY feed) SELECT feed, gaps, {_M} FROM q"""


def _rolling(spark, sf_dir, days: int) -> DataFrame:
    """Three refreshes, of which each reads its own days."""
    path = new_path(spark, "sketches")
    arrivals = observations(spark, sf_dir).select(F.col("place_id").alias("feed"), "t")
    for upto in (LAST - 12, LAST - 1, LAST):
        refresh(path, arrivals, upto)
    got = quantiles(window(path, spark, LAST - days + 1, LAST), SHARES)
    return got.select("feed", "gaps", *[F.round(F.col(n) / 1_000_000, 3).alias(n) for n in SHARES])


@query("ag_feed_cadence_rolling", _sql(21))
def ag_feed_cadence_rolling(spark, sf_dir):
    return _rolling(spark, sf_dir, 21)


@query("ag_silence_ceiling_rolling", _sql(60))
def ag_silence_ceiling_rolling(spark, sf_dir):
    return _rolling(spark, sf_dir, 60)
