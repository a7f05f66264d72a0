"""Events that reports open, join and bridge, kept as a table that survives a restart.

A report joins an event of its key whose first or last report is at most `gap` away; one that lies
between two events makes them one, under the name of the event that began first. A name is given
when an event opens and stays. Open events and the watermark are a table that each batch writes anew
beside the one before it: a run that starts again from its checkpoint goes on with it, and a batch
that is run twice reads and writes the same. A batch's reports meet the open events of their key in a
window that spills. An event is closed, and no longer held, once the watermark has passed its last
report by `gap`: no row that is not too late can join it then. Rows not after the watermark of the
batches before are too late and dropped. The table of events is the newest word on each name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import HOUR, micros
from tidemark.streaming.events import stream

EVENTS = "key string, event string, first long, last long, n long, status string"


def event_name(key: str, t: int, ident: int) -> str:
    return hashlib.sha1(f"{key}|{t}|{ident}".encode()).hexdigest()[:20]


def chained(t: np.ndarray, ident: np.ndarray, gap: int) -> list[tuple[int, int, int, int]]:
    """Runs (first, last, n, first id) of times whose neighbours are at most gap apart: of one key, what a batch comes to (the tests hold it against this)."""
    if not len(t):
        return []
    order = np.lexsort((ident, t))
    t, ident = t[order], ident[order]
    cuts = np.flatnonzero(np.diff(t) > gap) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(t))
    return [(int(t[a]), int(t[b - 1]), int(b - a), int(ident[a])) for a, b in zip(starts, ends)]


def event_sessions(reports: DataFrame, path: str, gap: int, lateness: str) -> DataFrame:
    """reports: a stream (key string, id, t in microseconds). Runs until its input is used up and goes on where an earlier run with this path ended. Rows (key, event, first, last, n, status)."""
    spark = reports.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select("key", F.lit(None).cast("string").alias("event"), F.col("t").alias("first"), F.col("t").alias("last"), F.lit(1).cast("long").alias("n"), F.col("id").cast("long").alias("id")).where("first IS NOT NULL")
        mark = None
        if number:
            mark = spark.read.parquet(f"{path}/mark/{number - 1}").first()[0]
            held = spark.read.schema(EVENTS).parquet(f"{path}/rows/number={number - 1}").where("status = 'open'")
            new = (new if mark is None else new.where(F.col("first") > mark)).unionByName(held.select("key", "event", "first", "last", "n", F.lit(None).cast("long").alias("id")))
        seen = batch.agg(F.expr(f"unix_micros(timestamp_micros(max(t)) - INTERVAL '{lateness}')")).first()[0]  # one number
        mark = max((m for m in (mark, seen) if m is not None), default=None)
        w = Window.partitionBy("key").orderBy("first", "last", "event", "id")
        before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = new.withColumn("cut", (F.coalesce(F.col("first") - before, F.lit(0)) > gap).cast("long")).withColumn("run", F.sum("cut").over(w))
        is_held = F.col("event").isNotNull()
        made = runs.groupBy("key", "run").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min_by("id", F.when(~is_held, F.struct("first", "id"))).alias("id"), F.min(F.when(~is_held, F.col("first"))).alias("at"),
            F.array_sort(F.collect_list(F.when(is_held, F.struct(F.col("first").alias("since"), "event", F.col("last").alias("until"))))).alias("held"),
        )
        name = F.coalesce(F.get("held", F.lit(0))["event"], F.substring(F.sha1(F.concat_ws("|", "key", "at", "id")), 1, 20))
        status = F.when(F.col("last") + gap < F.lit(mark), "closed").otherwise("open")
        own = F.struct(name.alias("event"), "first", "last", "n", status.alias("status"), (F.col("at").isNotNull() | (status == "closed")).alias("told"))
        gone = F.transform(F.slice("held", 2, F.size("held")), lambda e: F.struct(e["event"].alias("event"), e["since"].alias("first"), e["until"].alias("last"), F.lit(0).cast("long").alias("n"), F.lit("merged").alias("status"), F.lit(True).alias("told")))
        made.select("key", F.inline(F.concat(F.array(own), gone))).write.mode("overwrite").partitionBy("told").parquet(f"{path}/rows/number={number}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{path}/mark/{number}")

    reports.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return events(spark, path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The newest word on every event that was not merged into another."""
    rows = spark.read.schema(EVENTS + ", number long, told boolean").option("basePath", f"{path}/rows").parquet(f"{path}/rows").where("told")
    last = rows.groupBy("key", "event").agg(F.max_by(F.struct("first", "last", "n", "status"), "number").alias("e"))
    return last.select("key", "event", "e.*").where("status != 'merged'")


GAP = 12 * HOUR


@query("st_event_sessions", f"WITH f AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {GAP} THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM f), e AS (SELECT user_id, k, min(t) AS first, max(t) AS last, count(*) AS n, first(event_id ORDER BY t, event_id) AS id FROM s GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS key, substr(sha1(CAST(user_id AS VARCHAR) || '|' || CAST(first AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 20) AS event, first, last, n FROM e")
def st_event_sessions(spark, sf_dir):
    """All events so far, open and closed."""
    reports = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), micros("ts").alias("t"))
    return event_sessions(reports, new_path(spark, "event-sessions"), GAP, "12 hours").select("key", "event", "first", "last", "n")
