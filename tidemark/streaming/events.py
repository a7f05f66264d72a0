"""Structured Streaming: late overlap, sessions, belief refresh, a change stream. Each runs until its input is used up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import DAY, OBS, micros, observations, table


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")


def appended(df: DataFrame, tag: str) -> DataFrame:
    """Runs a stream in append mode to Parquet, checkpointed beside it, and reads the result."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def late_overlap(events: DataFrame, key: list[str], ts: str = "ts", lateness: str = "12 hours") -> DataFrame:
    """Rows of a feed that is read again with an overlap, each once: state is dropped once the watermark has passed."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "12 hours", lateness: str = "0 seconds") -> DataFrame:
    """Sessions of a key, each emitted when the watermark closes it; a gap equal to the limit does not split."""
    s = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(events: DataFrame, path: str | None = None, expire: int | None = None) -> DataFrame:
    """(place_id, t, value) where a place's value differs from its last one, and, with expire, where it decays to unknown that long after its last report.

    The last report of every place is a table that each batch writes anew beside the one before it,
    which is all the state there is: a run that starts again from its checkpoint goes on with it, and
    a batch that is run twice reads and writes the same. A batch's rows meet the state in a window
    that spills, so a place's rows are nowhere in memory together. Rows older than the state are late
    and no change. The first batch has no state: each place's first value is a change.
    """
    spark = events.sparkSession
    path = path or new_path(spark, "changes")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("place_id", "t", "obs_id", "value", F.lit(1).alias("new"))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/last/{number - 1}").select("place_id", "t", "obs_id", "value", F.lit(0).alias("new")))
        whole, w = Window.partitionBy("place_id"), Window.partitionBy("place_id").orderBy("new", "t", "obs_id")
        held = F.max(F.when(F.col("new") == 0, F.struct("t", "obs_id"))).over(whole)
        rows = rows.withColumn("held", held).where("new = 0 OR held IS NULL OR struct(t, obs_id) > held")
        rows = rows.withColumns({"p": F.lag("value").over(w), "pt": F.lag("t").over(w), "next": F.lead("t").over(w)})
        decayed = F.lit(False) if expire is None else F.col("t") - F.col("pt") > expire
        out = rows.where((F.col("new") == 1) & (F.coalesce(decayed, F.lit(False)) | ~F.col("value").eqNullSafe(F.col("p")))).select("place_id", "t", "value")
        state = rows.groupBy("place_id").agg(F.max_by(F.struct("t", "obs_id", "value"), F.struct("new", "t", "obs_id")).alias("x")).select("place_id", "x.*")
        if expire is not None:
            now = batch.agg(F.max("t")).first()[0]  # one number
            gone = F.coalesce("next", F.lit(now)) - F.col("t") > expire
            out = out.unionByName(rows.where(gone & (F.col("value") != "unknown")).select("place_id", (F.col("t") + expire).alias("t"), F.lit("unknown").alias("value")))
            state = state.withColumn("value", F.when(F.lit(now) - F.col("t") > expire, "unknown").otherwise(F.col("value")))
        out.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        state.write.mode("overwrite").parquet(f"{path}/last/{number}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("place_id long, t long, value string").parquet(f"{path}/rows/*")


def refresh(events: DataFrame, path: str | None = None) -> DataFrame:
    """The newest reading of every key; a reading only replaces an older one. Every batch reads the table of the batch before it and writes its
    own, so a run that starts again from its checkpoint loses nothing. One writer."""
    spark = events.sparkSession
    path = path or new_path(spark, "belief")
    schema = "place_id long, direction string, value string, t long, obs_id long"

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.select("place_id", "direction", "value", "t", "obs_id")
        if number:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/table/{number - 1}"))
        best = rows.groupBy("place_id", "direction").agg(F.max_by(F.struct("value", "t", "obs_id"), F.struct("t", "obs_id")).alias("x")).select("place_id", "direction", "x.*")
        best.write.mode("overwrite").parquet(f"{path}/table/{number}")

    q = events.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    tables = spark.read.schema(schema + ", number int").option("basePath", f"{path}/table").parquet(f"{path}/table/*").withColumn("number", F.regexp_extract(F.input_file_name(), "/table/([0-9]+)/", 1).cast("int"))
    newest = q.lastProgress["batchId"] if q.lastProgress else tables.agg(F.max("number")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/table/{newest}")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    value = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "slow").when(F.col("event_type") == "purchase", "congested").when(F.col("event_type") == "error", "closed").otherwise("other")
    direction = F.when(F.col("event_id") % 3 == 0, "both").when(F.col("event_id") % 3 == 1, "inbound").otherwise("outbound")
    return s.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("place_id"), direction.alias("direction"), value.alias("value"), micros("ts").alias("t"))


@query("st_late_overlap", "SELECT event_id, user_id FROM events")
def st_late_overlap(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("ts", F.timestamp_micros(micros("ts")))
    twice = s.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return appended(late_overlap(twice, ["event_id"]).select("event_id", "user_id"), "overlap")


@query("st_sessions_incremental", "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)")
def st_sessions_incremental(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("ts", F.timestamp_micros(micros("ts")))
    return appended(sessions(s, "user_id"), "sessions").select("user_id", F.unix_micros("start").alias("first"), "n")


EXPIRE = 2 * DAY


@query("st_change_stream", f"WITH {OBS}, l AS (SELECT place_id, t, value, lag(value) OVER w AS p, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM obs WINDOW w AS (PARTITION BY place_id ORDER BY t, obs_id)) SELECT place_id, t, value FROM l WHERE value IS DISTINCT FROM p OR t - pt > {EXPIRE} UNION ALL SELECT place_id, t + {EXPIRE}, 'unknown' FROM l WHERE coalesce(nt, (SELECT max(t) FROM obs)) - t > {EXPIRE}")
def st_change_stream(spark, sf_dir):
    """Changes of every place's value, and its decay to unknown two days after its last report."""
    return changes(observed(spark, sf_dir), expire=EXPIRE)


@query("st_belief_refresh", f"WITH {OBS} SELECT place_id, direction, value, t, obs_id FROM obs QUALIFY row_number() OVER (PARTITION BY place_id, direction ORDER BY t DESC, obs_id DESC) = 1")
def st_belief_refresh(spark, sf_dir):
    return refresh(observed(spark, sf_dir))


@query("wn_refresh_throttle", f"WITH RECURSIVE {OBS}, o AS (SELECT place_id, obs_id, t, value, row_number() OVER (PARTITION BY place_id ORDER BY t, obs_id) AS rn FROM obs), r AS (SELECT place_id, obs_id, t, value, rn, t AS at_, value AS v, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.place_id, o.obs_id, o.t, o.value, o.rn, CASE WHEN o.value <> r.v OR o.t - r.at_ >= 1800000000 THEN o.t ELSE r.at_ END, CASE WHEN o.value <> r.v OR o.t - r.at_ >= 1800000000 THEN o.value ELSE r.v END, o.value <> r.v OR o.t - r.at_ >= 1800000000 FROM r JOIN o ON o.place_id = r.place_id AND o.rn = r.rn + 1) SELECT place_id, obs_id, t, value FROM r WHERE kept")
def wn_refresh_throttle(spark, sf_dir):
    """Of a place's unchanged readings, one is written every half hour at most, counted from the last one written: a state per place."""
    return throttled(observations(spark, sf_dir).select("place_id", "obs_id", "t", "value"))


def throttled(rows: DataFrame, every: int = 1_800_000_000) -> DataFrame:
    """rows: (place_id, obs_id, t, value). Spark sorts them, and spills; a task holds one batch and the state of one place."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at, value = None, None, None
        for pdf in batches:
            kept = []
            for k, (p, t, v) in enumerate(zip(pdf["place_id"], pdf["t"], pdf["value"], strict=True)):
                p = None if pd.isna(p) else p
                if at is None or p != place or v != value or t - at >= every:
                    place, at, value = p, t, v
                    kept.append(k)
            yield pdf.iloc[kept]

    return rows.repartition("place_id").sortWithinPartitions("place_id", "t", "obs_id").mapInPandas(keep, rows.schema)
