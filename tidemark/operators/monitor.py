"""Freshness, cadence, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, DAY, HOUR, MINUTE, OBS, SERIES, SRC, observations, series, sources, table


def arrivals(obs: DataFrame, grain: int = MINUTE) -> DataFrame:
    """Distinct arrival times of a source, in units of `grain`, with the gap before each."""
    m = obs.select("source_id", F.expr(f"t div {grain}").alias("m")).distinct()
    return m.withColumn("gap", F.col("m") - F.lag("m").over(Window.partitionBy("source_id").orderBy("m")))


ARR = f"{OBS}, m AS (SELECT DISTINCT source_id, t // {MINUTE} AS m FROM obs), g AS (SELECT *, m - lag(m) OVER (PARTITION BY source_id ORDER BY m) AS gap FROM m)"


@query("ag_feed_cadence", f"WITH {ARR} SELECT source_id, count(*) AS arrivals, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.99), 3) AS p99, round(CASE WHEN count(*) >= 60 THEN 3 * quantile_cont(gap, 0.99) END, 3) AS threshold FROM g GROUP BY 1")
def ag_feed_cadence(spark, sf_dir):
    g = arrivals(observations(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("arrivals"), F.percentile("gap", 0.5).alias("p50"), F.percentile("gap", 0.99).alias("p99"))
    return g.select("source_id", "arrivals", F.round("p50", 3).alias("p50"), F.round("p99", 3).alias("p99"), F.round(F.when(F.col("arrivals") >= 60, 3 * F.col("p99")), 3).alias("threshold"))


@query("ag_silence_ceiling", f"WITH {ARR} SELECT source_id, round(CASE WHEN count(*) >= 30 THEN greatest(1440, quantile_cont(gap, 0.95)) ELSE 1440 END, 3) AS ceiling FROM g GROUP BY 1")
def ag_silence_ceiling(spark, sf_dir):
    g = arrivals(observations(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.95).alias("p"))
    return g.select("source_id", F.round(F.when(F.col("n") >= 30, F.greatest(F.lit(1440.0), F.col("p"))).otherwise(1440.0), 3).alias("ceiling"))


@query("ag_source_silence", f"WITH {ARR}, s AS (SELECT source_id, max(m) AS last, CASE WHEN count(*) >= 30 THEN quantile_cont(gap, 0.95) WHEN count(gap) > 0 THEN 3 * avg(gap) ELSE 1440 END AS allowed FROM g GROUP BY 1) SELECT source_id, {AS_OF // MINUTE} - last AS silent, round(allowed, 3) AS allowed, {AS_OF // MINUTE} - last > allowed AS late FROM s")
def ag_source_silence(spark, sf_dir):
    g = arrivals(observations(spark, sf_dir)).groupBy("source_id").agg(F.max("m").alias("last"), F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.95).alias("p"), F.avg("gap").alias("a"))
    g = g.withColumn("allowed", F.when(F.col("n") >= 30, F.col("p")).when(F.col("a").isNotNull(), 3 * F.col("a")).otherwise(1440.0)).withColumn("silent", F.lit(AS_OF // MINUTE) - F.col("last"))
    return g.select("source_id", "silent", F.round("allowed", 3).alias("allowed"), (F.col("silent") > F.col("allowed")).alias("late"))


@query("rt_feed_checks", f"WITH {ARR}, s AS (SELECT source_id, count(*) AS n, max(m) AS last, quantile_cont(gap, 0.99) AS p FROM g GROUP BY 1) SELECT source_id, CASE WHEN n < 60 THEN 'uncovered' WHEN {AS_OF // MINUTE} - last > 3 * p THEN 'late' ELSE 'ok' END AS verdict FROM s")
def rt_feed_checks(spark, sf_dir):
    g = ag_feed_cadence(spark, sf_dir).join(arrivals(observations(spark, sf_dir)).groupBy("source_id").agg(F.max("m").alias("last"), F.percentile("gap", 0.99).alias("p")), "source_id")
    return g.select("source_id", F.when(F.col("arrivals") < 60, "uncovered").when(F.lit(AS_OF // MINUTE) - F.col("last") > 3 * F.col("p"), "late").otherwise("ok").alias("verdict"))


GAPS = f"""{SERIES}, d AS (SELECT DISTINCT indicator, CAST(place_id AS BIGINT) AS place_id, mon FROM series), g AS (SELECT *, CAST(mon - lag(mon) OVER (PARTITION BY indicator, place_id ORDER BY mon) AS BIGINT) AS gap FROM d),
r AS (SELECT indicator, place_id, count(*) AS n, min(mon) AS first, max(mon) AS last, median(gap) AS med, max(gap) AS longest, CAST(DATE '2001-09-01' - max(mon) AS BIGINT) AS age FROM g GROUP BY ALL)"""


@query("ag_gap_radar", f"WITH {GAPS} SELECT indicator, place_id, n, first, last, med, longest, greatest(med * 3, 7) AS allowance, CASE WHEN n < 3 THEN 'thin' WHEN age <= greatest(med * 3, 7) THEN 'fresh' WHEN age <= 6 * greatest(med * 3, 7) THEN 'late' ELSE 'stalled' END AS status, longest >= 6 * med AND longest >= 14 AND age > 30 AS hole FROM r")
def ag_gap_radar(spark, sf_dir):
    """Per series: span, median and longest gap, what lateness is allowed, and holes."""
    d = series(spark, sf_dir).select("indicator", "place_id", "mon")  # one row a series and month already
    g = d.withColumn("gap", F.datediff("mon", F.lag("mon").over(Window.partitionBy("indicator", "place_id").orderBy("mon"))).cast("long"))
    r = g.groupBy("indicator", "place_id").agg(F.count(F.lit(1)).alias("n"), F.min("mon").alias("first"), F.max("mon").alias("last"), F.median("gap").alias("med"), F.max("gap").alias("longest"))
    age, allow = F.datediff(F.lit("2001-09-01").cast("date"), "last"), F.greatest(F.col("med") * 3, F.lit(7.0))
    status = F.when(F.col("n") < 3, "thin").when(age <= allow, "fresh").when(age <= 6 * allow, "late").otherwise("stalled")
    hole = (F.col("longest") >= 6 * F.col("med")) & (F.col("longest") >= 14) & (age > 30)
    return r.select("*", allow.alias("allowance"), status.alias("status"), hole.alias("hole"))


@query("ag_eras", "SELECT o_orderpriority AS category, count(*) FILTER (WHERE year(o_orderdate) < 1997) AS early, count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1997 AND 1998) AS middle, count(*) FILTER (WHERE year(o_orderdate) > 1998) AS late FROM orders GROUP BY 1")
def ag_eras(spark, sf_dir):
    y = F.year(F.expr("cast(cast(o_orderdate AS timestamp_ntz) AS date)"))
    era = F.when(y < 1997, "early").when(y <= 1998, "middle").otherwise("late")
    return table(spark, sf_dir, "orders").withColumn("era", era).groupBy(F.col("o_orderpriority").alias("category")).pivot("era", ["early", "middle", "late"]).agg(F.count(F.lit(1))).na.fill(0)


@query("ag_freshness", f"WITH {OBS} SELECT value, max(t) FILTER (WHERE modality = 'assertion') AS newest, ({AS_OF} - max(t) FILTER (WHERE modality = 'assertion')) // {DAY} AS days, round(avg(CASE WHEN direction <> 'both' THEN 100.0 ELSE 0.0 END), 4) AS located FROM obs GROUP BY 1")
def ag_freshness(spark, sf_dir):
    g = observations(spark, sf_dir).groupBy("value").agg(F.max(F.when(F.col("modality") == "assertion", F.col("t"))).alias("newest"), F.round(F.avg(F.when(F.col("direction") != "both", 100.0).otherwise(0.0)), 4).alias("located"))
    return g.withColumn("days", F.expr(f"({AS_OF} - newest) div {DAY}"))


@query("ag_coverage_state", f"""WITH {OBS}, {SRC}, s AS (SELECT place_id, count(*) AS n, bool_and(source_kind = 'crowd') AS crowd, max(t) AS last FROM obs JOIN src USING (source_id) WHERE modality = 'assertion' AND value = 'closed' GROUP BY 1), p AS (SELECT DISTINCT place_id FROM obs)
SELECT CASE WHEN n IS NULL THEN 'never_reported' WHEN crowd THEN 'crowd_only' WHEN last < {AS_OF} - {3 * DAY} THEN 'stale' ELSE 'live' END AS state, count(*) AS places FROM p LEFT JOIN s USING (place_id) GROUP BY 1""")
def ag_coverage_state(spark, sf_dir):
    obs = observations(spark, sf_dir)
    s = obs.where("modality = 'assertion' AND value = 'closed'").join(F.broadcast(sources(spark)), "source_id").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("source_kind") == "crowd").alias("crowd"), F.max("t").alias("last"))
    state = F.when(F.col("n").isNull(), "never_reported").when(F.col("crowd"), "crowd_only").when(F.col("last") < AS_OF - 3 * DAY, "stale").otherwise("live")
    return obs.select("place_id").distinct().join(s, "place_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("places"))


@query("st_heartbeat", f"""WITH {OBS}, h AS (SELECT place_id, max(t) FILTER (WHERE value <> 'closed') AS ok, max(t) AS last, count(*) FILTER (WHERE value = 'closed') AS bad FROM obs GROUP BY 1)
SELECT place_id, CASE WHEN ok IS NULL THEN 'never_succeeded' WHEN last < {AS_OF} - {2 * DAY} THEN 'not_running' WHEN ok < last THEN 'failing' ELSE 'ok' END AS state FROM h""")
def st_heartbeat(spark, sf_dir):
    h = observations(spark, sf_dir).groupBy("place_id").agg(F.max(F.when(F.col("value") != "closed", F.col("t"))).alias("ok"), F.max("t").alias("last"))
    return h.select("place_id", F.when(F.col("ok").isNull(), "never_succeeded").when(F.col("last") < AS_OF - 2 * DAY, "not_running").when(F.col("ok") < F.col("last"), "failing").otherwise("ok").alias("state"))


@query("ag_supply_lines", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY t DESC, obs_id DESC) AS k FROM obs) SELECT place_id, bool_and(value = 'closed') AS dead, count(*) AS tries FROM r WHERE k <= 3 GROUP BY 1")
def ag_supply_lines(spark, sf_dir):
    """A line is dead if its last three attempts all failed."""
    w = Window.partitionBy("place_id").orderBy(F.col("t").desc(), F.col("obs_id").desc())
    return observations(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("place_id").agg(F.bool_and(F.col("value") == "closed").alias("dead"), F.count(F.lit(1)).alias("tries"))


@query("fn_signal_assess", """WITH d AS (SELECT user_id AS place_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY day DESC) AS k FROM d),
g AS (SELECT place_id, avg(v) FILTER (WHERE k <= 4) AS recent, list_sort(list(v) FILTER (WHERE k > 4)) AS rest FROM r GROUP BY 1), b AS (SELECT place_id, recent, rest[len(rest) // 2 + 1] AS base FROM g WHERE len(rest) > 0)
SELECT place_id, CASE WHEN recent < 0.5 * base THEN 'outage' WHEN recent < 0.8 * base THEN 'degraded' ELSE 'ok' END AS verdict FROM b""")
def fn_signal_assess(spark, sf_dir):
    """The mean of the last four points against the upper median before."""
    e = table(spark, sf_dir, "events").withColumn("day", F.expr("cast(cast(ts AS timestamp_ntz) AS date)"))
    d = e.groupBy(F.col("user_id").alias("place_id"), "day").agg(F.sum("value").alias("v"))
    g = d.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("day", "v")), asc=False).alias("p")).where("size(p) > 4")
    g = g.withColumn("recent", F.aggregate(F.slice("p", 1, 4), F.lit(0.0), lambda a, x: a + x["v"]) / 4).withColumn("rest", F.sort_array(F.transform(F.slice("p", F.lit(5), F.size("p")), lambda x: x["v"])))
    base = F.get("rest", F.floor(F.size("rest") / 2).cast("int"))
    return g.select("place_id", F.when(F.col("recent") < 0.5 * base, "outage").when(F.col("recent") < 0.8 * base, "degraded").otherwise("ok").alias("verdict"))


@query("ag_pattern_hour", f"""WITH {OBS}, r AS (SELECT DISTINCT place_id, t, value, CAST((t // {HOUR} + 2) % 24 AS INTEGER) AS hour FROM obs WHERE modality = 'assertion'), c AS (SELECT place_id, hour, value, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT place_id, hour, sum(n) AS total, max(n) AS top FROM c GROUP BY 1, 2), b AS (SELECT place_id, hour, min(value) AS modal FROM c JOIN s USING (place_id, hour) WHERE n = top GROUP BY 1, 2)
SELECT place_id, hour, CASE WHEN total < 5 THEN 'unknown' ELSE modal END AS modal, CAST(total AS BIGINT) AS n, round(CASE WHEN total >= 5 THEN top / total END, 6) AS share FROM s JOIN b USING (place_id, hour)""")
def ag_pattern_hour(spark, sf_dir):
    """Every place's commonest value by local hour of day (two hours east) and its share; of equal counts the least value; unknown under five reports."""
    r = observations(spark, sf_dir).where("modality = 'assertion'").select("place_id", "t", "value", F.expr(f"cast((t div {HOUR} + 2) % 24 AS int)").alias("hour")).distinct()
    c = r.groupBy("place_id", "hour", "value").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy("place_id", "hour").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    enough = F.col("n") >= 5
    return s.select("place_id", "hour", F.when(enough, F.col("b.value")).otherwise("unknown").alias("modal"), "n", F.round(F.when(enough, -F.col("b.m") / F.col("n")), 6).alias("share"))


@query("wn_lag_transitions", f"WITH {OBS}, l AS (SELECT place_id, value, lag(value) OVER (PARTITION BY place_id, direction ORDER BY t, obs_id) AS p FROM obs WHERE modality = 'assertion') SELECT place_id, count(*) FILTER (WHERE value <> p) AS changes FROM l GROUP BY 1 ORDER BY changes DESC, place_id LIMIT 8")
def wn_lag_transitions(spark, sf_dir):
    """The eight places that change most."""
    w = Window.partitionBy("place_id", "direction").orderBy("t", "obs_id")
    l = observations(spark, sf_dir).where("modality = 'assertion'").withColumn("p", F.lag("value").over(w))
    return l.groupBy("place_id").agg(F.count_if(F.col("value") != F.col("p")).alias("changes")).orderBy(F.col("changes").desc(), "place_id").limit(8)


@query("wn_lag_gaps", f"WITH {OBS}, g AS (SELECT place_id, t - lag(t) OVER (PARTITION BY place_id ORDER BY t, obs_id) AS gap FROM obs) SELECT place_id, max(gap) AS longest, round(median(gap), 1) AS middle FROM g GROUP BY 1")
def wn_lag_gaps(spark, sf_dir):
    w = Window.partitionBy("place_id").orderBy("t", "obs_id")
    return observations(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("place_id").agg(F.max("gap").alias("longest"), F.round(F.median("gap"), 1).alias("middle"))


@query("ag_insights_inc", f"WITH {OBS} SELECT place_id, count(*) AS events, count(DISTINCT source_id) FILTER (WHERE value = 'closed') AS corroborated, max(t) AS newest, max_by(value, t) AS last FROM obs GROUP BY 1")
def ag_insights_inc(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("place_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("value") == "closed", F.col("source_id"))).alias("corroborated"), F.max("t").alias("newest"), F.max_by("value", "t").alias("last"))


@query("ag_source_rollup", f"WITH {OBS} SELECT source_id, count(*) AS claims, max(t) AS newest FROM obs GROUP BY 1 HAVING count(*) > 0")
def ag_source_rollup(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("claims"), F.max("t").alias("newest")).where("claims > 0")


@query("st_backlog", f"WITH {OBS} SELECT source_id, count(*) AS pending, {AS_OF} - min(t) AS lag FROM obs WHERE t > {AS_OF} - {2 * DAY} - source_id * {HOUR} GROUP BY 1")
def st_backlog(spark, sf_dir):
    o = observations(spark, sf_dir).where(F.col("t") > F.lit(AS_OF - 2 * DAY) - F.col("source_id") * HOUR)
    return o.groupBy("source_id").agg(F.count(F.lit(1)).alias("pending"), (F.lit(AS_OF) - F.min("t")).alias("lag"))


@query("mt_field_health", "SELECT 'props' AS field, CAST(ts AS DATE) AS day, count(props) AS present, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'value', CAST(ts AS DATE), count(*) FILTER (WHERE value > 100), count(*) FROM events GROUP BY ALL")
def mt_field_health(spark, sf_dir):
    """Per field and day, how many rows carry it."""
    e = table(spark, sf_dir, "events").withColumn("day", F.expr("cast(cast(ts AS timestamp_ntz) AS date)"))
    rows = e.select("day", F.explode(F.create_map(F.lit("props"), F.col("props").isNotNull(), F.lit("value"), F.col("value") > 100)).alias("field", "there"))
    return rows.groupBy("field", "day").agg(F.count_if("there").alias("present"), F.count(F.lit(1)).alias("n"))


@query("mt_category_audit", "SELECT lang AS category, count(*) AS n, round(avg(n_chars), 4) AS chars, count(DISTINCT source) AS sources, count(*) FILTER (WHERE text LIKE '%@%') AS mails FROM documents GROUP BY 1")
def mt_category_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"), F.count_distinct("source").alias("sources"), F.count_if(F.col("text").contains("@")).alias("mails"))
