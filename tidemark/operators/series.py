"""Series analytics: flows, comparison, correlation with refusals, trends, canonical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.register import query
from tidemark.sources.analogues import SERIES, series, table

IP = ["indicator", "place_id"]
UNITS = [("1-URGENT", 1, 1000), ("2-HIGH", 1, 1000), ("3-MEDIUM", 10, 3), ("4-NOT SPECIFIED", 1, 1)]
MEASURE = {"1-URGENT": "flow", "2-HIGH": "stock", "3-MEDIUM": "cumulative", "4-NOT SPECIFIED": "unclassified", "5-LOW": "flow"}


def flow(df: DataFrame) -> DataFrame:
    """Differences of a cumulative series: null at the start or where it falls; how it was derived; days since the point before."""
    w = Window.partitionBy(*IP).orderBy("mon")
    prev, before = F.lag("value").over(w), F.lag("mon").over(w)
    df = df.withColumns({"_p": prev, "_b": before})
    how = F.when(F.col("_p").isNull(), "start").when(F.col("value") < F.col("_p"), "revision").otherwise("difference")
    return df.withColumn("flow", F.when(how == "difference", F.round(F.col("value") - F.col("_p"), 2))).withColumn("derivation", how).withColumn("gap_days", F.datediff("mon", "_b")).drop("_p", "_b")


def cumulative(df: DataFrame) -> DataFrame:
    w = Window.partitionBy(*IP).orderBy("mon").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.round(F.sum("value").over(w), 2))


CUM = f"{SERIES}, cum AS (SELECT indicator, place_id, mon, round(sum(value) OVER (PARTITION BY indicator, place_id ORDER BY mon), 2) AS value FROM series)"
FLOW = "CASE WHEN lag(value) OVER w IS NULL THEN 'start' WHEN value < lag(value) OVER w THEN 'revision' ELSE 'difference' END"


@query("wn_lag_flow", f"WITH {CUM} SELECT indicator, place_id, mon, CASE WHEN {FLOW} = 'difference' THEN round(value - lag(value) OVER w, 2) END AS flow, {FLOW} AS derivation, CAST(mon - lag(mon) OVER w AS INTEGER) AS gap_days FROM cum WINDOW w AS (PARTITION BY indicator, place_id ORDER BY mon)")
def wn_lag_flow(spark, sf_dir):
    return flow(cumulative(series(spark, sf_dir))).select(*IP, "mon", "flow", "derivation", "gap_days")


@query("sr_flow", f"WITH {SERIES}, f AS (SELECT indicator, {FLOW} AS derivation FROM series WINDOW w AS (PARTITION BY indicator, place_id ORDER BY mon)) SELECT indicator, derivation, count(*) AS n FROM f GROUP BY ALL")
def sr_flow(spark, sf_dir):
    return flow(series(spark, sf_dir)).groupBy("indicator", "derivation").agg(F.count(F.lit(1)).alias("n"))


@query("sr_diff", f"WITH {SERIES} SELECT indicator, place_id, mon, round(value - lag(value) OVER w, 2) AS diff FROM series WINDOW w AS (PARTITION BY indicator, place_id ORDER BY mon) QUALIFY lag(value) OVER w IS NOT NULL")
def sr_diff(spark, sf_dir):
    w = Window.partitionBy(*IP).orderBy("mon")
    return series(spark, sf_dir).select(*IP, "mon", F.round(F.col("value") - F.lag("value").over(w), 2).alias("diff")).where("diff IS NOT NULL")


@query("sr_collapse_dates", f"WITH {SERIES} SELECT indicator, mon, round(median(value), 4) AS value, count(*) AS rows FROM series GROUP BY ALL")
def sr_collapse_dates(spark, sf_dir):
    """One value a date: the median over places, with how many rows it stands for."""
    return series(spark, sf_dir).groupBy("indicator", "mon").agg(F.round(F.median("value"), 4).alias("value"), F.count(F.lit(1)).alias("rows"))


@query("sr_compare", f"WITH {SERIES}, d AS (SELECT place_id, mon FROM series WHERE indicator IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL HAVING count(DISTINCT indicator) = 3) SELECT place_id, min(mon) AS first, max(mon) AS last, count(*) AS n FROM d GROUP BY 1")
def sr_compare(spark, sf_dir):
    """Dates that all of up to six series share; values are not rescaled."""
    three = series(spark, sf_dir).where(F.col("indicator").isin("1-URGENT", "2-HIGH", "5-LOW"))
    d = three.groupBy("place_id", "mon").agg(F.count_distinct("indicator").alias("k")).where("k = 3")
    return d.groupBy("place_id").agg(F.min("mon").alias("first"), F.max("mon").alias("last"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, part: list[str], value: str, name: str) -> DataFrame:
    """Ranks in which ties share their mean."""
    w, t = Window.partitionBy(*part).orderBy(value), Window.partitionBy(*part, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(t) - 1) / 2)


@query("wn_rank_average", f"WITH {SERIES} SELECT indicator, place_id, mon, rank() OVER (PARTITION BY indicator, place_id ORDER BY n) + (count(*) OVER (PARTITION BY indicator, place_id, n) - 1) / 2 AS rank FROM series")
def wn_rank_average(spark, sf_dir):
    return average_rank(series(spark, sf_dir), IP, "n", "rank").select(*IP, "mon", "rank")


def aligned(a: DataFrame, b: DataFrame, lags: int) -> DataFrame:
    """Rows (place_id, lag, mon, x, y): b's value `lag` months after a's date, for every lag."""
    shifted = a.select("place_id", "mon", F.col("value").alias("x"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")).withColumn("there", F.add_months("mon", F.col("lag")))
    there = b.select("place_id", F.col("mon").alias("there"), F.col("value").alias("y"))
    return shifted.join(there, ["place_id", "there"]).select("place_id", "lag", "mon", "x", "y")


ALIGN = f"""{SERIES}, al AS (SELECT a.place_id, l.lag, a.mon, a.value AS x, b.value AS y FROM series a CROSS JOIN (SELECT unnest(range(-3, 4))::INTEGER AS lag) l JOIN series b ON b.place_id = a.place_id AND b.mon = CAST(a.mon + to_months(l.lag) AS DATE) WHERE a.indicator = '1-URGENT' AND b.indicator = '5-LOW')"""


def _two(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.where("indicator = '1-URGENT'"), s.where("indicator = '5-LOW'")


@query("jn_series_align", f"WITH {ALIGN} SELECT place_id, lag, mon, x, y FROM al")
def jn_series_align(spark, sf_dir):
    return aligned(*_two(spark, sf_dir), 3)


def correlated(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pearson's and Spearman's correlation of x and y of each key."""
    w = average_rank(average_rank(pairs, key, "x", "rx"), key, "y", "ry")
    return w.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("rho"))


RANKED = ALIGN + """, rk AS (SELECT *, rank() OVER (PARTITION BY place_id, lag ORDER BY x) + (count(*) OVER (PARTITION BY place_id, lag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY place_id, lag ORDER BY y) + (count(*) OVER (PARTITION BY place_id, lag, y) - 1) / 2 AS ry FROM al),
co AS (SELECT place_id, lag, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS rho FROM rk GROUP BY ALL)"""


@query("sr_correlate", f"WITH {RANKED}, best AS (SELECT * FROM co WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY round(abs(rho), 9) DESC, lag) = 1) SELECT place_id, lag, n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(rho) + 1.96 / sqrt(n - 3)), 6) AS high FROM best")
def sr_correlate(spark, sf_dir):
    """The lag of greatest rank correlation; of equals the first in ascending order."""
    co = correlated(aligned(*_two(spark, sf_dir), 3), ["place_id", "lag"]).where("n >= 12")
    best = co.groupBy("place_id").agg(F.max(F.struct(F.round(F.abs("rho"), 9).alias("a"), (-F.col("lag")).alias("l"), "n", "rho")).alias("b"))
    low, high = stats.fisher_interval(F.col("b.rho"), F.col("b.n"))
    return best.select("place_id", (-F.col("b.l")).alias("lag"), F.col("b.n").alias("n"), F.round("b.rho", 6).alias("rho"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("fn_pearson_fisher", f"WITH {RANKED} SELECT place_id, lag, round(pearson, 6) AS pearson, round(rho, 6) AS rho, n FROM co")
def fn_pearson_fisher(spark, sf_dir):
    co = correlated(aligned(*_two(spark, sf_dir), 3), ["place_id", "lag"])
    return co.select("place_id", "lag", F.round("pearson", 6).alias("pearson"), F.round("rho", 6).alias("rho"), "n")


KINDS = "kinds(indicator, kind) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MEASURE.items()) + ")"


@query("sr_scan", f"""WITH {SERIES}, {KINDS}, a AS (SELECT place_id, mon, value AS x FROM series WHERE indicator = '5-LOW'), c AS (SELECT s.* FROM series s JOIN kinds USING (indicator) WHERE kind IN ('flow', 'stock') AND indicator <> '5-LOW'),
p AS (SELECT c.indicator, c.place_id, x, c.value AS y FROM c JOIN a USING (place_id, mon)), rk AS (SELECT *, rank() OVER (PARTITION BY indicator, place_id ORDER BY x) + (count(*) OVER (PARTITION BY indicator, place_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY indicator, place_id ORDER BY y) + (count(*) OVER (PARTITION BY indicator, place_id, y) - 1) / 2 AS ry FROM p),
t AS (SELECT indicator, place_id, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 12), h AS (SELECT count(*) AS considered FROM (SELECT DISTINCT indicator, place_id FROM c)) SELECT t.*, round(CAST(0.05 AS DOUBLE) * count(*) OVER (), 4) AS expected_false, count(*) OVER () AS tested, considered - count(*) OVER () AS skipped FROM t, h ORDER BY abs(rho) DESC, indicator, place_id LIMIT 15""")
def sr_scan(spark, sf_dir):
    """All eligible candidates against one series in one job; the 15 of greatest correlation, with how many would be found by chance."""
    s = series(spark, sf_dir)
    eligible = [k for k, v in MEASURE.items() if v in ("flow", "stock") and k != "5-LOW"]
    a = s.where("indicator = '5-LOW'").select("place_id", "mon", F.col("value").alias("x"))
    pairs = s.where(F.col("indicator").isin(eligible)).withColumnRenamed("value", "y").join(a, ["place_id", "mon"])
    t = correlated(pairs, IP).where("n >= 12").select(*IP, "n", F.round("rho", 6).alias("rho"))
    considered = s.where(F.col("indicator").isin(eligible)).select(*IP).distinct().agg(F.count(F.lit(1)).alias("considered"))
    tested = t.agg(F.round(0.05 * F.count(F.lit(1)), 4).alias("expected_false"), F.count(F.lit(1)).alias("tested")).crossJoin(considered).select("expected_false", "tested", (F.col("considered") - F.col("tested")).alias("skipped"))
    return t.crossJoin(F.broadcast(tested)).orderBy(F.abs("rho").desc(), "indicator", "place_id").limit(15)  # tested is one row


#: The concept and the grain of place that each measure has, beside its kind.
CONCEPT = {"1-URGENT": "orders", "2-HIGH": "orders", "3-MEDIUM": "value", "4-NOT SPECIFIED": None, "5-LOW": "value"}
MIN_N, MONOTONE = 12, 0.8


def facts_of(s: DataFrame) -> DataFrame:
    """A row a series (indicator, place_id): n points of known precision, points left out, kind, concept, grain, and how monotone it is (rank correlation with its own order)."""
    known = s.where("n > 1")  # a month with one order stands for a date that nobody knows
    r = average_rank(known, IP, "value", "rv").withColumn("at", F.row_number().over(Window.partitionBy(*IP).orderBy("mon")))
    g = r.groupBy(*IP).agg(F.count(F.lit(1)).alias("points"), F.corr("rv", "at").alias("trend"))
    kind = F.create_map(*[F.lit(x) for kv in MEASURE.items() for x in kv])[F.col("indicator")]
    concept = F.create_map(*[F.lit(x) for kv in CONCEPT.items() if kv[1] for x in kv])[F.col("indicator")]
    return s.groupBy(*IP).agg(F.count(F.lit(1)).alias("all")).join(g, IP, "left").na.fill(0, ["points"]).select(*IP, "points", (F.col("all") - F.col("points")).alias("left_out"), "trend", kind.alias("kind"), concept.alias("concept"), F.when((F.col("indicator") == "5-LOW") & (F.col("place_id") % 4 == 0), "region").otherwise("nation").alias("grain"))


def refusals(pairs: DataFrame, differenced: bool = False, same_concept: bool = False) -> Column:
    """Every reason against correlating two series, a and b, structs of `facts_of`; empty means go."""
    a, b = F.col("a"), F.col("b")
    either = lambda test: test(a) | test(b)
    reasons = [
        F.when(either(lambda x: x["kind"].isNull() | (x["kind"] == "unclassified")), "unclassified"), F.when(either(lambda x: x["kind"] == "cumulative") & F.lit(not differenced), "cumulative"), F.when(either(lambda x: x["kind"] == "status"), "status"),
        F.when(a["grain"] != b["grain"], "mixed grain"), F.when((a["concept"] == b["concept"]) & (a["indicator"] != b["indicator"]) & F.lit(not same_concept), "same concept"), F.when(either(lambda x: x["points"] < MIN_N), "too few points"),
        F.when(either(lambda x: x["left_out"] > 0), "unknown precision left out"),
        F.when((F.abs(a["trend"]) >= MONOTONE) & (F.abs(b["trend"]) >= MONOTONE) & (a["points"] >= MIN_N) & (b["points"] >= MIN_N) & F.lit(not differenced), "both monotone"),
    ]
    return F.array_compact(F.array(*reasons))


_CONCEPTS = "con(indicator, concept) AS (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in CONCEPT.items()) + ")"


@query("sr_refusals", f"""WITH {SERIES}, {KINDS}, {_CONCEPTS}, kn AS (SELECT *, rank() OVER (PARTITION BY indicator, place_id ORDER BY value) + (count(*) OVER (PARTITION BY indicator, place_id, value) - 1) / 2 AS rv, row_number() OVER (PARTITION BY indicator, place_id ORDER BY mon) AS at_ FROM series WHERE n > 1),
g AS (SELECT indicator, place_id, count(*) AS points, corr(rv, at_) AS trend FROM kn GROUP BY 1, 2), f AS (SELECT s.indicator, s.place_id, coalesce(points, 0) AS points, c - coalesce(points, 0) AS left_out, trend, kind, concept, CASE WHEN s.indicator = '5-LOW' AND s.place_id % 4 = 0 THEN 'region' ELSE 'nation' END AS grain FROM (SELECT indicator, place_id, count(*) AS c FROM series GROUP BY 1, 2) s LEFT JOIN g USING (indicator, place_id) JOIN kinds USING (indicator) JOIN con USING (indicator))
SELECT a.indicator AS a, b.indicator AS b, a.place_id, array_to_string(list_filter([CASE WHEN a.kind = 'unclassified' OR b.kind = 'unclassified' THEN 'unclassified' END, CASE WHEN a.kind = 'cumulative' OR b.kind = 'cumulative' THEN 'cumulative' END, CASE WHEN a.kind = 'status' OR b.kind = 'status' THEN 'status' END, CASE WHEN a.grain <> b.grain THEN 'mixed grain' END, CASE WHEN a.concept = b.concept THEN 'same concept' END, CASE WHEN a.points < 12 OR b.points < 12 THEN 'too few points' END, CASE WHEN a.left_out > 0 OR b.left_out > 0 THEN 'unknown precision left out' END, CASE WHEN abs(a.trend) >= 0.8 AND abs(b.trend) >= 0.8 AND a.points >= 12 AND b.points >= 12 THEN 'both monotone' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f a JOIN f b ON a.place_id = b.place_id AND a.indicator < b.indicator""")
def sr_refusals(spark, sf_dir):
    """Why two series of a place may not be correlated, as data: every pair of measures of every place."""
    f = facts_of(series(spark, sf_dir)).select("place_id", F.struct("indicator", "points", "left_out", "trend", "kind", "concept", "grain").alias("a"))
    pairs = f.join(f.select("place_id", F.col("a").alias("b")), "place_id").where("a.indicator < b.indicator")
    return pairs.select(F.col("a.indicator").alias("a"), F.col("b.indicator").alias("b"), "place_id", F.array_join(refusals(pairs), ",").alias("reasons"))


@query("sr_trend", f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY indicator, place_id ORDER BY mon DESC) AS k, count(*) OVER (PARTITION BY indicator, place_id) AS c FROM series),
g AS (SELECT indicator, place_id, avg(value) FILTER (WHERE k <= 3) AS recent, list_sort(list(value) FILTER (WHERE k > 3)) AS rest FROM r WHERE c >= 6 GROUP BY ALL), b AS (SELECT *, rest[len(rest) // 2 + 1] AS base FROM g)
SELECT indicator, place_id, round(recent, 4) AS recent, base, CASE WHEN abs(recent - base) < 0.1 * abs(base) THEN 'flat' WHEN recent > base THEN 'up' ELSE 'down' END AS trend FROM b""")
def sr_trend(spark, sf_dir):
    """The mean of the last three points against the upper median of the rest; series of six points or more."""
    s = series(spark, sf_dir).groupBy(*IP).agg(F.sort_array(F.collect_list(F.struct("mon", "value")), asc=False).alias("p")).where("size(p) >= 6")
    s = s.withColumn("recent", F.aggregate(F.slice("p", 1, 3), F.lit(0.0), lambda a, x: a + x["value"]) / 3)
    rest = F.sort_array(F.transform(F.slice("p", F.lit(4), F.size("p")), lambda x: x["value"]))
    s = s.withColumn("rest", rest).withColumn("base", F.get("rest", F.floor(F.size("rest") / 2).cast("int")))
    trend = F.when(F.abs(F.col("recent") - F.col("base")) < 0.1 * F.abs("base"), "flat").when(F.col("recent") > F.col("base"), "up").otherwise("down")
    return s.select(*IP, F.round("recent", 4).alias("recent"), "base", trend.alias("trend"))


@query("prj_canonical_units", f"WITH {SERIES}, u(indicator, num, den) AS (VALUES {', '.join(map(str, UNITS))}) SELECT indicator, place_id, mon, value, round(CASE WHEN num IS NULL THEN value ELSE value * num / den END, 6) AS canonical, CASE WHEN num IS NULL THEN 'as given' ELSE CAST(num AS VARCHAR) || '/' || CAST(den AS VARCHAR) END AS conversion FROM series LEFT JOIN u USING (indicator)")
def prj_canonical_units(spark, sf_dir):
    """Values in canonical units by exact ratios; the raw value stays."""
    u = spark.createDataFrame(UNITS, "indicator string, num int, den int")
    s = series(spark, sf_dir).join(F.broadcast(u), "indicator", "left")
    known = F.col("num").isNotNull()
    return s.select(*IP, "mon", "value", F.round(F.when(known, F.col("value") * F.col("num") / F.col("den")).otherwise(F.col("value")), 6).alias("canonical"), F.when(known, F.concat_ws("/", "num", "den")).otherwise("as given").alias("conversion"))


@query("sr_series", f"""WITH {SERIES}, g AS (SELECT indicator, s.place_id, n_regionkey AS region, mon, value FROM series s JOIN nation ON n_nationkey = s.place_id), own AS (SELECT indicator, place_id, 1 AS rank, count(*) AS n FROM g WHERE value > 500000 GROUP BY ALL),
reg AS (SELECT indicator, region, count(*) AS n FROM g WHERE value > 500000 GROUP BY ALL), want AS (SELECT DISTINCT indicator, place_id, region FROM g)
SELECT indicator, place_id, CASE WHEN own.n IS NOT NULL THEN 'place' WHEN reg.n IS NOT NULL THEN 'region' ELSE 'none' END AS grain, coalesce(own.n, reg.n, 0) AS n FROM want LEFT JOIN own USING (indicator, place_id) LEFT JOIN reg USING (indicator, region)""")
def sr_series(spark, sf_dir):
    """A series of a place, widened to its region where the place has no points."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_regionkey").alias("region"))
    g = series(spark, sf_dir).join(F.broadcast(nation), "place_id")  # nations: a fixed table of 25 rows
    big = g.where("value > 500000")
    own, reg = big.groupBy(*IP).agg(F.count(F.lit(1)).alias("own")), big.groupBy("indicator", "region").agg(F.count(F.lit(1)).alias("reg"))
    want = g.select(*IP, "region").distinct().join(own, IP, "left").join(reg, ["indicator", "region"], "left")
    return want.select(*IP, F.when(F.col("own").isNotNull(), "place").when(F.col("reg").isNotNull(), "region").otherwise("none").alias("grain"), F.coalesce("own", "reg", F.lit(0)).alias("n"))


@query("sr_movement", "WITH e AS (SELECT user_id AS place_id, CAST(ts AS DATE) AS day, count(*) AS reports, count(*) FILTER (WHERE event_type = 'error') AS closed FROM events GROUP BY ALL) SELECT place_id, day, round(closed / reports, 6) AS ratio FROM e")
def sr_movement(spark, sf_dir):
    """Closures per report; a day with reports and none closed is 0, not missing."""
    e = table(spark, sf_dir, "events").withColumn("day", F.expr("cast(cast(ts AS timestamp_ntz) AS date)"))
    g = e.groupBy(F.col("user_id").alias("place_id"), "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("c"))
    return g.select("place_id", "day", F.round(F.col("c") / F.col("n"), 6).alias("ratio"))


@query("jn_crosscheck_days", """WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS x FROM events WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS y FROM events WHERE event_type = 'error' AND event_id % 5 < 2 GROUP BY 1)
SELECT coalesce(a.day, b.day) AS day, CASE WHEN x IS NULL THEN 'only b' WHEN y IS NULL THEN 'only a' WHEN x = y THEN 'agree' WHEN EXISTS (SELECT 1 FROM b c WHERE abs(c.day - a.day) = 1 AND c.y = x) THEN 'dated a day apart' ELSE 'disagree' END AS verdict FROM a FULL JOIN b ON a.day = b.day""")
def jn_crosscheck_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("day", F.expr("cast(cast(ts AS timestamp_ntz) AS date)"))
    a = e.where("event_id % 2 = 0").groupBy("day").agg(F.count(F.lit(1)).alias("x"))
    b = e.where("event_id % 5 < 2").groupBy("day").agg(F.count(F.lit(1)).alias("y"))
    near = b.select(F.explode(F.array(F.date_add("day", -1), F.date_add("day", 1))).alias("day"), F.col("y").alias("x")).distinct().withColumn("near", F.lit(True))
    met = a.join(b, "day", "full").join(near, ["day", "x"], "left")
    verdict = F.when(F.col("x").isNull(), "only b").when(F.col("y").isNull(), "only a").when(F.col("x") == F.col("y"), "agree").when(F.col("near"), "dated a day apart").otherwise("disagree")
    return met.select("day", verdict.alias("verdict"))
