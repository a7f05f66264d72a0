"""Live reads, contracts, scores and learners' gates over the model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.catalogue import PLACES, places, within
from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, DAY, HOUR, MINUTE, OBS, micros, observations, table


def at_place(o: DataFrame) -> DataFrame:
    """Where observations were made, as for `catalogue.places`."""
    k = F.col("place_id")
    return o.withColumns({"lat": 31.0 + (k * 37 % 1000) / 1000.0, "lon": 34.5 + (k * 91 % 1000) / 1000.0})


# ---- live reads

_INC = f"i AS (SELECT obs_id, place_id, source_id, t, value AS type, 111195.0 * sqrt(pow(31.0 + (place_id * 37 % 1000) / 1000.0 - 31.5, 2) + pow((34.5 + (place_id * 91 % 1000) / 1000.0 - 35.0) * cos(radians(31.5)), 2)) AS m FROM obs WHERE value IN ('closed', 'congested') AND t > {AS_OF} - {3 * DAY})"


@query("rt_incidents_recent", f"WITH {OBS}, {_INC}, g AS (SELECT place_id, type, max(t) AS t, count(DISTINCT source_id) AS sources FROM i WHERE m <= 40000 GROUP BY 1, 2 HAVING count(DISTINCT source_id) >= 2 ORDER BY t DESC, place_id, type LIMIT 50) SELECT place_id, type, sources, count(*) OVER (PARTITION BY type) AS by_type FROM g")
def rt_incidents_recent(spark, sf_dir):
    """The newest fifty incidents of the window and radius that two sources give; counts by type are of the rows returned."""
    return incidents_recent(observations(spark, sf_dir), AS_OF - 3 * DAY, ["closed", "congested"], 2, (31.5, 35.0, 40000.0), 50)


def incidents_recent(o: DataFrame, since: int, types: list[str], min_sources: int, circle: tuple[float, float, float] | None, limit: int) -> DataFrame:
    from tidemark.operators.catalogue import metres

    o = at_place(o.where(F.col("value").isin(types) & (F.col("t") > since)))
    if circle:  # an optional parameter that is not given is no predicate
        o = o.where(metres(F.col("lat"), F.col("lon"), F.lit(circle[0]), F.lit(circle[1])) <= circle[2])
    g = o.groupBy("place_id", F.col("value").alias("type")).agg(F.max("t").alias("t"), F.count_distinct("source_id").alias("sources")).where(F.col("sources") >= min_sources)
    top = g.orderBy(F.col("t").desc(), "place_id", "type").limit(limit)
    return top.select("place_id", "type", "sources", F.count(F.lit(1)).over(Window.partitionBy("type")).alias("by_type"))


@query("flt_optional_param", f"WITH {OBS}, {_INC}, a AS (SELECT 'all' AS which, place_id, type FROM i GROUP BY 2, 3), b AS (SELECT 'two sources' AS which, place_id, type FROM i GROUP BY 2, 3 HAVING count(DISTINCT source_id) >= 2) SELECT which, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def flt_optional_param(spark, sf_dir):
    """One query with its optional parameters given or not: what is not given leaves no predicate in the plan."""
    run = lambda name, k: incidents_recent(observations(spark, sf_dir), AS_OF - 3 * DAY, ["closed", "congested"], k, None, 1 << 30).select(F.lit(name).alias("which"))
    return run("all", 1).unionByName(run("two sources", 2)).groupBy("which").agg(F.count(F.lit(1)).alias("n"))


@query("rt_services", f"WITH {OBS}, s AS (SELECT place_id, max_by(CASE WHEN num >= 100 THEN 'down' WHEN num >= 40 THEN 'degraded' ELSE 'ok' END, (t, obs_id)) AS state, max_by(num, (t, obs_id)) AS load, max(t) AS t FROM obs GROUP BY 1) SELECT place_id, CASE WHEN {AS_OF} - t > {2 * DAY} THEN 'unknown' ELSE state END AS state, round(load, 2) AS load FROM s")
def rt_services(spark, sf_dir):
    """Each place's newest service reading, unknown once it is older than two days, with the attribute it came with."""
    num = F.col("num")
    state = F.when(num >= 100, "down").when(num >= 40, "degraded").otherwise("ok")
    s = observations(spark, sf_dir).groupBy("place_id").agg(F.max(F.struct("t", "obs_id", state.alias("state"), "num")).alias("x"))
    return s.select("place_id", F.when(AS_OF - F.col("x.t") > 2 * DAY, "unknown").otherwise(F.col("x.state")).alias("state"), F.round("x.num", 2).alias("load"))


_SIG = f"""d AS (SELECT place_id, source_id, t // {DAY} AS day, count(*) AS v FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY place_id, source_id ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY place_id, source_id) AS n FROM d),
b AS (SELECT place_id, source_id, any_value(n) AS n, avg(v) FILTER (WHERE rn <= 4) AS recent, list_sort(list(v) FILTER (WHERE rn > 4)) AS rest FROM r GROUP BY 1, 2),
q AS (SELECT place_id, source_id, recent / list_extract(rest, len(rest) // 2 + 1) AS ratio FROM b WHERE n >= 6)"""


def ratios(signals: DataFrame, keys: list[str]) -> DataFrame:
    """signals (keys, day, v): the mean of each one's last four days over the upper median of the days before; six days at least."""
    s = F.array_sort(F.collect_list(F.struct((-F.col("day")).alias("k"), "v")))
    g = signals.groupBy(*keys).agg(s.alias("s")).where("size(s) >= 6")
    recent = F.aggregate(F.slice("s", 1, 4), F.lit(0.0), lambda a, x: a + x["v"]) / 4
    rest = F.array_sort(F.transform(F.slice("s", 5, F.size("s") - 4), lambda x: x["v"]))
    return g.select(*keys, (recent / F.get(rest, F.floor(F.size(rest) / 2).cast("int"))).alias("ratio"))


@query("rt_connectivity", f"WITH {OBS}, {_SIG} SELECT place_id, count(*) AS signals, count(*) FILTER (WHERE ratio < 0.8) AS low, CASE WHEN count(*) FILTER (WHERE ratio < 0.5) >= 2 THEN 'outage' WHEN count(*) FILTER (WHERE ratio < 0.8) >= 2 THEN 'degraded' ELSE 'normal' END AS state FROM q GROUP BY 1")
def rt_connectivity(spark, sf_dir):
    """A place is down only where two signals agree: below half of their baseline an outage, below 0.8 degraded."""
    s = observations(spark, sf_dir).groupBy("place_id", "source_id", F.expr(f"t div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("v"))
    r = ratios(s, ["place_id", "source_id"]).groupBy("place_id").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("ratio") < 0.8).alias("low"), F.count_if(F.col("ratio") < 0.5).alias("out"))
    return r.select("place_id", "signals", "low", F.when(F.col("out") >= 2, "outage").when(F.col("low") >= 2, "degraded").otherwise("normal").alias("state"))


def advisory(tmax: Column, tmin: Column, rain: Column, gust: Column) -> Column:
    """The first band that fits, the worst first; what is missing raises none. Degrees Celsius, millimetres, km/h."""
    hi, lo, mm, kmh = F.coalesce(tmax, F.lit(-99.0)), F.coalesce(tmin, F.lit(99.0)), F.coalesce(rain, F.lit(0.0)), F.coalesce(gust, F.lit(0.0))
    storm = (mm >= 30) | ((mm >= 5) & (kmh >= 70))
    bands = [("extreme_heat", hi >= 42), ("frost", lo <= 0), ("storm", storm), ("heat_wave", hi >= 38), ("cold", lo <= 4), ("rain", mm >= 10), ("high_wind", kmh >= 70)]
    out = F.lit("normal")
    for name, fits in reversed(bands):
        out = F.when(fits, name).otherwise(out)
    return out


def weather(spark, sf_dir) -> DataFrame:
    """A forecast an order: (id, place, day, tmax, tmin, rain, gust), some of it missing."""
    k = F.col("o_orderkey")
    part = lambda m, a, scale, low: F.when(k % 11 != a, (k * m % 997) / scale + low)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("place"), micros("o_orderdate").alias("day"), part(7, 1, 20.0, 0.0).alias("tmax"), part(13, 2, 30.0, -3.0).alias("tmin"), part(29, 3, 25.0, -4.0).alias("rain"), part(31, 4, 10.0, 0.0).alias("gust"))


_W = "w AS (SELECT o_orderkey AS id, o_custkey AS place, epoch_us(o_orderdate) AS day, CASE WHEN o_orderkey % 11 <> 1 THEN (o_orderkey * 7 % 997) / 20.0 END AS tmax, CASE WHEN o_orderkey % 11 <> 2 THEN (o_orderkey * 13 % 997) / 30.0 - 3 END AS tmin, CASE WHEN o_orderkey % 11 <> 3 THEN (o_orderkey * 29 % 997) / 25.0 - 4 END AS rain, CASE WHEN o_orderkey % 11 <> 4 THEN (o_orderkey * 31 % 997) / 10.0 END AS gust FROM orders)"
_ADV = "CASE WHEN tmax >= 42 THEN 'extreme_heat' WHEN tmin <= 0 THEN 'frost' WHEN rain >= 30 OR (rain >= 5 AND gust >= 70) THEN 'storm' WHEN tmax >= 38 THEN 'heat_wave' WHEN tmin <= 4 THEN 'cold' WHEN rain >= 10 THEN 'rain' WHEN gust >= 70 THEN 'high_wind' ELSE 'normal' END"


@query("fn_weather_advisory", f"WITH {_W} SELECT id, {_ADV} AS advisory FROM w")
def fn_weather_advisory(spark, sf_dir):
    return weather(spark, sf_dir).select("id", advisory(F.col("tmax"), F.col("tmin"), F.col("rain"), F.col("gust")).alias("advisory"))


@query("rt_weather", f"WITH {_W}, n AS (SELECT *, {_ADV} AS advisory FROM w QUALIFY row_number() OVER (PARTITION BY place ORDER BY day DESC, id DESC) = 1) SELECT place, advisory, round(tmax, 2) AS tmax, CASE WHEN tmax IS NOT NULL THEN rank() OVER (ORDER BY tmax IS NULL, tmax DESC) END AS hottest FROM n QUALIFY rank() OVER (ORDER BY tmax IS NULL, tmax DESC) <= 50")
def rt_weather(spark, sf_dir):
    """The fifty places with the hottest newest forecast: a top-k report, ties included."""
    w = weather(spark, sf_dir).groupBy("place").agg(F.max(F.struct("day", "id", "tmax", "tmin", "rain", "gust")).alias("x")).select("place", "x.*")
    edge = w.where("tmax IS NOT NULL").orderBy(F.col("tmax").desc()).limit(50).agg(F.min("tmax").alias("edge"))
    top = w.join(F.broadcast(edge), F.col("tmax") >= F.col("edge"))  # one row
    return top.select("place", advisory(F.col("tmax"), F.col("tmin"), F.col("rain"), F.col("gust")).alias("advisory"), F.round("tmax", 2).alias("tmax"), F.rank().over(Window.orderBy(F.col("tmax").desc())).cast("long").alias("hottest"))


# ---- prices

_PRICE = "pv AS (SELECT p_brand || '/' || p_type AS product, p_size AS unit, CASE WHEN p_partkey % 4 = 0 THEN 'implied' ELSE 'named' END AS basis, md5(p_name || p_size % 5) AS text_key, round(p_retailprice / 50) * 50 AS price, p_partkey AS pk FROM part), nw AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY product, unit ORDER BY pk DESC) = 1), vt AS (SELECT product, price, count(DISTINCT unit) FILTER (WHERE basis = 'named') AS named, count(DISTINCT text_key) AS texts, count(DISTINCT unit) AS units FROM nw GROUP BY 1, 2), gd AS (SELECT *, named >= 1 AND units >= 2 AND texts >= 2 AS good FROM vt), sm AS (SELECT product, count(*) AS prices, count(*) FILTER (WHERE good) AS rivals, max(units) AS top FROM gd GROUP BY 1)"


def price_votes(spark, sf_dir) -> DataFrame:
    """The newest price of each unit and product, then by product and price: units, units that name their source, different texts."""
    p = table(spark, sf_dir, "part")
    v = p.select(F.concat_ws("/", "p_brand", "p_type").alias("product"), F.col("p_size").alias("unit"), F.when(F.col("p_partkey") % 4 == 0, "implied").otherwise("named").alias("basis"), F.md5(F.concat("p_name", (F.col("p_size") % 5).cast("string"))).alias("text_key"), (F.round(F.col("p_retailprice") / 50) * 50).alias("price"), F.col("p_partkey").alias("at"))
    newest = v.groupBy("product", "unit").agg(F.max_by(F.struct("basis", "text_key", "price"), "at").alias("x")).select("product", "unit", "x.*")
    named = F.count_distinct(F.when(F.col("basis") == "named", F.col("unit")))
    return newest.groupBy("product", "price").agg(named.alias("named"), F.count_distinct("text_key").alias("texts"), F.count_distinct("unit").alias("units")).withColumn("good", (F.col("named") >= 1) & (F.col("units") >= 2) & (F.col("texts") >= 2))


@query("rt_fuel_prices", f"WITH {_PRICE} SELECT product, CASE WHEN rivals > 1 THEN 'conflicting' WHEN rivals = 1 THEN 'confirmed' WHEN prices > 1 THEN 'disputed' WHEN top >= 2 THEN 'copied' ELSE 'single' END AS state, (SELECT any_value(price) FROM gd WHERE gd.product = sm.product AND good AND rivals = 1) AS price FROM sm")
def rt_fuel_prices(spark, sf_dir):
    """What is believed of each product's price, or why nothing is: a price needs two units, one that names its source, and two different texts."""
    g = price_votes(spark, sf_dir).groupBy("product").agg(F.count(F.lit(1)).alias("prices"), F.count_if("good").alias("rivals"), F.max("units").alias("top"), F.max(F.when(F.col("good"), F.col("price"))).alias("price"))
    state = F.when(F.col("rivals") > 1, "conflicting").when(F.col("rivals") == 1, "confirmed").when(F.col("prices") > 1, "disputed").when(F.col("top") >= 2, "copied").otherwise("single")
    return g.select("product", state.alias("state"), F.when(F.col("rivals") == 1, F.col("price")).alias("price"))


@query("rt_fuel_history", f"WITH {_PRICE} SELECT product, price, units, named, texts, good AND product IN (SELECT product FROM sm WHERE rivals = 1) AS believed FROM gd")
def rt_fuel_history(spark, sf_dir):
    """Every vote, and whether its price is the believed one: a semi-join flag."""
    v = price_votes(spark, sf_dir)
    one = v.groupBy("product").agg((F.count_if("good") == 1).alias("one"))
    return v.join(one, "product").select("product", "price", "units", "named", "texts", (F.col("good") & F.col("one")).alias("believed"))


# ---- health and contracts

_CHECKS = f"ck AS (SELECT 'feed' AS family, 'source ' || source_id AS name, {AS_OF} - max(t) > {HOUR} AS fault FROM obs GROUP BY source_id UNION ALL SELECT 'place', 'place ' || place_id, count(*) < 5 OR {AS_OF} - max(t) > {3 * DAY} FROM obs GROUP BY place_id UNION ALL SELECT 'job', event_type, count(*) = 0 FROM events GROUP BY event_type)"


@query("rt_health", f"WITH {OBS}, {_CHECKS} SELECT family, count(*) FILTER (WHERE NOT fault) AS ok, count(*) FILTER (WHERE fault) AS faults, CASE WHEN (SELECT bool_or(fault) FROM ck) THEN 'degraded' ELSE 'ok' END AS status FROM ck GROUP BY 1")
def rt_health(spark, sf_dir):
    """Checks by family, and one status: degraded as soon as one check has a fault."""
    o = observations(spark, sf_dir)
    feed = o.groupBy(F.concat(F.lit("source "), F.col("source_id").cast("string")).alias("name")).agg((AS_OF - F.max("t") > HOUR).alias("fault")).select(F.lit("feed").alias("family"), "fault")
    place = o.groupBy("place_id").agg(((F.count(F.lit(1)) < 5) | (AS_OF - F.max("t") > 3 * DAY)).alias("fault")).select(F.lit("place").alias("family"), "fault")
    job = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count(F.lit(1)) == 0).alias("fault")).select(F.lit("job").alias("family"), "fault")
    g = feed.unionByName(place).unionByName(job).groupBy("family").agg(F.count_if(~F.col("fault")).alias("ok"), F.count_if("fault").alias("faults"))
    return g.withColumn("status", F.when(F.max("faults").over(Window.partitionBy(F.lit(1))) > 0, "degraded").otherwise("ok"))  # a row a family


def judged(scores: DataFrame, overall: float, per_type: float, min_n: int) -> DataFrame:
    """scores (version, round, type, good, n), a row a type: whether each version's newest measure passes its gates, and its weakest type.

    A type with fewer than min_n rows is not judged. Rows (version, score, weakest, passes).
    """
    newest = scores.withColumn("last", F.max("round").over(Window.partitionBy("version"))).where("round = last")
    p = F.col("good") / F.col("n")
    fit = F.col("n") >= min_n
    g = newest.groupBy("version").agg((F.sum("good") / F.sum("n")).alias("score"), F.min(F.when(fit, F.struct(p.alias("p"), "type"))).alias("w"))
    return g.select("version", F.round("score", 6).alias("score"), F.col("w.type").alias("weakest"), ((F.col("score") >= overall) & (F.coalesce(F.col("w.p"), F.lit(1.0)) >= per_type)).alias("passes"))


_ROUNDS = "rd AS (SELECT 'v' || doc_id % 4 AS version, doc_id % 3 AS round, source AS type, count(*) FILTER (WHERE quality = 1) AS good, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3)"


@query("mt_gold_contract", f"WITH {_ROUNDS}, nw AS (SELECT * FROM rd QUALIFY round = max(round) OVER (PARTITION BY version)), g AS (SELECT version, sum(good) / sum(n) AS score, min(good / n) FILTER (WHERE n >= 5) AS p FROM nw GROUP BY 1) SELECT version, round(score, 6) AS score, (SELECT min(type) FROM nw WHERE nw.version = g.version AND n >= 5 AND good / n = g.p) AS weakest, score >= 0.80 AND coalesce(p, 1) >= 0.60 AS passes FROM g")
def mt_gold_contract(spark, sf_dir):
    """Gates of 0.80 overall and 0.60 for every type with five rows; the newest measure of a version decides."""
    return judged(rounds(spark, sf_dir), 0.80, 0.60, 5)


def rounds(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string")).alias("version"), (F.col("doc_id") % 3).alias("round"), F.col("source").alias("type")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count(F.lit(1)).alias("n"))


@query("mt_weekly_review", f"WITH {_ROUNDS}, s AS (SELECT version, rd.round AS rnd, sum(good) / sum(n) AS score FROM rd GROUP BY 1, 2), l AS (SELECT *, lag(score) OVER (PARTITION BY version ORDER BY rnd) AS before FROM s) SELECT version, rnd, round(score, 6) AS score, round(score - before, 6) AS drift, CASE WHEN before IS NULL THEN 'first' WHEN score < 0.80 THEN 'below gate' WHEN score - before < -0.05 THEN 'drifting' ELSE 'steady' END AS verdict FROM l")
def mt_weekly_review(spark, sf_dir):
    """Each round measured again against its gate and the round before."""
    s = rounds(spark, sf_dir).withColumnRenamed("round", "rnd").groupBy("version", "rnd").agg((F.sum("good") / F.sum("n")).alias("score"))
    s = s.withColumn("before", F.lag("score").over(Window.partitionBy("version").orderBy("rnd")))
    drift = F.col("score") - F.col("before")
    verdict = F.when(F.col("before").isNull(), "first").when(F.col("score") < 0.80, "below gate").when(drift < -0.05, "drifting").otherwise("steady")
    return s.select("version", "rnd", F.round("score", 6).alias("score"), F.round(drift, 6).alias("drift"), verdict.alias("verdict"))


def compared(readings: DataFrame, held: DataFrame, fields: list[str], window_fields: list[str]) -> DataFrame:
    """Field by field, what was read against what the series holds; one word a reading, the worst first.

    readings (id, accepted, hours, fields ...), held (id, fields ...). A window field counts only in
    a reading over 24 hours. States: agree, differ, missing (the series lacks it), extra (only it has it).
    """
    h = held.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_held"))
    j = readings.join(h, "id", "left")
    mine = {f: F.when(F.col("hours") == 24, F.col(f)) if f in window_fields else F.col(f) for f in fields}
    state = lambda f: F.when(mine[f].isNull() & F.col(f"_{f}").isNull(), F.lit(None)).when(mine[f].isNull(), "extra").when(F.col(f"_{f}").isNull(), "missing").when(mine[f] == F.col(f"_{f}"), "agree").otherwise("differ")
    j = j.withColumn("s", F.array(*[state(f) for f in fields]))
    has = lambda x: F.coalesce(F.array_contains(F.array_compact("s"), x), F.lit(False))
    verdict = F.when(~F.col("accepted"), "refused").when(F.col("_held").isNull(), "not in series").when(has("differ") | has("extra"), "disagree").when(has("missing"), "series gap").otherwise("agree")
    return j.select("id", *[F.get("s", F.lit(k)).alias(f) for k, f in enumerate(fields)], verdict.alias("verdict"))


_READ = "rg AS (SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS accepted, CASE WHEN o_orderkey % 4 = 0 THEN 48 ELSE 24 END AS hours, o_orderkey % 50 AS total, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 7 END AS day_ FROM orders), hd AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderkey % 50 + CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 0 END END AS total, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 7 END AS day_ FROM orders WHERE o_orderkey % 8 <> 3)"
_STATE = "CASE WHEN {0} IS NULL AND hd.{1} IS NULL THEN NULL WHEN {0} IS NULL THEN 'extra' WHEN hd.{1} IS NULL THEN 'missing' WHEN {0} = hd.{1} THEN 'agree' ELSE 'differ' END"


@query("mt_reading_vs_series", f"WITH {_READ}, s AS (SELECT rg.id, accepted, hd.id AS held, {_STATE.format('rg.total', 'total')} AS total, {_STATE.format('CASE WHEN hours = 24 THEN rg.day_ END', 'day_')} AS day_ FROM rg LEFT JOIN hd ON hd.id = rg.id) SELECT id, total, day_, CASE WHEN NOT accepted THEN 'refused' WHEN held IS NULL THEN 'not in series' WHEN coalesce(total, '') IN ('differ', 'extra') OR coalesce(day_, '') IN ('differ', 'extra') THEN 'disagree' WHEN coalesce(total, '') = 'missing' OR coalesce(day_, '') = 'missing' THEN 'series gap' ELSE 'agree' END AS verdict FROM s")
def mt_reading_vs_series(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    readings = o.select(k.alias("id"), (k % 13 != 0).alias("accepted"), F.when(k % 4 == 0, 48).otherwise(24).alias("hours"), (k % 50).alias("total"), F.when(k % 9 != 0, k % 7).alias("day_"))
    held = o.where(k % 8 != 3).select(k.alias("id"), F.when(k % 10 != 1, k % 50 + F.when(k % 10 == 2, 1).otherwise(0)).alias("total"), F.when(k % 6 != 0, k % 7).alias("day_"))
    return compared(readings, held, ["total", "day_"], ["day_"])


# ---- learners' gates


def promotions(members: DataFrame, pairs: DataFrame, min_scored: int, min_both: int, line: float) -> DataFrame:
    """members (id, n, earned), pairs (a, b, both, agree): who becomes independent, loses it or waits, and why.

    One partner in lockstep over enough shared ground makes a member a copy; a member needs enough
    scored reports and shared ground to be promoted.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("partner"), "both", "agree").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("partner"), "both", "agree"))
    rate = F.col("agree") / F.col("both")
    g = ends.groupBy("id").agg(F.sum("both").alias("measured"), F.max(F.when((F.col("both") >= min_both) & (rate >= line), rate)).alias("copy"))
    j = members.join(g, "id", "left").withColumn("measured", F.coalesce("measured", F.lit(0)))
    verdict = (
        F.when(F.col("copy").isNotNull(), F.when(F.col("earned"), "demote").otherwise("wait: copy")).when(F.col("n") < min_scored, "wait: reports").when(F.col("measured") < min_both, "wait: shared ground")
        .when(~F.col("earned"), "promote").otherwise("keep")
    )
    return j.select("id", "n", "measured", verdict.alias("verdict"))


_PAIRS = f"m AS (SELECT source_id + 7 * (place_id % 3) AS id, place_id, t // {6 * HOUR} AS b, max_by(value, (t, obs_id)) AS value FROM obs GROUP BY ALL), pr AS (SELECT x.id AS a, y.id AS c, count(*) AS both_, count(*) FILTER (WHERE x.value = y.value) AS agree FROM m x JOIN m y ON x.place_id = y.place_id AND x.b = y.b AND x.id < y.id GROUP BY ALL), e AS (SELECT a AS id, both_, agree FROM pr UNION ALL SELECT c, both_, agree FROM pr), g AS (SELECT id, sum(both_) AS measured, bool_or(both_ >= 5 AND agree / both_ >= 0.25) AS copy FROM e GROUP BY 1), mb AS (SELECT source_id + 7 * (place_id % 3) AS id, count(*) AS n FROM obs GROUP BY 1)"


@query("gr_crowd_promotion", f"WITH {OBS}, {_PAIRS} SELECT mb.id, n, coalesce(measured, 0) AS measured, CASE WHEN copy THEN CASE WHEN mb.id % 2 = 0 THEN 'demote' ELSE 'wait: copy' END WHEN n < 40 THEN 'wait: reports' WHEN coalesce(measured, 0) < 5 THEN 'wait: shared ground' WHEN mb.id % 2 <> 0 THEN 'promote' ELSE 'keep' END AS verdict FROM mb LEFT JOIN g ON g.id = mb.id")
def gr_crowd_promotion(spark, sf_dir):
    """Submitters' last words by place and six hours, pairs that spoke of the same, and the verdict on each submitter."""
    o = observations(spark, sf_dir).withColumn("id", F.col("source_id") + 7 * (F.col("place_id") % 3))
    m = o.groupBy("id", "place_id", F.expr(f"t div {6 * HOUR}").alias("b")).agg(F.max_by("value", F.struct("t", "obs_id")).alias("value"))
    other = m.select(F.col("id").alias("c"), "place_id", "b", F.col("value").alias("w"))
    pairs = m.join(other, ["place_id", "b"]).where("id < c").groupBy(F.col("id").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("value") == F.col("w")).alias("agree"))
    members = o.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("earned", F.col("id") % 2 == 0)
    return promotions(members, pairs, 40, 5, 0.25)


@query("gr_source_scout", f"WITH c AS (SELECT page_id AS id, regexp_extract(url, '://([^/?#]+)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'cc-by' WHEN page_id % 3 = 1 THEN 'other' END AS licence, page_id % 200 AS age, CASE WHEN page_id % 2 = 0 THEN 'CSV' ELSE 'PDF' END AS format, regexp_matches(html, '(?i)data|tion') AS gap FROM pages), s AS (SELECT *, CASE WHEN gap THEN 3 ELSE 0 END + CASE WHEN licence = 'cc-by' THEN 2 ELSE 0 END + CASE WHEN age <= 90 THEN 2 ELSE 0 END + CASE WHEN format IN ('CSV', 'JSON', 'XLSX', 'GEOJSON') THEN 1 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY host ORDER BY id) = 1 THEN 2 ELSE 0 END AS score FROM c) SELECT id, score, CASE WHEN score >= 5 THEN 'candidate' WHEN score >= 3 THEN 'watched' END AS verdict FROM s")
def gr_source_scout(spark, sf_dir):
    """Offers of data scored: fits an open gap 3, open licence 2, changed within 90 days 2, readable format 1, a host not seen before 2."""
    k, p = F.col("page_id"), table(spark, sf_dir, "pages")
    c = p.select(k.alias("id"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), (k % 3 == 0).alias("open"), (k % 200 <= 90).alias("active"), (k % 2 == 0).alias("readable"), F.col("html").rlike("(?i)data|tion").alias("gap"))
    first = c.groupBy("host").agg(F.min("id").alias("id")).select("id", F.lit(2).alias("new"))
    points = lambda c, n: F.when(F.col(c), n).otherwise(0)
    s = c.join(first, "id", "left").withColumn("score", points("gap", 3) + points("open", 2) + points("active", 2) + points("readable", 1) + F.coalesce("new", F.lit(0)))
    return s.select("id", F.col("score").cast("long").alias("score"), F.when(F.col("score") >= 5, "candidate").when(F.col("score") >= 3, "watched").alias("verdict"))


# ---- shapes and paths


@query("jn_unnest_arrays", "SELECT conv_id, turn, i, w AS word FROM (SELECT conv_id, turn, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations))")
def jn_unnest_arrays(spark, sf_dir):
    """Arrays as rows, with their places: all words of every turn."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return t.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "word")


def get_path(doc: Column, path: str) -> Column:
    """A dotted path of a JSON text; null where any part of it is absent."""
    return F.get_json_object(doc, "$." + path)


def first_non_null(doc: Column, paths: list[str]) -> Column:
    return F.coalesce(*[get_path(doc, p) for p in paths])


def passthrough(doc: Column, fields: list[str]) -> Column:
    """The named fields that are there, as a map; absent ones are left out, not null."""
    every = F.create_map(*[x for f in fields for x in (F.lit(f), get_path(doc, f))])
    return F.map_filter(every, lambda _, v: v.isNotNull())


@query("fn_get_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.name.en'), json_extract_string(props, '$.k')) AS first, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS kept, CASE event_type WHEN 'purchase' THEN 'ILS' WHEN 'view' THEN 'count' ELSE 'unit:' || event_type END AS unit FROM events")
def fn_get_path(spark, sf_dir):
    """Dotted access, the first path that has a value, pass-through of what is there, and the unit by rule or default."""
    p = F.col("props")
    unit = F.when(F.col("event_type") == "purchase", "ILS").when(F.col("event_type") == "view", "count").otherwise(F.concat(F.lit("unit:"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", get_path(p, "k").alias("k"), first_non_null(p, ["name.en", "k"]).alias("first"), F.size(passthrough(p, ["k", "name.en", "missing"])).alias("kept"), unit.alias("unit"))


def occurred_from(reported: Column, offset_days: Column, hour: Column, zone_hours: int) -> tuple[Column, Column]:
    """When something happened, in microseconds, and how exactly: the posting time unless the text gives a day or an hour; never after the posting."""
    shift = zone_hours * HOUR
    day = F.floor((reported + shift) / DAY) * DAY + F.coalesce(offset_days, F.lit(0)) * DAY - shift
    stated = day + F.coalesce(hour, F.lit(12)) * HOUR
    said = offset_days.isNotNull() | hour.isNotNull()
    return F.when(said, F.least(stated, reported)).otherwise(reported).cast("long"), F.when(said & hour.isNull(), "day").otherwise("hour")


@query("fn_occurred_from", f"WITH {OBS}, w AS (SELECT obs_id, t, CASE WHEN obs_id % 4 = 1 THEN -(obs_id % 3) WHEN obs_id % 4 = 2 THEN 0 END AS od, CASE WHEN obs_id % 4 IN (2, 3) THEN obs_id % 24 END AS h FROM obs), s AS (SELECT *, (t + {2 * HOUR}) // {DAY} * {DAY} + coalesce(od, 0) * {DAY} - {2 * HOUR} + coalesce(h, 12) * {HOUR} AS stated FROM w) SELECT obs_id, CASE WHEN od IS NULL AND h IS NULL THEN t ELSE least(stated, t) END AS at, CASE WHEN h IS NULL AND od IS NOT NULL THEN 'day' ELSE 'hour' END AS precision FROM s")
def fn_occurred_from(spark, sf_dir):
    k = F.col("obs_id")
    od, h = F.when(k % 4 == 1, -(k % 3)).when(k % 4 == 2, F.lit(0)), F.when((k % 4).isin(2, 3), k % 24)
    at, precision = occurred_from(F.col("t"), od, h, 2)
    return observations(spark, sf_dir).select("obs_id", at.alias("at"), precision.alias("precision"))


@query("fn_shingles_jaccard", "WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' ') AS ws FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, list_distinct([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, greatest(len(ws) - 1, 2))]) AS sh FROM w), l AS (SELECT conv_id, turn, sh, lag(sh) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM s) SELECT conv_id, turn, round(len(list_intersect(sh, before)) / len(list_distinct(list_concat(sh, before))), 6) AS similarity FROM l WHERE before IS NOT NULL")
def fn_shingles_jaccard(spark, sf_dir):
    """How much of its word triples a turn shares with the turn before by the same role."""
    words = F.split(X.normalize(F.col("text")), " ")
    sh = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " ")))
    s = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", sh.alias("sh"))
    s = s.withColumn("before", F.lag("sh").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return s.select("conv_id", "turn", F.round(X.jaccard(F.col("sh"), F.col("before")), 6).alias("similarity"))


@query("fn_demojibake", r"SELECT doc_id, text, coalesce(regexp_matches(text, '^[\x{00}-\x{7F}\x{A0}-\x{FF}]*$') AND regexp_matches(text, '[\x{A0}-\x{FF}]'), false) AS repaired FROM documents")
def fn_demojibake(spark, sf_dir):
    """Texts that were read in the wrong encoding come back whole, and are counted: the query breaks them and repairs them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    latin = F.col("text").rlike("^[\\u0000-\\u007F\\u00A0-\\u00FF]*$")
    d = d.withColumn("broken", F.when(latin, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text")))
    d = d.withColumn("mended", X.repair_mojibake(F.col("broken")))
    return d.select("doc_id", F.col("mended").alias("text"), (~F.col("mended").eqNullSafe(F.col("broken"))).alias("repaired"))


@query("st_watermark_reader", f"WITH {OBS}, d AS (SELECT t // {DAY} AS day, max(obs_id) FILTER (WHERE t % {DAY} < {DAY - 10 * MINUTE}) AS settled, count(*) FILTER (WHERE t % {DAY} < {DAY - 10 * MINUTE}) AS read, count(*) AS seen FROM obs GROUP BY 1) SELECT day, read, seen - read AS held_back, max(settled) OVER (ORDER BY day) AS cursor FROM d")
def st_watermark_reader(spark, sf_dir):
    """A reader that runs at each day's end: rows of the last ten minutes are not settled and wait; its cursor never goes back."""
    day, settled = F.expr(f"t div {DAY}"), F.expr(f"t % {DAY} < {DAY - 10 * MINUTE}")
    d = observations(spark, sf_dir).groupBy(day.alias("day")).agg(F.max(F.when(settled, F.col("obs_id"))).alias("settled"), F.count_if(settled).alias("read"), F.count(F.lit(1)).alias("seen"))
    return d.select("day", "read", (F.col("seen") - F.col("read")).alias("held_back"), F.max("settled").over(Window.orderBy("day")).alias("cursor"))  # a row a day


@query("jn_fire_corroboration", f"""WITH {PLACES}, {OBS}, f AS (SELECT obs_id, t, 31.0 + (place_id * 37 % 1000) / 1000.0 AS lat, 34.5 + (place_id * 91 % 1000) / 1000.0 AS lon FROM obs WHERE value = 'congested'),
r AS (SELECT obs_id, t, num, 31.0 + (place_id * 37 % 1000) / 1000.0 AS lat, 34.5 + (place_id * 91 % 1000) / 1000.0 AS lon FROM obs WHERE value = 'closed' AND place_id % 3 <> 0 AND CAST(num * 100 AS BIGINT) % 2 = 0),
m AS (SELECT f.obs_id AS fire, r.obs_id AS report, num, 111195.0 * sqrt(pow(f.lat - r.lat, 2) + pow((f.lon - r.lon) * cos(radians(31.5)), 2)) AS m FROM f JOIN r ON abs(f.t - r.t) <= {6 * HOUR})
SELECT fire, report, round(least(0.97, 1 - (1 - least(0.95, 0.5 + num / 500)) * 0.30), 6) AS confidence FROM m WHERE m <= 3000 QUALIFY row_number() OVER (PARTITION BY fire ORDER BY round(m, 3), report) = 1""")
def jn_fire_corroboration(spark, sf_dir):
    """Each fire raises one report at most: the nearest within 3 km and six hours that tells of burning and names a precise place."""
    o = at_place(observations(spark, sf_dir))
    burning = F.expr("cast(round(num * 100) AS bigint) % 2 = 0")  # stands for the text's words
    f = o.where("value = 'congested'").select(F.col("obs_id").alias("id"), "lat", "lon", "t")
    r = o.where((F.col("value") == "closed") & (F.col("place_id") % 3 != 0) & burning).select(F.col("obs_id").alias("id"), "lat", "lon", F.col("t").alias("u"), "num")
    return corroborated(f, r, 3000.0, 6 * HOUR, F.least(F.lit(0.95), 0.5 + F.col("num") / 500))


def corroborated(f: DataFrame, r: DataFrame, radius: float, window: int, trust: Column) -> DataFrame:
    """Fires (id, lat, lon, t) and reports (id, lat, lon, u, ...): an equi-join on grid cells and time buckets, then distance and time."""
    from tidemark.operators.catalogue import metres

    cell_y, cell_x = radius / 111195.0, radius / 111195.0 / 0.8
    cells = [F.struct((F.floor(F.col("lat") / cell_y) + i).alias("gy"), (F.floor(F.col("lon") / cell_x) + j).alias("gx"), (F.floor(F.col("t") / window) + k).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    left = f.select(F.col("id").alias("fire"), F.col("lat").alias("y"), F.col("lon").alias("x"), "t", F.explode(F.array(*cells)).alias("g"))
    right = r.withColumnRenamed("id", "report").withColumn("g", F.struct(F.floor(F.col("lat") / cell_y).alias("gy"), F.floor(F.col("lon") / cell_x).alias("gx"), F.floor(F.col("u") / window).alias("b")))
    met = left.join(right, "g").withColumn("m", metres(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))).where((F.col("m") <= radius) & (F.abs(F.col("t") - F.col("u")) <= window))
    best = met.groupBy("fire").agg(F.min_by(F.struct("report", trust.alias("trust")), F.struct(F.round("m", 3), "report")).alias("b"))
    return best.select("fire", F.col("b.report").alias("report"), F.round(F.least(F.lit(0.97), 1 - (1 - F.col("b.trust")) * 0.30), 6).alias("confidence"))
