"""Summaries with several facets, payloads under licence, gates, backtests by age and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.catalogue import GRADES, SERVING, serving, worst
from tidemark.operators.learn import OTHER, assertions, last_other_unit
from tidemark.operators.reads import _PRICE, price_votes
from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, DAY, HOUR, OBS, observations, sources, table

# ---- views by category, as data


def category_views(s: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Every view at once: a rule (column, value prefix) a name; a row is in each view whose rule fits it."""
    fits = F.array_compact(F.array(*[F.when(F.col(c).startswith(v), F.lit(name)) for name, (c, v) in rules.items()]))
    return s.withColumn("view", F.explode(fits))


VIEWS = {f"v_{k[2:].lower().replace(' ', '_')}": ("category", k) for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")} | {f"v_{r.lower().replace(' ', '_')}": ("source_name", r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}


@query("prj_category_views", f"WITH {SERVING}, r(view, col, v) AS (VALUES {', '.join(str((n, c, v)) for n, (c, v) in VIEWS.items())}) SELECT view, count(*) AS n, count(DISTINCT dataset) AS datasets, round(sum(value), 2) AS total FROM serving JOIN r ON starts_with(CASE col WHEN 'category' THEN category ELSE source_name END, v) GROUP BY 1")
def prj_category_views(spark, sf_dir):
    """Ten views, each what its rule lets through."""
    return category_views(serving(spark, sf_dir), VIEWS).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"), F.round(F.sum("value"), 2).alias("total"))


def payload(s: DataFrame, text: str, licence: str, excerpt: int = 20) -> DataFrame:
    """What a partner may see of each datum: the whole text where its licence is free, an excerpt where only quoting is allowed, nothing where not even that."""
    rank = F.array_position(F.array(*map(F.lit, GRADES)), F.col(licence))
    return s.withColumn("shown", F.when(rank <= 3, F.col(text)).when(rank == 4, F.substring(text, 1, excerpt)))


@query("prj_licence_payload", f"WITH {SERVING}, p AS (SELECT *, category || ' of ' || dataset_name || ' at ' || CAST(id AS VARCHAR) AS text FROM serving), s AS (SELECT *, CASE WHEN licence IN ('open', 'attribution', 'share-alike') THEN text WHEN licence = 'ask' THEN left(text, 20) END AS shown FROM p) SELECT category, list_extract({GRADES!r}, max(list_position({GRADES!r}, licence))) AS grade, count(*) FILTER (WHERE shown = text) AS whole, count(*) FILTER (WHERE shown <> text) AS excerpts, count(*) FILTER (WHERE shown IS NULL) AS withheld FROM s GROUP BY 1")
def prj_licence_payload(spark, sf_dir):
    """By category: the worst grade of its payload, and how many data are shown whole, in part or not at all."""
    text = F.concat_ws(" ", "category", F.lit("of"), "dataset_name", F.lit("at"), F.col("id").cast("string"))
    p = payload(serving(spark, sf_dir).withColumn("text", text), "text", "licence")
    return p.groupBy("category").agg(worst(F.col("licence")).alias("grade"), F.count_if(F.col("shown") == F.col("text")).alias("whole"), F.count_if(F.col("shown") != F.col("text")).alias("excerpts"), F.count_if(F.col("shown").isNull()).alias("withheld"))


def gated(people: DataFrame, requested: bool) -> DataFrame:
    """People (id, group, measure): bands with counts, unless the rows themselves are asked for explicitly."""
    band = F.when(F.col("measure") < 0, "below").when(F.col("measure") < 5000, "middle").otherwise("above")
    if requested:
        return people.select("id", "group", band.alias("band"), F.lit(1).cast("long").alias("n"))
    return people.groupBy("group", band.alias("band")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("long").alias("id"), "group", "band", "n")


_BAND = "CASE WHEN c_acctbal < 0 THEN 'below' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'above' END"


@query("prj_memorial_gate", f"SELECT NULL::BIGINT AS id, c_mktsegment AS \"group\", {_BAND} AS band, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT c_custkey, c_mktsegment, {_BAND}, 1 FROM customer WHERE c_mktsegment = 'BUILDING'")
def prj_memorial_gate(spark, sf_dir):
    """Everyone as bands; one group's people by explicit request."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("measure"))
    return gated(p, False).unionByName(gated(p.where(F.col("group") == "BUILDING"), True))


@query("prj_event_as_observation", "SELECT -event_id AS id, 'event.' || event_type AS indicator, CASE WHEN event_type IN ('purchase', 'error') THEN value END AS value, CASE WHEN hour(ts) = 0 THEN 'unknown' WHEN minute(ts) = 0 THEN 'hour' ELSE 'exact' END AS precision, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'k=' || json_extract_string(props, '$.k') || ',' ELSE '' END || 'type=' || event_type AS attrs FROM events")
def prj_event_as_observation(spark, sf_dir):
    """Events in the shape of observations: negative ids, a value by type, placeholder times, attributes with a key removed and one merged in."""
    ts = F.expr("cast(ts AS timestamp_ntz)")
    attrs = F.map_concat(F.map_filter(F.from_json("props", "map<string,int>"), lambda k, v: v % 2 == 0).cast("map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    text = F.array_join(F.transform(F.array_sort(F.map_keys("a")), lambda k: F.concat_ws("=", k, F.element_at("a", k))), ",")
    e = table(spark, sf_dir, "events").withColumn("a", attrs)
    return e.select((-F.col("event_id")).alias("id"), F.concat(F.lit("event."), "event_type").alias("indicator"), F.when(F.col("event_type").isin("purchase", "error"), F.col("value")).alias("value"), F.when(F.hour(ts) == 0, "unknown").when(F.minute(ts) == 0, "hour").otherwise("exact").alias("precision"), text.alias("attrs"))


@query("jn_prefix_hierarchy", "WITH own AS (SELECT 'c' || s_suppkey AS want, s_suppkey AS id, s_nationkey AS nation FROM supplier), cnt AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 GROUP BY 1), g AS (SELECT id, 1 AS grain, n FROM own JOIN cnt ON o_custkey = id UNION ALL SELECT id, 2, n FROM own JOIN (SELECT c_nationkey, sum(n)::BIGINT AS n FROM cnt JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0 GROUP BY 1) ON c_nationkey = nation UNION ALL SELECT id, 3, n FROM own JOIN nation ON n_nationkey = nation JOIN (SELECT n_regionkey AS r, sum(n)::BIGINT AS n FROM cnt JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ON r = n_regionkey) SELECT id, grain, n FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY grain) = 1")
def jn_prefix_hierarchy(spark, sf_dir):
    """Rows at a place, else at its nation, else at its region: the narrowest grain that has any; children are summed before they are joined."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    n = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")))  # 25 rows
    own = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    wide = own.join(c, "o_custkey").join(n, "nation")
    nations, regions = wide.where("nation % 2 = 0").groupBy("nation").agg(F.sum("n").alias("n2")), wide.groupBy("region").agg(F.sum("n").alias("n3"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_nationkey").alias("nation")).join(n, "nation")
    j = s.join(own.withColumnRenamed("n", "n1"), "o_custkey", "left").join(nations, "nation", "left").join(regions, "region", "left")
    best = F.coalesce(*[F.when(F.col(f"n{k}").isNotNull(), F.struct(F.lit(k).alias("grain"), F.col(f"n{k}").alias("n"))) for k in (1, 2, 3)])
    return j.select(F.col("o_custkey").alias("id"), best.alias("b")).where("b IS NOT NULL").select("id", "b.grain", "b.n")


# ---- summaries


def top(df: DataFrame, keys: list[str], by: Column, what: Column, n: int) -> DataFrame:
    """The n first of each key as one text: a bounded list, whatever the group's size."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), what)
    t = df.withColumn("_w", what).withColumn("_n", by).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return t.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_w", "_n"))), lambda x: F.concat_ws("=", x["_w"], x["_n"].cast("string"))), ",").alias("top"))


_A = "a AS (SELECT *, source_id AS s FROM obs WHERE modality = 'assertion')"
_TOP = "string_agg({w} || '=' || n, ',' ORDER BY n DESC, {w})"


@query("ag_insights_ckpt", f"""WITH {OBS}, {_A}, l AS (SELECT *, lag(value) OVER (PARTITION BY place_id ORDER BY t, obs_id) AS before FROM a),
f1 AS (SELECT s, count(*) AS reports, count(DISTINCT place_id) AS places, max(t) AS newest FROM a GROUP BY 1), f2 AS (SELECT s, string_agg(value || '=' || n, ',' ORDER BY n DESC, value) AS histogram FROM (SELECT s, value, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1),
f3 AS (SELECT s, {_TOP.format(w='CAST(place_id AS VARCHAR)')} AS most FROM (SELECT s, place_id, count(*) AS n FROM a GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, CAST(place_id AS VARCHAR)) <= 8) GROUP BY 1),
f4 AS (SELECT s, {_TOP.format(w='w')} AS moves FROM (SELECT s, before || '>' || value AS w, count(*) AS n FROM l WHERE before <> value GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, before || '>' || value) <= 8) GROUP BY 1),
f5 AS (SELECT s, {_TOP.format(w='w')} AS hours FROM (SELECT s, CAST((t // {HOUR} + 2) % 24 AS VARCHAR) AS w, count(*) AS n FROM a GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, CAST((t // {HOUR} + 2) % 24 AS VARCHAR)) <= 5) GROUP BY 1),
f6 AS (SELECT s, string_agg(direction || '=' || n, ',' ORDER BY n DESC, direction) AS ways FROM (SELECT s, direction, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT s AS source_id, reports, places, newest, histogram, most, coalesce(moves, '') AS moves, hours, ways FROM f1 JOIN f2 USING (s) JOIN f3 USING (s) LEFT JOIN f4 USING (s) JOIN f5 USING (s) JOIN f6 USING (s)""")
def ag_insights_ckpt(spark, sf_dir):
    """Seven facets a source: counts, histogram, places most reported, transitions, busiest hours, ways; each from one sum over the same rows."""
    o = observations(spark, sf_dir).where("modality = 'assertion'")
    count = lambda df, c: df.groupBy("source_id", c.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    facet = lambda df, name, n: top(df, ["source_id"], F.col("n"), F.col("w"), n).withColumnRenamed("top", name)
    moved = o.withColumn("before", F.lag("value").over(Window.partitionBy("place_id").orderBy("t", "obs_id"))).where("before <> value")
    out = o.groupBy("source_id").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("place_id").alias("places"), F.max("t").alias("newest"))
    for df, name, n in (
        (count(o, F.col("value")), "histogram", 99), (count(o, F.col("place_id").cast("string")), "most", 8), (count(moved, F.concat_ws(">", "before", "value")), "moves", 8),
        (count(o, F.expr(f"cast((t div {HOUR} + 2) % 24 AS string)")), "hours", 5), (count(o, F.col("direction")), "ways", 99),
    ):
        out = out.join(facet(df, name, n), "source_id", "left")
    return out.na.fill("", ["moves"])


@query("ag_incident_summary", f"""WITH {OBS}, i AS (SELECT * FROM obs WHERE value IN ('closed', 'congested')), p AS (SELECT place_id, value, count(*) AS n, count(DISTINCT source_id) AS s FROM i GROUP BY 1, 2), t AS (SELECT value, string_agg(CAST(place_id AS VARCHAR) || '=' || n, ',' ORDER BY n DESC, CAST(place_id AS VARCHAR)) AS top FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY value ORDER BY n DESC, CAST(place_id AS VARCHAR)) <= 15) GROUP BY 1)
SELECT value, sum(n)::BIGINT AS n, count(*) AS places, count(*) FILTER (WHERE s >= 2) AS corroborated, any_value(top) AS top, (SELECT count(*) FROM i WHERE i.value = p.value AND modality = 'question') AS asked FROM p JOIN t USING (value) GROUP BY 1""")
def ag_incident_summary(spark, sf_dir):
    """By type: reports, places, places that two sources give, the fifteen places with most, and how many were only asked about."""
    i = observations(spark, sf_dir).where("value IN ('closed', 'congested')")
    p = i.groupBy("place_id", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("s"), F.count_if(F.col("modality") == "question").alias("asked"))
    t = top(p, ["value"], F.col("n"), F.col("place_id").cast("string"), 15)
    return p.groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.count_if(F.col("s") >= 2).alias("corroborated"), F.sum("asked").alias("asked")).join(t, "value")


@query("ag_usage", "WITH l AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations), u AS (SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(*) FILTER (WHERE text LIKE '%?%') AS questions, count(*) FILTER (WHERE role = 'user' AND next IS NULL) AS unmet, count(*) FILTER (WHERE length(text) < 20) AS probes FROM l GROUP BY 1) SELECT *, rank() OVER (ORDER BY unmet DESC) AS rank FROM u")
def ag_usage(spark, sf_dir):
    """Use by role: turns, questions, what nobody answered, ranked, and short probes apart."""
    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    u = c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("text").contains("?")).alias("questions"), F.count_if((F.col("role") == "user") & F.col("next").isNull()).alias("unmet"), F.count_if(F.length("text") < 20).alias("probes"))
    return u.withColumn("rank", F.rank().over(Window.orderBy(F.col("unmet").desc())).cast("long"))  # a row a role


_CONF = "0.85 * pow(0.5, (t - pt) / 345600e6)"


@query("ag_backtest", f"WITH {OTHER}, s AS (SELECT pv, pv = value AS hit, {_CONF} AS conf, CASE WHEN t - pt < {HOUR} THEN 'under 1 h' WHEN t - pt < {6 * HOUR} THEN 'under 6 h' WHEN t - pt < {DAY} THEN 'under 1 d' ELSE 'older' END AS age FROM prev), f AS (SELECT 'value' AS facet, pv AS bin, hit, conf FROM s UNION ALL SELECT 'age', age, hit, conf FROM s UNION ALL SELECT 'confidence', CAST(CAST(floor(conf * 10) AS INTEGER) AS VARCHAR), hit, conf FROM s UNION ALL SELECT 'all', 'all', hit, conf FROM s) SELECT facet, bin, count(*) AS n, count(*) FILTER (WHERE conf >= 0.25) AS asserted, count(*) FILTER (WHERE conf >= 0.25 AND hit) AS right, round(avg(conf), 6) AS claimed, round(avg(hit::INT), 6) AS found FROM f GROUP BY 1, 2")
def ag_backtest(spark, sf_dir):
    """Would an earlier report of another unit have been right: by value, by age, by confidence (calibration), in all."""
    p = last_other_unit(assertions(spark, sf_dir), sources(spark)).where("pt IS NOT NULL")
    gap = F.col("t") - F.col("pt")
    conf = 0.85 * F.pow(F.lit(0.5), gap / 345600e6)
    age = F.when(gap < HOUR, "under 1 h").when(gap < 6 * HOUR, "under 6 h").when(gap < DAY, "under 1 d").otherwise("older")
    facets = F.array(*[F.struct(F.lit(n).alias("facet"), b.alias("bin")) for n, b in (("value", F.col("pv")), ("age", age), ("confidence", F.floor(conf * 10).cast("int").cast("string")), ("all", F.lit("all")))])
    d = p.select((F.col("pv") == F.col("value")).alias("hit"), conf.alias("conf"), F.explode(facets).alias("f")).select("f.*", "hit", "conf")
    said = F.col("conf") >= 0.25
    return d.groupBy("facet", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(said).alias("asserted"), F.count_if(said & F.col("hit")).alias("right"), F.round(F.avg("conf"), 6).alias("claimed"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("found"))


@query("ag_price_votes", f"WITH {_PRICE} SELECT product, price, units, named, texts FROM gd")
def ag_price_votes(spark, sf_dir):
    """One vote a unit, product and price: units, those that name their source, different texts."""
    return price_votes(spark, sf_dir).select("product", "price", "units", "named", "texts")


@query("ag_price_believed", f"WITH {_PRICE} SELECT product, max(price) FILTER (WHERE good) AS price, count(*) FILTER (WHERE good) AS rivals FROM gd GROUP BY 1 HAVING count(*) FILTER (WHERE good) >= 1")
def ag_price_believed(spark, sf_dir):
    """Products with a price that fulfils the rule, and how many do: more than one is a conflict."""
    return price_votes(spark, sf_dir).where("good").groupBy("product").agg(F.max("price").alias("price"), F.count(F.lit(1)).alias("rivals"))


_SECTIONS = ["live", "history", "incidents", "sources", "asked", "series"]


@query("rt_place_profile", f"WITH {OBS}, s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT place_id, count(*) FILTER (WHERE t > {AS_OF - 3 * DAY}) AS live, count(DISTINCT t // {DAY}) AS history, count(*) FILTER (WHERE value = 'closed') AS incidents, count(DISTINCT source_id) AS sources, count(*) FILTER (WHERE modality = 'question') AS asked FROM obs GROUP BY 1), j AS (SELECT g.*, coalesce(n, 0) AS series FROM g LEFT JOIN s ON k = place_id % 25) SELECT place_id, section, n FROM j UNPIVOT (n FOR section IN (live, history, incidents, sources, asked, series))")
def rt_place_profile(spark, sf_dir):
    """All sections of every place's profile: what is live, its history, incidents, sources, questions and series."""
    o = observations(spark, sf_dir).groupBy("place_id").agg(F.count_if(F.col("t") > AS_OF - 3 * DAY).alias("live"), F.count_distinct(F.expr(f"t div {DAY}")).alias("history"), F.count_if(F.col("value") == "closed").alias("incidents"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("modality") == "question").alias("asked"))
    s = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey").cast("long")).alias("k")).agg(F.count(F.lit(1)).alias("series"))
    j = o.withColumn("k", F.col("place_id") % 25).join(s, "k", "left").drop("k").na.fill(0, ["series"])
    return j.unpivot(["place_id"], _SECTIONS, "section", "n")


@query("set_operations", "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT 'union' AS op, k FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union all', k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', k FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except all', k FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) SELECT op, count(*) AS n, sum(k)::BIGINT AS keys FROM r GROUP BY 1")
def set_operations(spark, sf_dir):
    """Keys of two states of orders under every set operation."""
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    ops = {"union": a.union(b).distinct(), "union all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b), "except all": a.exceptAll(b)}
    out = None
    for name, df in ops.items():
        one = df.select(F.lit(name).alias("op"), "k")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))
