"""The databank's serving: dimensions, categories, licences, units, exports, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.pairs import dealt, packed
from tidemark.plans.register import query
from tidemark.sources.analogues import table

#: Grades from free to closed; the worst of several wins.
GRADES = ["open", "attribution", "share-alike", "ask", "no-redistribution"]


def worst(grade: Column) -> Column:
    """Aggregate: the worst grade of a group."""
    rank = F.array_position(F.array(*map(F.lit, GRADES)), grade)
    return F.get(F.array(*map(F.lit, GRADES)), (F.max(rank) - 1).cast("int"))


def grade(key: Column) -> Column:
    return F.get(F.array(*map(F.lit, GRADES)), (key % len(GRADES)).cast("int"))


GRADE = "list_extract(['open', 'attribution', 'share-alike', 'ask', 'no-redistribution'], CAST({} % 5 + 1 AS BIGINT))"
SERVING = f"""serving AS (SELECT o_orderkey AS id, o_orderpriority AS category, o_totalprice AS value, n_nationkey AS dataset, n_name AS dataset_name, r_regionkey AS source, r_name AS source_name,
  CASE WHEN n_nationkey % 4 = 0 THEN {GRADE.format('n_nationkey')} ELSE {GRADE.format('r_regionkey')} END AS licence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'F')"""


def serving(spark, sf_dir) -> DataFrame:
    """Current rows with their dataset and source; a dataset's licence, where it has one, stands before its source's."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nations and regions are fixed tables of 25 and 5 rows
    n, r = F.broadcast(table(spark, sf_dir, "nation")), F.broadcast(table(spark, sf_dir, "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.col("n_nationkey") % 4 == 0, grade(F.col("n_nationkey")))
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("value"), F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("dataset_name"), F.col("r_regionkey").alias("source"), F.col("r_name").alias("source_name"), F.coalesce(own, grade(F.col("r_regionkey"))).alias("licence"))


@query("prj_databank_serving", f"WITH {SERVING} SELECT * FROM serving")
def prj_databank_serving(spark, sf_dir):
    return serving(spark, sf_dir)


@query("jn_dim_inner", f"WITH {SERVING} SELECT dataset_name, source_name, count(*) AS n FROM serving GROUP BY ALL")
def jn_dim_inner(spark, sf_dir):
    return serving(spark, sf_dir).groupBy("dataset_name", "source_name").agg(F.count(F.lit(1)).alias("n"))


@query("jn_dim_left", "SELECT c_custkey AS id, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn_dim_left(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left").na.fill(0)


@query("jn_semi_anti", "SELECT 'with' AS which, count(*) AS n FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'without', count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def jn_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda kind, name: c.join(o, on, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("which"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("prj_licence_tiers", f"WITH {SERVING} SELECT 'open' AS tier, count(*) AS n FROM serving WHERE licence IN ('open', 'attribution') UNION ALL SELECT 'share-alike', count(*) FROM serving WHERE licence IN ('open', 'attribution', 'share-alike') UNION ALL SELECT 'bulk', count(*) FROM serving WHERE licence <> 'no-redistribution'")
def prj_licence_tiers(spark, sf_dir):
    s = serving(spark, sf_dir)
    tiers = {"open": F.col("licence").isin("open", "attribution"), "share-alike": F.col("licence").isin("open", "attribution", "share-alike"), "bulk": F.col("licence") != "no-redistribution"}
    one = s.agg(*[F.count_if(v).alias(k) for k, v in tiers.items()])
    return one.unpivot([], list(tiers), "tier", "n")


@query("ag_licence_table", f"WITH {SERVING} SELECT licence, source_name, count(*) AS n, count(DISTINCT dataset) AS datasets FROM serving GROUP BY ALL")
def ag_licence_table(spark, sf_dir):
    return serving(spark, sf_dir).groupBy("licence", "source_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"))


@query("ag_withheld", f"WITH {SERVING} SELECT CASE licence WHEN 'ask' THEN 'permission pending' WHEN 'no-redistribution' THEN 'not allowed' END AS reason, dataset_name, count(*) AS n FROM serving WHERE licence IN ('ask', 'no-redistribution') GROUP BY ALL")
def ag_withheld(spark, sf_dir):
    held = serving(spark, sf_dir).where(F.col("licence").isin("ask", "no-redistribution"))
    return held.groupBy(F.when(F.col("licence") == "ask", "permission pending").otherwise("not allowed").alias("reason"), "dataset_name").agg(F.count(F.lit(1)).alias("n"))


@query("ag_totals_cat", f"WITH {SERVING} SELECT dataset, count(*) AS n, round(min(value), 2) AS low, round(max(value), 2) AS high, count(DISTINCT licence) AS licences FROM serving GROUP BY 1")
def ag_totals_cat(spark, sf_dir):
    return serving(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 2).alias("low"), F.round(F.max("value"), 2).alias("high"), F.count_distinct("licence").alias("licences"))


@query("ag_concepts", f"WITH {SERVING} SELECT r_name AS concept, count(DISTINCT category) AS indicators, count(id) AS rows FROM region LEFT JOIN serving ON source = r_regionkey GROUP BY 1")
def ag_concepts(spark, sf_dir):
    s = serving(spark, sf_dir)
    return table(spark, sf_dir, "region").join(s, F.col("source") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("concept")).agg(F.count_distinct("category").alias("indicators"), F.count("id").alias("rows"))


@query("ag_dataset_floor", f"WITH {SERVING} SELECT dataset, round(100.0 * count(*) FILTER (WHERE value > 100000) / count(*), 4) AS located, 100.0 * count(*) FILTER (WHERE value > 100000) / count(*) >= 60 AS ok FROM serving GROUP BY 1")
def ag_dataset_floor(spark, sf_dir):
    share = 100.0 * F.count_if(F.col("value") > 100000) / F.count(F.lit(1))
    return serving(spark, sf_dir).groupBy("dataset").agg(F.round(share, 4).alias("located"), (share >= 60).alias("ok"))


@query("ag_event_register", f"WITH {SERVING} SELECT category, count(*) AS n, CASE WHEN category <> '5-LOW' THEN round(sum(value), 2) END AS total, min(value) AS low, max(value) AS high, bool_or(value > 400000) AS big FROM serving GROUP BY 1")
def ag_event_register(spark, sf_dir):
    g = serving(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.bool_or(F.col("value") > 400000).alias("big"))
    return g.withColumn("total", F.when(F.col("category") != "5-LOW", F.col("total")))


@query("rs_route", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '5-LOW' THEN 'slow' ELSE 'default' END AS dataset, count(*) AS n FROM orders GROUP BY 1")
def rs_route(spark, sf_dir):
    routes = F.create_map(*[F.lit(x) for x in ("1-URGENT", "fast", "2-HIGH", "fast", "5-LOW", "slow")])
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(routes[F.col("o_orderpriority")], F.lit("default")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("jn_closure_compose", "WITH e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT a.child, b.parent, 2 FROM e a JOIN e b ON a.parent = b.child")
def jn_closure_compose(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    e = c.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    two = e.join(e.select(F.col("child").alias("parent"), F.col("parent").alias("top")), "parent").select("child", F.col("top").alias("parent"), F.lit(2).alias("depth"))
    return e.withColumn("depth", F.lit(1)).unionByName(two)


# ---- geography: places on a plane of degrees derived from keys

PLACES = "pl AS (SELECT c_custkey AS id, 31.0 + (c_custkey * 37 % 1000) / 1000.0 AS lat, 34.5 + (c_custkey * 91 % 1000) / 1000.0 AS lon FROM customer), su AS (SELECT s_suppkey AS id, 31.0 + (s_suppkey * 53 % 1000) / 1000.0 AS lat, 34.5 + (s_suppkey * 17 % 1000) / 1000.0 AS lon FROM supplier)"
METRES = "111195.0 * sqrt(pow({0}.lat - {1}.lat, 2) + pow(({0}.lon - {1}.lon) * cos(radians(31.5)), 2))"


def places(spark, sf_dir, name: str, key: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), (31.0 + (k * a % 1000) / 1000.0).alias("lat"), (34.5 + (k * b % 1000) / 1000.0).alias("lon"))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane about 31.5 degrees north."""
    return 111195.0 * F.sqrt(F.pow(lat1 - lat2, 2) + F.pow((lon1 - lon2) * F.cos(F.radians(F.lit(31.5))), 2))


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a_id, b_id, m) at most radius metres apart: an equi-join on grid cells of the radius's size and their neighbours.

    What meets are packs of a cell's places; their pairs are made in tasks that they are dealt to, as a
    cell can hold many and the join, by its bytes, few tasks.
    """
    cell = radius / 111195.0
    lon_cell = cell / 0.8  # a degree of longitude is at least 0.8 of one of latitude here
    grid = [F.floor(F.col("lat") / cell).alias("gy"), F.floor(F.col("lon") / lon_cell).alias("gx")]
    packs = lambda df, name: packed(df.select(*grid, F.struct("id", "lat", "lon").alias(name)), ["gy", "gx"], name)
    around = F.explode(F.array(*[F.struct((F.col("gy") + i).alias("gy"), (F.col("gx") + j).alias("gx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    met = packs(a, "a").select("a", around.alias("g")).select("a", "g.*").join(packs(b, "b"), ["gy", "gx"]).select("a", "b")
    m = metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return dealt(met, "a", "b").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), m.alias("m")).where(F.col("m") <= radius)


def _pair(spark, sf_dir):
    return places(spark, sf_dir, "supplier", "s_suppkey", 53, 17), places(spark, sf_dir, "customer", "c_custkey", 37, 91)


@query("jn_spatial_radius", f"WITH {PLACES} SELECT su.id AS a_id, pl.id AS b_id, round({METRES.format('su', 'pl')}, 3) AS m FROM su JOIN pl ON {METRES.format('su', 'pl')} <= 3000")
def jn_spatial_radius(spark, sf_dir):
    return within(*_pair(spark, sf_dir), 3000.0).withColumn("m", F.round("m", 3))


@query("rt_checkpoints_nearby", f"WITH {PLACES} SELECT id, round(m, 3) AS m FROM (SELECT id, 111195.0 * sqrt(pow(lat - 31.5, 2) + pow((lon - 35.0) * cos(radians(31.5)), 2)) AS m FROM pl) WHERE m <= 10000 ORDER BY m, id LIMIT 20")
def rt_checkpoints_nearby(spark, sf_dir):
    p = places(spark, sf_dir, "customer", "c_custkey", 37, 91)
    box = F.col("lat").between(31.4, 31.6) & F.col("lon").between(34.87, 35.13)
    m = metres(F.col("lat"), F.col("lon"), F.lit(31.5), F.lit(35.0))
    return p.where(box).withColumn("m", m).where("m <= 10000").orderBy("m", "id").limit(20).select("id", F.round("m", 3).alias("m"))


@query("jn_colocated_cluster", f"WITH {PLACES} SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, min(id) AS first, count(*) AS n FROM pl GROUP BY 1, 2")
def jn_colocated_cluster(spark, sf_dir):
    p = places(spark, sf_dir, "customer", "c_custkey", 37, 91)
    return p.groupBy(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


#: A route as points in order.
ROUTE = [(31.10, 34.60), (31.35, 34.85), (31.50, 35.00), (31.80, 35.20)]
KM_LAT, KM_LON = 111195.0, 111195.0 * 0.8526401643540922


def along(p: DataFrame, route: list[tuple[float, float]] = ROUTE) -> DataFrame:
    """Each place's distance to a route and how far along it (0 to 1) the nearest point lies; segments are exploded literals."""
    lengths = [(((b[0] - a[0]) * KM_LAT) ** 2 + ((b[1] - a[1]) * KM_LON) ** 2) ** 0.5 for a, b in zip(route, route[1:])]
    total, at, segs = sum(lengths), 0.0, []
    for (a, b), n in zip(zip(route, route[1:]), lengths):
        segs.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in (("y1", a[0]), ("x1", a[1]), ("dy", (b[0] - a[0]) * KM_LAT), ("dx", (b[1] - a[1]) * KM_LON), ("n", n), ("at", at))]))
        at += n
    s = p.withColumn("s", F.explode(F.array(*segs))).select("id", (F.col("lat") - F.col("s.y1")).alias("y"), (F.col("lon") - F.col("s.x1")).alias("x"), "s.*")
    s = s.withColumn("y", F.col("y") * KM_LAT).withColumn("x", F.col("x") * KM_LON)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") * F.col("dy") + F.col("x") * F.col("dx")) / (F.col("n") * F.col("n"))))
    s = s.withColumn("t", t).withColumn("m", F.sqrt(F.pow(F.col("y") - F.col("t") * F.col("dy"), 2) + F.pow(F.col("x") - F.col("t") * F.col("dx"), 2)))
    best = s.groupBy("id").agg(F.min(F.struct(F.round("m", 6).alias("m"), ((F.col("at") + F.col("t") * F.col("n")) / total).alias("f"))).alias("b"))
    return best.select("id", F.col("b.m").alias("m"), F.col("b.f").alias("fraction"))


SEGS = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]}, {k})" for k, (a, b) in enumerate(zip(ROUTE, ROUTE[1:])))
LINE = f"""{PLACES}, sg(y1, x1, y2, x2, k) AS (VALUES {SEGS}), sl AS (SELECT CAST(y1 AS DOUBLE) AS y1, CAST(x1 AS DOUBLE) AS x1, k, (y2 - y1) * {KM_LAT} AS dy, (x2 - x1) * {KM_LON} AS dx FROM sg), sn AS (SELECT *, sqrt(dy * dy + dx * dx) AS n FROM sl), so AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM sn),
pt AS (SELECT id, dy, dx, n, before, total, (lat - y1) * {KM_LAT} AS y, (lon - x1) * {KM_LON} AS x FROM pl, so), tt AS (SELECT *, greatest(0, least(1, (y * dy + x * dx) / (n * n))) AS t FROM pt), mm AS (SELECT id, round(sqrt(pow(y - t * dy, 2) + pow(x - t * dx, 2)), 6) AS m, (before + t * n) / total AS f FROM tt),
line AS (SELECT id, m, f AS fraction FROM mm QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, f) = 1)"""


@query("jn_spatial_line", f"WITH {LINE} SELECT id, round(m, 2) AS m, round(fraction, 5) AS fraction, CASE WHEN m <= 300 THEN 'on' ELSE 'near' END AS place FROM line WHERE m <= 3000")
def jn_spatial_line(spark, sf_dir):
    a = along(places(spark, sf_dir, "customer", "c_custkey", 37, 91)).where("m <= 3000")
    return a.select("id", F.round("m", 2).alias("m"), F.round("fraction", 5).alias("fraction"), F.when(F.col("m") <= 300, "on").otherwise("near").alias("place"))


@query("wn_longest_gap", f"WITH {LINE}, g AS (SELECT fraction, lead(fraction) OVER (ORDER BY fraction, id) - fraction AS gap FROM line WHERE m <= 300) SELECT round(max(gap), 5) AS gap, round(max_by(fraction, gap), 5) AS start FROM g")
def wn_longest_gap(spark, sf_dir):
    """The longest unwatched stretch between the places on a route. Slices of the route are summed up first: each one's longest inner
    gap and its ends; only the slices, a fixed number, meet in one window."""
    on = along(places(spark, sf_dir, "customer", "c_custkey", 37, 91)).where("m <= 300").withColumn("slice", F.floor(F.col("fraction") * 256))
    inner = on.withColumn("gap", F.lead("fraction").over(Window.partitionBy("slice").orderBy("fraction", "id")) - F.col("fraction"))
    s = inner.groupBy("slice").agg(F.min("fraction").alias("lo"), F.max("fraction").alias("hi"), F.max(F.struct("gap", (-F.col("fraction")).alias("at"))).alias("x"))
    s = s.withColumn("between", F.lead("lo").over(Window.orderBy("slice")) - F.col("hi"))
    best = F.greatest(F.struct(F.coalesce("x.gap", F.lit(-1.0)).alias("gap"), (-F.col("x.at")).alias("start")), F.struct(F.coalesce("between", F.lit(-1.0)).alias("gap"), F.col("hi").alias("start")))
    found = F.col("b.gap") >= 0  # else there are no two places
    return s.agg(F.max(best).alias("b")).select(F.when(found, F.round("b.gap", 5)).alias("gap"), F.when(found, F.round("b.start", 5)).alias("start"))


@query("wn_top_n_bucket", f"WITH {LINE} SELECT id, CAST(floor(fraction * 8) AS BIGINT) AS bucket FROM line WHERE m <= 3000 QUALIFY row_number() OVER (PARTITION BY floor(fraction * 8) ORDER BY m, id) = 1")
def wn_top_n_bucket(spark, sf_dir):
    a = along(places(spark, sf_dir, "customer", "c_custkey", 37, 91)).where("m <= 3000")
    return a.groupBy(F.floor(F.col("fraction") * 8).alias("bucket")).agg(F.min_by("id", F.struct("m", "id")).alias("id"))


@query("mt_attribution", f"WITH {SERVING} SELECT source_name, string_agg(DISTINCT dataset_name, '; ' ORDER BY dataset_name) AS credits FROM serving GROUP BY 1")
def mt_attribution(spark, sf_dir):
    return serving(spark, sf_dir).groupBy("source_name").agg(F.array_join(F.array_sort(F.collect_set("dataset_name")), "; ").alias("credits"))


@query("mt_cross_dataset_dup", "SELECT a.p_partkey AS closed, min(b.p_partkey) AS survivor FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size IS NOT DISTINCT FROM b.p_size AND b.p_partkey < a.p_partkey GROUP BY 1")
def mt_cross_dataset_dup(spark, sf_dir):
    """Rows that say what an earlier one says are closed in its favour; one sum per group, not all pairs."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    first = p.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("survivor"))
    met = p.alias("p").join(first.alias("f"), (F.col("p.p_name") == F.col("f.p_name")) & F.col("p.p_size").eqNullSafe(F.col("f.p_size")))
    return met.where("p_partkey > survivor").select(F.col("p_partkey").alias("closed"), "survivor")
