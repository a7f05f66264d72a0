"""Places: routes and their verdict, name resolution, administrative codes, merging of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.catalogue import KM_LAT, KM_LON, PLACES, places, within
from tidemark.operators.composites import AREAS, EDGES, contains
from tidemark.plans.register import query
from tidemark.plans.steps import spread, written
from tidemark.sources.analogues import AS_OF, DAY, OBS, observations, table

CORRIDOR, NEAR_MISS, GAP_KM, ENDS_KM, WATCHED = 300.0, 3000.0, 10.0, 10.0, 0.6


# ---- routes


def corridor(routes: DataFrame, p: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Places (id, lat, lon) within radius of straight routes (route, y1, x1, y2, x2): rows (route, km, id, m, along) and the places' columns named in keep.

    Points along a route, at most `radius` apart, meet the places of their own and the neighbouring grid cells.
    """
    cell_y, cell_x = 1.2 * radius / KM_LAT, 1.2 * radius / KM_LON
    dy, dx = (F.col("y2") - F.col("y1")) * KM_LAT, (F.col("x2") - F.col("x1")) * KM_LON
    r = routes.withColumns({"dy": dy, "dx": dx}).withColumn("n", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))
    steps = F.greatest(F.ceil(F.col("n") / radius), F.lit(1))
    at = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long")))).withColumn("f", F.col("k") / steps)
    near = [F.struct((F.floor((F.col("y1") + F.col("f") * (F.col("y2") - F.col("y1"))) / cell_y) + i).alias("gy"), (F.floor((F.col("x1") + F.col("f") * (F.col("x2") - F.col("x1"))) / cell_x) + j).alias("gx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    cells = at.select("route", "y1", "x1", "dy", "dx", "n", F.explode(F.array(*near)).alias("g")).distinct()
    met = cells.join(p.withColumn("g", F.struct(F.floor(F.col("lat") / cell_y).alias("gy"), F.floor(F.col("lon") / cell_x).alias("gx"))), "g")
    y, x = (F.col("lat") - F.col("y1")) * KM_LAT, (F.col("lon") - F.col("x1")) * KM_LON
    t = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y * F.col("dy") + x * F.col("dx")) / (F.col("n") * F.col("n"))))).otherwise(0.0)
    met = met.withColumn("along", t).withColumn("m", F.sqrt(F.pow(y - F.col("along") * F.col("dy"), 2) + F.pow(x - F.col("along") * F.col("dx"), 2)))
    return met.where(F.col("m") <= radius).select("route", (F.col("n") / 1000).alias("km"), "id", "m", "along", *keep)


def gap(marks: Column) -> Column:
    """The longest stretch between neighbours of 0, the marks and 1."""
    m = F.array_sort(F.concat(F.array(F.lit(0.0)), marks, F.array(F.lit(1.0))))
    return F.array_max(F.zip_with(F.slice(m, 2, F.size(m) - 1), F.slice(m, 1, F.size(m) - 1), lambda x, y: x - y))  # sorted a fixed number of times, not once a mark


def verdicts(routes: DataFrame, p: DataFrame, states: DataFrame) -> DataFrame:
    """A verdict a route. What lies on it decides; what nobody watches, and closures beside its ends, cast doubt.

    blocked, where a checkpoint is closed; unknown, where none is known; slow, where one is; else
    unverified, where there is doubt; else likely_open. Rows (route, km, checkpoints, known, longest_gap_km, verdict).
    """
    shape = ["y1", "x1", "y2", "x2"]  # routes of one shape are judged once
    shapes = routes.select(*shape).distinct().withColumn("route", F.struct(*shape))
    p = p.join(states, "id", "left").withColumn("value", F.coalesce("value", F.lit("unknown")))
    # beyond the corridor only closures count, so only they meet the wider one
    wide = corridor(shapes, p.where("value = 'closed'"), NEAR_MISS, ("value",)).where(F.col("m") > CORRIDOR)
    c = corridor(shapes, p, CORRIDOR, ("value",)).unionByName(wide)
    on, known = F.col("m") <= CORRIDOR, F.col("value") != "unknown"
    end = F.least(F.lit(0.5), ENDS_KM / F.col("km"))
    g = c.groupBy("route", "km").agg(
        F.count_if(on).alias("checkpoints"), F.count_if(on & known).alias("known"), F.count_if(on & (F.col("value") == "closed")).alias("closed"), F.count_if(on & F.col("value").isin("slow", "congested")).alias("slow"),
        F.collect_list(F.when(on, F.col("along"))).alias("marks"), F.collect_list(F.when(on & known, F.col("along"))).alias("watched"),
        F.count_if(~on & (F.col("value") == "closed") & ((F.col("along") <= end) | (F.col("along") >= 1 - end))).alias("ends"),
    ).select("route.*", *"checkpoints known closed slow marks watched ends".split())
    none = F.array().cast("array<double>")
    g = g.withColumns({"gap": gap(F.coalesce("marks", none)), "seen": gap(F.coalesce("watched", none))}).drop("marks", "watched")
    km = F.sqrt(F.pow((F.col("y2") - F.col("y1")) * KM_LAT, 2) + F.pow((F.col("x2") - F.col("x1")) * KM_LON, 2)) / 1000
    g = routes.select("route", *shape, km.alias("km")).join(g, shape, "left").na.fill(0, ["checkpoints", "known", "closed", "slow", "ends"])
    g = g.withColumns({"gap": F.round(F.col("km") * F.coalesce("gap", F.lit(1.0)), 1), "seen": F.round(1 - F.coalesce("seen", F.lit(1.0)), 2)})
    doubt = (F.col("gap") >= GAP_KM) | (F.col("seen") < WATCHED) | (F.col("ends") > 0)
    verdict = F.when(F.col("closed") > 0, "blocked").when(F.col("known") == 0, "unknown").when(F.col("slow") > 0, "slow").when(doubt, "unverified").otherwise("likely_open")
    return g.select("route", F.round("km", 1).alias("km"), "checkpoints", "known", F.col("gap").alias("longest_gap_km"), verdict.alias("verdict"))


def routes_of(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("route"), *[(base + (k * a % 1000) / 4000.0).alias(n) for n, base, a in (("y1", 31.3, 53), ("x1", 34.8, 17), ("y2", 31.4, 29), ("x2", 34.9, 71))])


def states_of(spark, sf_dir) -> DataFrame:
    """The newest assertion of the last week at each of the dense places."""
    o = observations(spark, sf_dir).where((F.col("modality") == "assertion") & (F.col("t") > AS_OF - 7 * DAY))
    return o.groupBy(F.col("place_id").alias("id")).agg(F.max_by("value", F.struct("t", "obs_id")).alias("value")).withColumn("value", F.when(F.col("value") == "other", "unknown").otherwise(F.col("value")))


def gates(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (31.3 + (k * 37 % 1000) / 2500.0).alias("lat"), (34.8 + (k * 91 % 997) / 2500.0).alias("lon"))


GATES = "gt AS (SELECT c_custkey AS id, 31.3 + (c_custkey * 37 % 1000) / 2500.0 AS lat, 34.8 + (c_custkey * 91 % 997) / 2500.0 AS lon FROM customer)"
STATES = f"st AS (SELECT place_id AS id, CASE WHEN max_by(value, (t, obs_id)) = 'other' THEN 'unknown' ELSE max_by(value, (t, obs_id)) END AS value FROM obs WHERE modality = 'assertion' AND t > {AS_OF} - {7 * DAY} GROUP BY 1)"
VERDICT = f"""WITH {OBS}, {GATES}, {STATES},
rt AS (SELECT s_suppkey AS route, 31.3 + (s_suppkey * 53 % 1000) / 4000.0 AS y1, 34.8 + (s_suppkey * 17 % 1000) / 4000.0 AS x1, 31.4 + (s_suppkey * 29 % 1000) / 4000.0 AS y2, 34.9 + (s_suppkey * 71 % 1000) / 4000.0 AS x2 FROM supplier),
rd AS (SELECT *, (y2 - y1) * {KM_LAT} AS dy, (x2 - x1) * {KM_LON} AS dx FROM rt), rn AS (SELECT *, sqrt(dy * dy + dx * dx) AS n FROM rd),
pr AS (SELECT route, n, gt.id, dy, dx, (lat - y1) * {KM_LAT} AS y, (lon - x1) * {KM_LON} AS x FROM rn, gt), pa AS (SELECT *, greatest(0.0, least(1.0, (y * dy + x * dx) / (n * n))) AS f FROM pr),
pm AS (SELECT *, sqrt(pow(y - f * dy, 2) + pow(x - f * dx, 2)) AS m FROM pa), c AS (SELECT route, n / 1000 AS km, m, f, coalesce(value, 'unknown') AS value FROM pm LEFT JOIN st ON st.id = pm.id WHERE m <= 3000),
mk AS (SELECT route, f, 1 AS k FROM c WHERE m <= 300 UNION ALL SELECT route, f, 2 FROM c WHERE m <= 300 AND value <> 'unknown' UNION ALL SELECT route, f, k FROM rn, (VALUES (0.0, 1), (1.0, 1), (0.0, 2), (1.0, 2)) AS v(f, k)),
gp AS (SELECT route, k, max(d) AS d FROM (SELECT route, k, f - lag(f) OVER (PARTITION BY route, k ORDER BY f) AS d FROM mk) GROUP BY ALL),
ag AS (SELECT route, count(*) FILTER (WHERE m <= 300) AS checkpoints, count(*) FILTER (WHERE m <= 300 AND value <> 'unknown') AS known, count(*) FILTER (WHERE m <= 300 AND value = 'closed') AS closed, count(*) FILTER (WHERE m <= 300 AND value IN ('slow', 'congested')) AS slow,
  count(*) FILTER (WHERE m > 300 AND value = 'closed' AND (f <= least(0.5, 10 / km) OR f >= 1 - least(0.5, 10 / km))) AS ends FROM c GROUP BY 1)
SELECT rn.route, round(n / 1000, 1) AS km, coalesce(checkpoints, 0) AS checkpoints, coalesce(known, 0) AS known, round(n / 1000 * a.d, 1) AS longest_gap_km,
  CASE WHEN closed > 0 THEN 'blocked' WHEN coalesce(known, 0) = 0 THEN 'unknown' WHEN slow > 0 THEN 'slow' WHEN round(n / 1000 * a.d, 1) >= 10 OR round(1 - b.d, 2) < 0.6 OR ends > 0 THEN 'unverified' ELSE 'likely_open' END AS verdict
FROM rn JOIN gp a ON a.route = rn.route AND a.k = 1 JOIN gp b ON b.route = rn.route AND b.k = 2 LEFT JOIN ag ON ag.route = rn.route"""


@query("route_verdict", VERDICT)
def route_verdict(spark, sf_dir):
    return verdicts(routes_of(spark, sf_dir), gates(spark, sf_dir), states_of(spark, sf_dir))


# ---- polylines


def encode_polyline(points: Column) -> Column:
    """An array of (lat, lon) in whole millionths as a polyline: zigzag differences in groups of five bits."""
    flat = F.flatten(F.transform(points, lambda p, i: F.array(p["lat"] - F.when(i > 0, F.get(points, i - 1)["lat"]).otherwise(0), p["lon"] - F.when(i > 0, F.get(points, i - 1)["lon"]).otherwise(0))))
    zigzag = F.transform(flat, lambda v: F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)))
    groups = F.transform(zigzag, lambda z: F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.when((k == 0) | (F.expr("0L") + z >= F.pow(F.lit(32.0), k).cast("long")), F.floor(z / F.pow(F.lit(32.0), k)) % 32 + F.when(z >= F.pow(F.lit(32.0), k + 1).cast("long"), 32).otherwise(0) + 63)), lambda b: b.isNotNull()))
    return F.array_join(F.transform(F.flatten(groups), lambda b: F.char(b)), "")


def decode_polyline(line: Column, unit: float = 1e6) -> Column:
    """An array of (lat, lon) from a polyline; a millionth of a degree is the unit, not the more common hundred-thousandth."""
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0.0).alias("shift"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        b = F.ascii(ch) - 63
        acc = s["acc"] + ((b % 32) * F.pow(F.lit(2.0), s["shift"])).cast("long")
        value = F.when(acc % 2 == 1, -((acc + 1) / 2).cast("long")).otherwise((acc / 2).cast("long"))
        more = b >= 32
        return F.struct(F.when(more, acc).otherwise(F.lit(0).cast("long")).alias("acc"), F.when(more, s["shift"] + 5).otherwise(F.lit(0.0)).alias("shift"), F.when(more, s["out"]).otherwise(F.concat(s["out"], F.array(value))).alias("out"))

    def path(s: Column) -> Column:
        add = F.aggregate(F.sequence(F.lit(0), (F.size(s["out"]) / 2).cast("int") - 1), F.array(F.struct(F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"))), lambda a, i: F.concat(a, F.array(F.struct((F.element_at(a, -1)["lat"] + F.get(s["out"], 2 * i)).alias("lat"), (F.element_at(a, -1)["lon"] + F.get(s["out"], 2 * i + 1)).alias("lon")))))
        return F.transform(F.slice(add, 2, F.size(add) - 1), lambda p: F.struct((p["lat"] / unit).alias("lat"), (p["lon"] / unit).alias("lon")))

    return F.when(F.length(line) > 0, F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step, path))


@query("fn_decode_polyline", "SELECT c_custkey AS id, i, (31000000 + c_custkey * 3701 % 999983 - i * c_custkey % 7919) / 1e6 AS lat, (34500000 - c_custkey * 9103 % 999979 + i * 1234) / 1e6 AS lon FROM customer, range(3) AS r(i)")
def fn_decode_polyline(spark, sf_dir):
    """Paths of three points, written as polylines and read again."""
    k = F.col("c_custkey").cast("long")
    points = F.array(*[F.struct((31000000 + k * 3701 % 999983 - i * k % 7919).alias("lat"), (34500000 - k * 9103 % 999979 + i * 1234).alias("lon")) for i in range(3)])
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), points.alias("p")).select("id", encode_polyline(F.col("p")).alias("line"))
    got = lines.select("id", F.posexplode(decode_polyline(F.col("line"))).alias("i", "p"))
    return got.select("id", F.col("i").cast("long").alias("i"), "p.lat", "p.lon")


# ---- administrative codes


def area_of(p: DataFrame, spark) -> DataFrame:
    """Each place's smallest containing area: an equi-join on bands of latitude with the fixed table of polygons."""
    def size(c):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:] + c[:1]))) / 2

    rows = [(k, round(size(c), 9), b, [tuple(map(float, e[1:])) for e in EDGES if e[0] == k]) for k, c in AREAS.items() for b in range(int(min(a for a, _ in c) * 10), int(max(a for a, _ in c) * 10) + 1)]
    polygons = F.broadcast(spark.createDataFrame(rows, "k int, size double, band long, edges array<struct<y1:double,x1:double,y2:double,x2:double>>"))  # five areas
    hit = p.withColumn("band", F.floor(F.col("lat") * 10)).join(polygons, "band").where(contains(F.col("lat"), F.col("lon"), F.col("edges")))
    return hit.groupBy("id").agg(F.min_by("k", F.struct("size", "k")).alias("k"))


_CENTRES = {k: (sum(a for a, _ in c) / len(c), sum(b for _, b in c) / len(c)) for k, c in AREAS.items()}
_INSIDE = f"e(k, y1, x1, y2, x2) AS (VALUES {', '.join(map(str, EDGES))}), ed AS (SELECT k, y1::DOUBLE AS y1, x1::DOUBLE AS x1, y2::DOUBLE AS y2, x2::DOUBLE AS x2 FROM e), sz AS (SELECT k, round(abs(sum(y1 * x2 - y2 * x1)) / 2, 9) AS size FROM ed GROUP BY 1), hit AS (SELECT id, k FROM pl, ed WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, k HAVING count(*) % 2 = 1), inside AS (SELECT id, k FROM hit JOIN sz USING (k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY size, k) = 1)"
_NEAR = "ce(k, cy, cx) AS (VALUES " + ", ".join(f"({k}, CAST({y} AS DOUBLE), CAST({x} AS DOUBLE))" for k, (y, x) in _CENTRES.items()) + f"), nr AS (SELECT id, k, sqrt(pow((lat - cy) * {KM_LAT}, 2) + pow((lon - cx) * {KM_LON}, 2)) AS m FROM pl, ce QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, k) = 1)"


def backfilled(p: DataFrame, spark) -> DataFrame:
    """Rows (id, code, basis, m): the containing area's code, else the nearest centre's within 50 km; how it was found is kept."""
    away = F.array_min(F.array(*[F.struct(F.sqrt(F.pow((F.col("lat") - y) * KM_LAT, 2) + F.pow((F.col("lon") - x) * KM_LON, 2)).alias("m"), F.lit(k).alias("k")) for k, (y, x) in _CENTRES.items()]))
    j = p.withColumn("near", away).join(area_of(p, spark).withColumnRenamed("k", "own"), "id", "left")
    code = F.coalesce("own", F.when(F.col("near.m") < 50000, F.col("near.k")))
    basis = F.when(F.col("own").isNotNull(), "spatial:contains").when(code.isNotNull(), "spatial:nearest")
    return j.select("id", F.concat(F.lit("A"), code.cast("string")).alias("code"), basis.alias("basis"), F.when(basis == "spatial:nearest", F.round("near.m")).alias("m"))


@query("mt_admin_backfill", f"WITH {PLACES}, {_INSIDE}, {_NEAR} SELECT pl.id, 'A' || coalesce(inside.k, CASE WHEN nr.m < 50000 THEN nr.k END) AS code, CASE WHEN inside.k IS NOT NULL THEN 'spatial:contains' WHEN nr.m < 50000 THEN 'spatial:nearest' END AS basis, CASE WHEN inside.k IS NULL AND nr.m < 50000 THEN round(nr.m) END AS m FROM pl LEFT JOIN inside USING (id) LEFT JOIN nr ON nr.id = pl.id")
def mt_admin_backfill(spark, sf_dir):
    return backfilled(places(spark, sf_dir, "customer", "c_custkey", 37, 91), spark)


#: Codes of the older scheme and the newer one's.
OLD_CODES = {"N0": "A0", "N1": "A2", "N2": "A1", "N3": "A4", "N4": "A3"}


@query("mt_code_remap", f"WITH {PLACES}, {_INSIDE}, cur AS (SELECT id, 'N' || id % 7 AS code FROM pl), mp(a, b) AS (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in OLD_CODES.items())}) SELECT id, coalesce('A' || inside.k, mp.b, cur.code) AS code, CASE WHEN inside.k IS NOT NULL OR mp.b IS NOT NULL THEN cur.code END AS before, CASE WHEN inside.k IS NOT NULL THEN 'spatial' WHEN mp.b IS NOT NULL THEN 'table' ELSE 'kept' END AS source FROM cur LEFT JOIN inside USING (id) LEFT JOIN mp ON mp.a = cur.code")
def mt_code_remap(spark, sf_dir):
    """One scheme of codes: from the containing area, else a fixed table; the previous code is kept beside it."""
    p = places(spark, sf_dir, "customer", "c_custkey", 37, 91)
    j = p.withColumn("old", F.concat(F.lit("N"), (F.col("id") % 7).cast("string"))).join(area_of(p, spark), "id", "left")
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in OLD_CODES.items() for x in kv]), F.col("old"))
    own = F.concat(F.lit("A"), F.col("k").cast("string"))
    source = F.when(own.isNotNull(), "spatial").when(mapped.isNotNull(), "table").otherwise("kept")
    return j.select("id", F.coalesce(own, mapped, "old").alias("code"), F.when(source != "kept", F.col("old")).alias("before"), source.alias("source"))


# ---- names

#: Generic words that say nothing about which place is meant.
GENERIC = "north south east west near city town village camp checkpoint gate road street old new".split()


def fold_for_match(text: Column) -> Column:
    """A matching key: normalised, fused articles taken off, generic words dropped wherever they stand."""
    words = F.transform(F.split(X.normalize(text), " "), lambda w: F.when(F.length(F.regexp_replace(w, "^(?:لل|[بلكفو]ال|ال)", "")) >= 2, F.regexp_replace(w, "^(?:لل|[بلكفو]ال|ال)", "")).otherwise(w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(GENERIC)), " ")


FIRST = "beit deir kafr ein khirbet wadi tell jabal bir abu".split()
SECOND = "salim awad marda yatta zeita rafat halhul aqraba jamain qibya turmus sinjil bidya hares iskaka luban".split()
_FIRST, _SECOND = (f"list_extract({w!r}, CAST({{}} AS BIGINT) + 1)" for w in (FIRST, SECOND))


def gazetteer(spark, sf_dir) -> DataFrame:
    """Places with names of two or three words: (id, name, kind)."""
    k = F.col("c_custkey")
    word = lambda ws, at: F.get(F.array(*map(F.lit, ws)), at.cast("int"))
    third = F.when(k >= 160, F.concat(F.lit(" "), F.conv((k / 160).cast("long").cast("string"), 10, 26))).otherwise("")
    name = F.concat(word(FIRST, k % 10), F.lit(" "), word(SECOND, F.floor(k / 10) % 16), F.lower(third))
    return table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), F.when(k % 3 == 0, "checkpoint").when(k % 3 == 1, "locality").otherwise("road").alias("kind"))


def mentions(spark, sf_dir) -> DataFrame:
    """Names as reports give them: plain, with generic words, inside a phrase, misspelt, or none. (id, text)"""
    g = gazetteer(spark, sf_dir).withColumnRenamed("id", "place")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("place"), (F.col("event_id") % 5).alias("form"))
    j = e.join(g.select("place", "name").hint("merge"), "place")  # its file is small beside what a broadcast of it takes
    t = F.when(F.col("form") == 0, F.col("name")).when(F.col("form") == 1, F.concat(F.lit("north "), "name", F.lit(" gate"))).when(F.col("form") == 2, F.concat(F.lit("soldiers reached "), "name", F.lit(" this morning"))).when(F.col("form") == 3, F.concat(F.substring("name", 1, 3), F.substring("name", 5, 99))).otherwise(F.lit("nothing to report today"))
    return j.select("id", "place", "form", t.alias("text"))


#: How much a kind of place weighs where its name stands inside a phrase.
KINDS = {"checkpoint": 1.1, "locality": 1.0, "road": 0.7}


def resolve(m: DataFrame, g: DataFrame, fuzzy: float = 0.55, floor: float = 0.40) -> DataFrame:
    """Names (id, text) to places: the first rung that finds one.

    exact: the folded text is a name; contained: a name is a run of the text's words and not a part of
    a longer one that is found there too, the best by length, position and kind; fuzzy: trigram similarity; each rung sees what the last one left.
    Every distinct text is resolved once. Rows (id, place, rung, confidence).
    """
    # names and texts are folded once, and every rung is written: the next ones read it and plan nothing of it again
    asked = written(spread(m.select("id", "text")).select("id", fold_for_match(F.col("text")).alias("key")), "asked")
    names = written(spread(g.select("id", "name", "kind")).select(F.col("id").alias("place"), fold_for_match(F.col("name")).alias("name"), "kind"), "names")
    t = written(asked.select("key").distinct(), "keys")
    # what grows with the names or texts is never broadcast: packed files and shuffles look small
    exact = t.join(names.hint("merge"), F.col("key") == F.col("name")).groupBy("key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    exact = written(exact.select("key", "place", F.lit("exact").alias("rung"), F.round(F.lit(0.95) / (1 + 0.35 * (F.col("n") - 1)), 6).alias("confidence")), "exact")
    left = written(t.join(exact.select("key").hint("merge"), "key", "left_anti").where("length(key) >= 3"), "left")
    words, longest = F.split("key", " "), names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1  # one number
    runs = left.select("key", F.explode(F.flatten(F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda n: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("name"), F.length(F.array_join(F.slice(words, 1, i), " ")).alias("before"))))) ).alias("r")).select("key", "r.*").where("length(name) >= 4")
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in KINDS.items()], F.lit(0.9))
    # of equal names the weightiest, then the least place, so that a text's candidates are at most its runs
    found = runs.join(names.withColumn("weight", weight).hint("merge"), "name").groupBy("key", "name", "before").agg(F.max(F.struct("weight", (-F.col("place")).alias("back"))).alias("w"))
    found = found.select("key", "name", "w.weight", (-F.col("w.back")).alias("place"), F.when(F.col("before") > 0, F.col("before") + 1).otherwise(0).alias("at"))
    alone = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["at"] <= x["at"]) & (y["at"] + F.length(y["name"]) >= x["at"] + F.length(x["name"])) & (F.length(y["name"]) > F.length(x["name"]))))
    found = found.groupBy("key").agg(F.collect_list(F.struct("place", "name", "weight", "at")).alias("all")).select("key", F.explode(alone).alias("x")).select("key", "x.*")
    score = (F.length("name") / F.length("key") + 0.35 * (1 - F.col("at") / F.length("key"))) * F.col("weight")
    best = found.groupBy("key").agg(F.max_by(F.struct("place", "name"), F.struct(F.round(score, 9), -F.col("place"))).alias("b"))
    contained = written(best.select("key", F.col("b.place").alias("place"), F.lit("contains").alias("rung"), F.round(F.least(F.lit(0.85), 0.55 + 0.30 * F.length("b.name") / F.length("key")), 6).alias("confidence")), "contained")
    left = written(spread(left.join(contained.select("key").hint("merge"), "key", "left_anti")).select(F.col("key").alias("a"), X.trigrams(F.col("key")).alias("ga")), "left")
    near = X.closest(left, written(spread(names.select(F.col("place").alias("b"), "name")).select("b", X.trigrams(F.col("name")).alias("gb")), "names"), fuzzy, 0.02)
    top = near.select(F.col("a").alias("key"), F.col("b").alias("place"), F.round("similarity", 9).alias("s")).withColumn("top", F.max("s").over(Window.partitionBy("key")))
    fuzzy_ = top.where("top - s < 0.02").groupBy("key", "top").agg(F.min_by("place", F.struct(-F.col("s"), "place")).alias("place"), F.count_distinct("place").alias("n"))
    fuzzy_ = fuzzy_.select("key", "place", F.lit("fuzzy").alias("rung"), F.round(F.least(F.lit(0.75), 0.8 * F.col("top")) / (1 + 0.35 * (F.col("n") - 1)), 6).alias("confidence")).where(F.col("confidence") >= floor)
    found = exact.unionByName(contained).unionByName(fuzzy_)
    return asked.join(found.hint("merge"), "key", "left").select("id", "place", F.coalesce("rung", F.lit("none")).alias("rung"), "confidence")


_GAZ = f"gz AS (SELECT c_custkey AS place, {_FIRST.format('c_custkey % 10')} || ' ' || {_SECOND.format('(c_custkey // 10) % 16')} || CASE WHEN c_custkey >= 160 THEN ' ' || CASE WHEN c_custkey // 160 >= 26 THEN b26(c_custkey // 160 // 26) ELSE '' END || b26(c_custkey // 160 % 26) ELSE '' END AS name FROM customer)"
_GAZ = _GAZ.replace("b26(c_custkey // 160 // 26)", "substr('0123456789abcdefghijklmnop', CAST(c_custkey // 160 // 26 + 1 AS BIGINT), 1)").replace("b26(c_custkey // 160 % 26)", "substr('0123456789abcdefghijklmnop', CAST(c_custkey // 160 % 26 + 1 AS BIGINT), 1)")
_TRI = "string_split(t, ' ')"
RESOLVED = f"""WITH {_GAZ}, me AS (SELECT event_id AS id, user_id AS place, event_id % 5 AS form, name FROM events JOIN gz ON user_id = place),
mis AS (SELECT DISTINCT substr(name, 1, 3) || substr(name, 5) AS t FROM me WHERE form = 3),
ng AS (SELECT t, n, count(*) OVER (PARTITION BY t) AS c FROM (SELECT DISTINCT t, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS n FROM (SELECT t, unnest({_TRI}) AS w FROM mis), unnest(range(1, length(w) + 2)) AS r(i))),
gg AS (SELECT place, t, n, count(*) OVER (PARTITION BY place) AS c FROM (SELECT DISTINCT place, t, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS n FROM (SELECT place, name AS t, unnest(string_split(name, ' ')) AS w FROM gz), unnest(range(1, length(w) + 2)) AS r(i))),
sm AS (SELECT a.t, b.place, round(count(*) / (any_value(a.c) + any_value(b.c) - count(*)), 9) AS s FROM ng a JOIN gg b ON a.n = b.n GROUP BY a.t, b.place HAVING count(*) / (any_value(a.c) + any_value(b.c) - count(*)) >= 0.55),
tp AS (SELECT *, max(s) OVER (PARTITION BY t) AS top FROM sm), fz AS (SELECT t, arg_min(place, (-s, place)) AS place, round(least(0.75, 0.8 * any_value(top)) / (1 + 0.35 * (count(DISTINCT place) - 1)), 6) AS confidence FROM tp WHERE top - s < 0.02 GROUP BY 1)
SELECT me.id, CASE WHEN form <= 2 THEN me.place WHEN form = 3 AND confidence >= 0.40 THEN fz.place END AS place, CASE WHEN form <= 1 THEN 'exact' WHEN form = 2 THEN 'contains' WHEN form = 3 AND confidence >= 0.40 THEN 'fuzzy' ELSE 'none' END AS rung,
  CASE WHEN form <= 1 THEN 0.95 WHEN form = 2 THEN round(least(0.85, 0.55 + 0.30 * length(name) / length('soldiers reached ' || name || ' this morning')), 6) WHEN form = 3 AND confidence >= 0.40 THEN confidence END AS confidence
FROM me LEFT JOIN fz ON form = 3 AND fz.t = substr(name, 1, 3) || substr(name, 5)"""


@query("rs_place", RESOLVED)
def rs_place(spark, sf_dir):
    return resolve(mentions(spark, sf_dir).select("id", "text"), gazetteer(spark, sf_dir))


@query("mt_place_measure", f"SELECT rung, count(*) AS n, count(DISTINCT place) AS places FROM ({RESOLVED}) GROUP BY 1")
def mt_place_measure(spark, sf_dir):
    """What the resolver makes of the whole corpus: rows and places by rung."""
    return rs_place(spark, sf_dir).groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"))


@query("rt_geo_resolve", f"SELECT r.id, r.place, r.rung, coalesce(n, 0) AS twins FROM ({RESOLVED}) r LEFT JOIN (SELECT c_custkey AS place, count(*) OVER (PARTITION BY c_custkey % 10, c_custkey // 10 % 16) - 1 AS n FROM customer) t ON t.place = r.place")
def rt_geo_resolve(spark, sf_dir):
    """A resolved name and how many others share its first two words."""
    g = gazetteer(spark, sf_dir).select(F.col("id").alias("place"), F.array_join(F.slice(F.split("name", " "), 1, 2), " ").alias("stem"))
    twins = g.join(g.groupBy("stem").agg((F.count(F.lit(1)) - 1).alias("twins")).hint("merge"), "stem").select("place", "twins")
    return rs_place(spark, sf_dir).join(twins.hint("merge"), "place", "left").select("id", "place", "rung", F.coalesce("twins", F.lit(0)).alias("twins"))


@query("mt_alias_backfill", f"WITH {_GAZ}, me AS (SELECT user_id AS place, event_id % 5 AS form, name FROM events JOIN gz ON user_id = place), k AS (SELECT name AS key, place FROM me WHERE form IN (0, 1) UNION ALL SELECT substr(name, 1, 3) || substr(name, 5), place FROM me WHERE form = 3) SELECT key, count(*) AS n, count(DISTINCT place) AS places FROM k WHERE key NOT IN (SELECT name FROM gz) GROUP BY 1 HAVING count(*) >= 3")
def mt_alias_backfill(spark, sf_dir):
    """Spellings that reports use three times or more and no place has as its name: aliases owed."""
    k = mentions(spark, sf_dir).where("form IN (0, 1, 3)").select(fold_for_match(F.col("text")).alias("key"), "place")
    owed = k.join(gazetteer(spark, sf_dir).select(F.col("name").alias("key")), "key", "left_anti")
    return owed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places")).where("n >= 3")


STATUS_WORDS = "open closed busy army queue".split()


@query("rs_name_quality", f"WITH p AS (SELECT c_custkey AS id, c_custkey // 4 AS y, 0 AS x, CASE WHEN c_custkey % 6 = 0 THEN 'gate closed ' || c_custkey WHEN c_custkey % 6 = 1 THEN 'gate ' || c_custkey ELSE 'old gate ' || c_custkey || ' road' END AS name FROM customer), o AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT p.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY y, x ORDER BY CASE WHEN c % 1 = 0 THEN (p.id % 6 = 0)::INT END, -coalesce(n, 0), CASE WHEN p.id % 6 <= 1 THEN len(string_split(name, ' ')) ELSE 4 END, length(name), p.id) AS rn, count(*) OVER (PARTITION BY y, x) AS members FROM (SELECT *, 0 AS c FROM p) p LEFT JOIN o USING (id)) SELECT id, name, members FROM r WHERE rn = 1 AND members > 1")
def rs_name_quality(spark, sf_dir):
    """The name that stands for co-located places: no status word in it, then most reports, then fewest words and letters, then least id."""
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("gate closed "), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit("gate "), k.cast("string"))).otherwise(F.concat(F.lit("old gate "), k.cast("string"), F.lit(" road")))
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.floor(k / 4).alias("y"), F.lit(0).alias("x"), name.alias("name"))
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return canonical(p.join(n, "id", "left").na.fill(0, ["n"]), ["y", "x"])


def penalty(name: Column) -> Column:
    """Less is better: has a status word, words, letters."""
    words = F.split(X.normalize(name), " ")
    return F.struct(F.arrays_overlap(words, F.array(*map(F.lit, STATUS_WORDS))).cast("int").alias("status"), F.size(words).alias("words"), F.length(name).alias("letters"))


def canonical(p: DataFrame, at: list[str]) -> DataFrame:
    """One of each group of co-located places (id, name, n, at): the first by status, reports, name, id."""
    x = penalty(F.col("name"))
    order = F.struct(x["status"].alias("a"), (-F.col("n")).alias("b"), x["words"].alias("c"), x["letters"].alias("d"), "id")
    g = p.groupBy(*at).agg(F.min_by(F.struct("id", "name"), order).alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return g.select("b.id", "b.name", "members")


@query("rs_checkpoint_name", f"WITH {_GAZ}, me AS (SELECT event_id AS id, user_id AS place, event_id % 5 AS form FROM events JOIN gz ON user_id = place), o AS (SELECT user_id AS place, count(*) AS n FROM events GROUP BY 1) SELECT id, place, round(least(1.0, CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 END + least(n, 3) / 3 * 0.04), 6) AS score FROM me JOIN o USING (place) WHERE form <= 1 AND place % 3 = 0")
def rs_checkpoint_name(spark, sf_dir):
    """Names of checkpoints only: whole name 1.0, folded name 0.9; evidence adds up to 0.04; scores end at 1."""
    g = gazetteer(spark, sf_dir).where("kind = 'checkpoint'").select(F.col("id").alias("found"), "name")
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    m = mentions(spark, sf_dir).where("form <= 1").select("id", X.normalize(F.col("text")).alias("whole"), fold_for_match(F.col("text")).alias("folded"))
    met = m.join(g, F.col("folded") == F.col("name")).join(n, "found")
    score = F.when(F.col("whole") == F.col("name"), 1.0).otherwise(0.9) + F.least(F.col("n"), F.lit(3)) / 3 * 0.04
    best = met.groupBy("id").agg(F.max_by(F.struct("found", score.alias("score")), F.struct(score, -F.col("found"))).alias("b"))
    return best.select("id", F.col("b.found").alias("place"), F.round(F.least(F.lit(1.0), F.col("b.score")), 6).alias("score"))


@query("rt_checkpoint_status", f"WITH {_GAZ}, {OBS}, {STATES}, me AS (SELECT event_id AS id, user_id AS place, event_id % 5 AS form FROM events JOIN gz ON user_id = place) SELECT me.id, place, coalesce(st.value, 'unknown') AS value FROM me LEFT JOIN st ON st.id = place WHERE form <= 1 AND place % 3 = 0")
def rt_checkpoint_status(spark, sf_dir):
    """From a name to the checkpoint's state."""
    named = rs_checkpoint_name(spark, sf_dir).select("id", "place")
    return named.join(states_of(spark, sf_dir).withColumnRenamed("id", "place"), "place", "left").select("id", "place", F.coalesce("value", F.lit("unknown")).alias("value"))
