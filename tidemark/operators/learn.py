"""What can be learned of sources from their observations: agreement, copying, reliability, persistence, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.belief import KEY
from tidemark.plans.register import query
from tidemark.plans.steps import written
from tidemark.sources.analogues import HOUR, MINUTE, OBS, SRC, observations, sources

WINDOW = 6 * HOUR


def assertions(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).where("modality = 'assertion'")


def window_pairs(obs: DataFrame, window: int) -> DataFrame:
    """Pairs of observations of one key by different sources (a < b) at most `window` apart.

    A band join by buckets of the window's width: each row meets its own bucket and the next, so
    that a key's rows are compared with their neighbours in time only.
    """
    cols = [*KEY, "source_id", "t", "value"]
    left = obs.select(*cols, F.expr(f"t div {window}").alias("bucket"))
    right = left.select(*KEY, F.col("source_id").alias("b"), F.col("t").alias("u"), F.col("value").alias("w"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    met = left.join(right, [*KEY, "bucket"])
    return met.where((F.col("source_id") < F.col("b")) & (F.abs(F.col("t") - F.col("u")) <= window)).select(*KEY, F.col("source_id").alias("a"), "b", "t", "u", "value", "w")


def agreement(obs: DataFrame, window: int = WINDOW, least: int = 5) -> DataFrame:
    got = window_pairs(obs, window).groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("value") == F.col("w")).alias("agreed"))
    return got.where(F.col("pairs") >= least).withColumn("rate", F.col("agreed") / F.col("pairs"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node reachable over edges (a, b), by label propagation with pointer jumping until nothing changes; every round is a written table."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        new = written(label.join(near, "node", "left").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old")), "labels")
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = new.join(jump, "root", "left").select("node", F.least("root", "up").alias("root"))
        if new.where("root != old").isEmpty():
            return label


PAIRS = f"""{OBS}, o AS (SELECT * FROM obs WHERE modality = 'assertion'),
pairs AS (SELECT x.place_id, x.kind, x.direction, x.source_id AS a, y.source_id AS b, x.t, y.t AS u, x.value, y.value AS w FROM o x JOIN o y ON x.place_id = y.place_id AND x.kind = y.kind AND x.direction = y.direction AND x.source_id < y.source_id AND abs(x.t - y.t) <= {WINDOW})"""


@query("jn_self_window_pairs", f"WITH {PAIRS} SELECT a, b, t, u, value, w FROM pairs")
def jn_self_window_pairs(spark, sf_dir):
    return window_pairs(assertions(spark, sf_dir), WINDOW).select("a", "b", "t", "u", "value", "w")


@query("ag_agreement", f"WITH {PAIRS} SELECT a, b, count(*) AS pairs, count(*) FILTER (WHERE value = w) AS agreed, round(count(*) FILTER (WHERE value = w) / count(*), 6) AS rate FROM pairs GROUP BY a, b HAVING count(*) >= 5")
def ag_agreement(spark, sf_dir):
    return agreement(assertions(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("jn_crowd_pairs", f"WITH {PAIRS.replace(str(WINDOW), str(12 * HOUR))} SELECT a, b, count(*) AS pairs FROM pairs WHERE b = 6 GROUP BY a, b")
def jn_crowd_pairs(spark, sf_dir):
    """Pairs with the crowd's reports, in a wider window."""
    return window_pairs(assertions(spark, sf_dir), 12 * HOUR).where("b = 6").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))


# ---- reliability: each unit's last value a bucket against the others'

BUCKET = 12 * HOUR


def votes(obs: DataFrame, src: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (place_id, way, bucket, unit, value): one vote a unit, its newest; both ways' reports witness each."""
    ways = F.when(F.col("direction") == "both", F.array(F.lit("inbound"), F.lit("outbound"))).otherwise(F.array("direction"))
    rows = obs.join(F.broadcast(src), "source_id").withColumn("way", F.explode(ways)).withColumn("bucket", F.expr(f"t div {bucket}"))
    return rows.groupBy("place_id", "way", "bucket", "unit").agg(F.max_by("value", F.struct("t", "obs_id")).alias("value"))


def consensus_of_others(votes_: DataFrame) -> DataFrame:
    """votes with `others`, the majority value without the unit's own vote: null on a tie or without others."""
    cell = ["place_id", "way", "bucket"]
    counts = votes_.groupBy(*cell, "value").agg(F.count(F.lit(1)).alias("n")).groupBy(*cell).agg(F.collect_list(F.struct("value", "n")).alias("c"))
    met = votes_.join(counts, cell)
    less = F.transform("c", lambda x: F.struct((x["n"] - (x["value"] == F.col("value")).cast("int")).alias("n"), x["value"].alias("value")))
    ranked = F.sort_array(F.filter(less, lambda x: x["n"] > 0), asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return met.select(*cell, "unit", "value", F.when(second.isNull() | (top["n"] > second["n"]), top["value"]).alias("others"))


VOTES = f"""{OBS}, {SRC}, v0 AS (SELECT place_id, d.way, t // {BUCKET} AS bucket, unit, value, t, obs_id FROM obs JOIN src USING (source_id) JOIN (VALUES ('inbound'), ('outbound')) AS d(way) ON direction = d.way OR direction = 'both' WHERE modality = 'assertion'),
votes AS (SELECT place_id, way, bucket, unit, value FROM v0 QUALIFY row_number() OVER (PARTITION BY place_id, way, bucket, unit ORDER BY t DESC, obs_id DESC) = 1),
oth AS (SELECT v.place_id, v.way, v.bucket, v.unit, v.value, w.value AS wv, count(*) AS n FROM votes v JOIN votes w ON v.place_id = w.place_id AND v.way = w.way AND v.bucket = w.bucket AND v.unit <> w.unit GROUP BY ALL),
rk AS (SELECT *, max(n) OVER (PARTITION BY place_id, way, bucket, unit) AS m FROM oth),
cons AS (SELECT place_id, way, bucket, unit, any_value(value) AS value, CASE WHEN count(*) = 1 THEN any_value(wv) END AS others FROM rk WHERE n = m GROUP BY ALL)"""
WIL = "({h} / {n} + 1.96 * 1.96 / (2 * {n}) {s} 1.96 * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"


@query("ag_reliability", f"WITH {VOTES}, s AS (SELECT unit, count(*) AS n, count(*) FILTER (WHERE value = others) AS hits FROM cons WHERE others IS NOT NULL GROUP BY 1) SELECT unit, n, hits, round((hits + 1) / (n + 2), 6) AS mean, round(greatest(0, {WIL.format(h='hits', n='n', s='-')}), 6) AS low FROM s")
def ag_reliability(spark, sf_dir):
    """Leave-one-out majority: Beta(1,1) mean and Wilson's lower bound of each unit's hits."""
    got = consensus_of_others(votes(assertions(spark, sf_dir), sources(spark))).where("others IS NOT NULL")
    got = got.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == F.col("others")).alias("hits"))
    return got.withColumn("mean", F.round((F.col("hits") + 1) / (F.col("n") + 2), 6)).withColumn("low", F.round(stats.wilson(F.col("hits"), F.col("n"))[0], 6))


@query("ag_kappa", f"""WITH {VOTES}, j AS (SELECT unit, value, others, count(*) AS n FROM cons WHERE others IS NOT NULL GROUP BY ALL), t AS (SELECT unit, sum(n) AS n, sum(n) FILTER (WHERE value = others) AS hit FROM j GROUP BY 1),
a AS (SELECT unit, value, sum(n) AS n FROM j GROUP BY ALL), b AS (SELECT unit, others AS value, sum(n) AS n FROM j GROUP BY ALL), c AS (SELECT unit, sum(a.n * b.n) AS x FROM a JOIN b USING (unit, value) GROUP BY 1)
SELECT unit, round((coalesce(hit, 0) / n - coalesce(x, 0) / (n * n)) / (1 - coalesce(x, 0) / (n * n)), 6) AS kappa FROM t LEFT JOIN c USING (unit)""")
def ag_kappa(spark, sf_dir):
    joint = consensus_of_others(votes(assertions(spark, sf_dir), sources(spark))).where("others IS NOT NULL").groupBy("unit", "value", "others").agg(F.count(F.lit(1)).alias("n"))
    total = joint.groupBy("unit").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") == F.col("others"), F.col("n")).otherwise(0)).alias("hit"))
    a, b = joint.groupBy("unit", "value").agg(F.sum("n").alias("x")), joint.groupBy("unit", F.col("others").alias("value")).agg(F.sum("n").alias("y"))
    chance = a.join(b, ["unit", "value"]).groupBy("unit").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    got = total.join(chance, "unit", "left")
    return got.select("unit", F.round(stats.kappa(F.col("hit") / F.col("n"), F.coalesce("c", F.lit(0)) / (F.col("n") * F.col("n"))), 6).alias("kappa"))


@query("ag_wilson", "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, n, hits, round(greatest(0, " + WIL.format(h="hits", n="n", s="-") + "), 6) AS low, round(least(1, " + WIL.format(h="hits", n="n", s="+") + "), 6) AS high FROM s")
def ag_wilson(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    got = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return got.select("source", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# ---- persistence: how often a value still holds after a gap

GAPS = [12 * HOUR, 24 * HOUR, 48 * HOUR, 96 * HOUR, 192 * HOUR]
LEAD = f"""{OBS}, n AS (SELECT value, lead(value) OVER w AS nv, lead(t) OVER w - t AS gap FROM obs WHERE modality = 'assertion' WINDOW w AS (PARTITION BY place_id, kind, direction ORDER BY t, obs_id)),
b AS (SELECT *, CASE {' '.join(f'WHEN gap <= {g} THEN {k}' for k, g in enumerate(GAPS))} ELSE {len(GAPS)} END AS bucket FROM n WHERE nv IS NOT NULL),
curve AS (SELECT value, bucket, count(*) AS pairs, avg(CASE WHEN nv = value THEN 1.0 ELSE 0.0 END) AS p FROM b GROUP BY ALL HAVING count(*) >= 10)"""


def successors(obs: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("t", "obs_id")
    return obs.select(*KEY, "value", F.lead("value").over(w).alias("nv"), (F.lead("t").over(w) - F.col("t")).alias("gap")).where("nv IS NOT NULL")


def persistence_curve(obs: DataFrame, gaps: list[int] = GAPS, least: int = 10) -> DataFrame:
    bucket = F.lit(len(gaps))
    for k in reversed(range(len(gaps))):
        bucket = F.when(F.col("gap") <= gaps[k], k).otherwise(bucket)
    return successors(obs).groupBy("value", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("nv") == F.col("value")).cast("double")).alias("p")).where(F.col("pairs") >= least)


@query("ag_persistence_curve", f"WITH {LEAD} SELECT value, bucket, pairs, round(p, 6) AS p FROM curve")
def ag_persistence_curve(spark, sf_dir):
    return persistence_curve(assertions(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query("wn_lead_persistence", f"WITH {LEAD} SELECT value, nv, count(*) AS n, round(avg(gap) / 6e7, 3) AS minutes FROM b GROUP BY ALL")
def wn_lead_persistence(spark, sf_dir):
    return successors(assertions(spark, sf_dir)).groupBy("value", "nv").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap") / 6e7, 3).alias("minutes"))


@query("ag_persistence_fit", f"""WITH {LEAD}, p0 AS (SELECT value, max_by(p, -bucket) AS p0 FROM curve GROUP BY 1),
g AS (SELECT * FROM (SELECT unnest([21600, 43200, 86400, 172800, 345600]) AS hl) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3]::DOUBLE[]) AS asym)),
s AS (SELECT c.value, hl, asym, sum(pairs * pow(p - (asym + (p0 - asym) * pow(0.5, (bucket + 1) * 43200.0 / hl)), 2)) AS sse FROM curve c JOIN p0 USING (value), g GROUP BY ALL)
SELECT value, hl, round(asym, 1) AS asym, round(sse, 5) AS sse FROM s QUALIFY row_number() OVER (PARTITION BY value ORDER BY sse, hl, asym) = 1""")
def ag_persistence_fit(spark, sf_dir):
    """Half-life and asymptote of least weighted squares, over a fixed grid; the grid is a few literals, exploded."""
    curve = persistence_curve(assertions(spark, sf_dir))
    p0 = curve.groupBy("value").agg(F.max_by("p", -F.col("bucket")).alias("p0"))
    grid = F.array(*[F.struct(F.lit(h).alias("hl"), F.lit(a).alias("asym")) for h in (21600, 43200, 86400, 172800, 345600) for a in (0.0, 0.1, 0.2, 0.3)])
    rows = curve.join(p0, "value").withColumn("g", F.explode(grid)).select("*", "g.*")
    model = F.col("asym") + (F.col("p0") - F.col("asym")) * F.pow(F.lit(0.5), (F.col("bucket") + 1) * 43200.0 / F.col("hl"))
    sse = rows.groupBy("value", "hl", "asym").agg(F.sum(F.col("pairs") * F.pow(F.col("p") - model, 2)).alias("sse"))
    best = sse.groupBy("value").agg(F.min(F.struct("sse", "hl", "asym")).alias("b"))
    return best.select("value", F.col("b.hl").alias("hl"), F.col("b.asym").alias("asym"), F.round("b.sse", 5).alias("sse"))


# ---- backtest: would an independent earlier report have been right?


def last_other_unit(obs: DataFrame, src: DataFrame) -> DataFrame:
    """obs with the newest earlier report of another unit on the same key (pt, pv, pu), null without one.

    Within a key's order, each row keeps the newest earlier row and the newest earlier one of
    another unit than that: carried by `last` over marks where the unit changes.
    """
    rows = obs.join(F.broadcast(src), "source_id")
    w = Window.partitionBy(*KEY).orderBy("t", "obs_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rep = F.struct("unit", F.col("t").alias("t"), F.col("value").alias("value"))
    prev = F.lag(rep).over(w)
    # at each row: the row before, if its unit differs from this row's; it is what rows of this unit's run look back to
    df = rows.withColumn("_prev", prev).withColumn("_turn", F.when(F.col("_prev")["unit"] != F.col("unit"), F.col("_prev")))
    df = df.withColumn("_before_run", F.last("_turn", ignorenulls=True).over(past))
    other = F.when(F.col("_prev")["unit"] != F.col("unit"), F.col("_prev")).otherwise(F.col("_before_run"))
    return df.withColumn("_o", other).select(*obs.columns, "unit", F.col("_o.t").alias("pt"), F.col("_o.value").alias("pv"), F.col("_o.unit").alias("pu"))


OTHER = f"""{OBS}, {SRC}, r AS (SELECT o.*, unit FROM obs o JOIN src USING (source_id) WHERE modality = 'assertion'),
prev AS (SELECT a.obs_id, a.value, a.direction, a.t, b.t AS pt, b.value AS pv, b.unit AS pu FROM r a JOIN r b ON a.place_id = b.place_id AND a.kind = b.kind AND a.direction = b.direction AND b.unit <> a.unit AND (b.t < a.t OR (b.t = a.t AND b.obs_id < a.obs_id))
  QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY b.t DESC, b.obs_id DESC) = 1)"""


@query("wn_last_other_unit", f"WITH {OTHER} SELECT obs_id, pt, pv, pu FROM prev")
def wn_last_other_unit(spark, sf_dir):
    return last_other_unit(assertions(spark, sf_dir), sources(spark)).where("pt IS NOT NULL").select("obs_id", "pt", "pv", "pu")


@query("ag_confusion_earnout", f"WITH {OTHER} SELECT pv AS said, value AS seen, count(*) AS n FROM prev WHERE t - pt <= {24 * HOUR} GROUP BY ALL")
def ag_confusion_earnout(spark, sf_dir):
    p = last_other_unit(assertions(spark, sf_dir), sources(spark)).where(F.col("t") - F.col("pt") <= 24 * HOUR)
    return p.groupBy(F.col("pv").alias("said"), F.col("value").alias("seen")).agg(F.count(F.lit(1)).alias("n"))


NEAREST = f"""{OBS}, a AS (SELECT * FROM obs WHERE source_id = 6), b AS (SELECT * FROM obs WHERE source_id <> 6),
near AS (SELECT a.obs_id, b.obs_id AS other, abs(a.t - b.t) AS gap, a.value, b.value AS w FROM a JOIN b ON a.place_id = b.place_id AND (a.direction = b.direction OR a.direction = 'both' OR b.direction = 'both') AND abs(a.t - b.t) <= {24 * HOUR}
 QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY abs(a.t - b.t), b.obs_id) = 1)"""


@query("jn_nearest_in_time", f"WITH {NEAREST} SELECT * FROM near")
def jn_nearest_in_time(spark, sf_dir):
    """The nearest report of a compatible direction within a day, for each of the crowd's."""
    obs, day = observations(spark, sf_dir), 24 * HOUR
    a = obs.where("source_id = 6").select("obs_id", "place_id", "direction", "t", "value", F.explode(F.array(*[F.expr(f"t div {day}") + k for k in (-1, 0, 1)])).alias("bucket"))
    b = obs.where("source_id <> 6").select(F.col("obs_id").alias("other"), "place_id", F.col("direction").alias("d"), F.col("t").alias("u"), F.col("value").alias("w"), F.expr(f"t div {day}").alias("bucket"))
    ok = ((F.col("direction") == F.col("d")) | (F.col("direction") == "both") | (F.col("d") == "both")) & (F.abs(F.col("t") - F.col("u")) <= day)
    best = a.join(b, ["place_id", "bucket"]).where(ok).groupBy("obs_id", "value").agg(F.min(F.struct(F.abs(F.col("t") - F.col("u")).alias("gap"), "other", "w")).alias("m"))
    return best.select("obs_id", F.col("m.other").alias("other"), F.col("m.gap").alias("gap"), "value", F.col("m.w").alias("w"))


@query("ag_image_agreement", f"WITH {NEAREST}, u AS (SELECT w, count(*) AS pairs, count(*) FILTER (WHERE value = w) AS agreed, bool_and(value = w) AS clean, count(*) FILTER (WHERE value = 'open' AND w <> 'open') AS false_open FROM near GROUP BY 1) SELECT * FROM u")
def ag_image_agreement(spark, sf_dir):
    hit = F.col("value") == F.col("w")
    return jn_nearest_in_time(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(hit).alias("agreed"), F.bool_and(hit).alias("clean"), F.count_if((F.col("value") == "open") & (F.col("w") != "open")).alias("false_open"))


@query("ag_cadence", f"""WITH {OBS}, g AS (SELECT place_id, direction, t - lag(t) OVER (PARTITION BY place_id, direction ORDER BY t) AS gap FROM obs)
SELECT place_id, direction, count(gap) AS gaps, round(least(43200, greatest(900, 1.5 * median(gap) / 1e6)), 3) AS half_life FROM g GROUP BY ALL HAVING count(gap) >= 5""")
def ag_cadence(spark, sf_dir):
    w = Window.partitionBy("place_id", "direction").orderBy("t")
    g = observations(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w))
    got = g.groupBy("place_id", "direction").agg(F.count("gap").alias("gaps"), F.median("gap").alias("m")).where("gaps >= 5")
    return got.select("place_id", "direction", "gaps", F.round(F.least(F.lit(43200), F.greatest(F.lit(900), 1.5 * F.col("m") / 1e6)), 3).alias("half_life"))


@query("wn_sessionize", f"""WITH {OBS}, f AS (SELECT place_id, obs_id, t, CASE WHEN t - lag(t) OVER w > {720 * MINUTE} THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY place_id ORDER BY t, obs_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY place_id ORDER BY t, obs_id) AS session FROM f) SELECT place_id, session, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY place_id, session""")
def wn_sessionize(spark, sf_dir):
    """Gap-chained clusters: a new one where the gap to the report before is longer than the window."""
    w = Window.partitionBy("place_id").orderBy("t", "obs_id")
    f = observations(spark, sf_dir).withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)) > 720 * MINUTE).cast("int"))
    s = f.withColumn("session", F.sum("new").over(w))
    return s.groupBy("place_id", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))


@query("st_rate_limit", f"WITH {OBS} SELECT obs_id, CASE WHEN count(*) OVER (PARTITION BY source_id, place_id, kind ORDER BY t RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) >= 2 THEN 'rate_limited' ELSE modality END AS modality FROM obs")
def st_rate_limit(spark, sf_dir):
    """Reports beyond two of a source on a place within the two days before are stored as rate limited."""
    w = Window.partitionBy("source_id", "place_id", "kind").orderBy("t").rangeBetween(-48 * HOUR, -1)
    return observations(spark, sf_dir).select("obs_id", F.when(F.count(F.lit(1)).over(w) >= 2, "rate_limited").otherwise(F.col("modality")).alias("modality"))


@query("wn_stratified_sample", f"WITH {OBS} SELECT obs_id, value, modality FROM obs QUALIFY row_number() OVER (PARTITION BY modality, value ORDER BY md5(CAST(obs_id AS VARCHAR)), obs_id) <= 20")
def wn_stratified_sample(spark, sf_dir):
    w = Window.partitionBy("modality", "value").orderBy(F.md5(F.col("obs_id").cast("string")), "obs_id")
    return observations(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("obs_id", "value", "modality")
