"""From observations to a current belief, and from a belief to what is served at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import decay as D
from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, MINUTE, OBS, SRC, observations, sources

KEY = ["place_id", "kind", "direction"]


@dataclass(frozen=True)
class Kind:
    """Settings of a state kind."""

    half_life: float = 345_600.0
    floor: float = 0.25
    max_assert: float | None = 1_209_600.0
    gated: tuple[str, ...] = ("open",)
    crowd_units: int = 2
    window: int = 30 * MINUTE


FLOW = Kind()


def witness_trust(trust, kind):
    return D.SINGLE_SOURCE_TRUST * F.coalesce(trust, F.when(kind == "crowd", D.UNEARNED_CROWD_TRUST).otherwise(1.0))


def latest_per_key(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The newest row of a key; of equal times the largest obs_id. A sum-like aggregate, so large keys are not gathered."""
    rest = [c for c in obs.columns if c not in key]
    top = obs.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("t", "obs_id")).alias("x"))
    return top.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def believed_reading(obs: DataFrame, src: DataFrame, k: Kind = FLOW, as_of: int = AS_OF) -> DataFrame:
    """The reading that stands for a key: the newest, unless it is a weak crowd report that contradicts a still assertable one of a unit above the floor; then the newest of those."""
    rows = obs.where("modality = 'assertion'").join(F.broadcast(src), "source_id").withColumn("p", witness_trust(F.col("trust"), F.col("source_kind")))
    order = F.struct("t", "obs_id")
    reading = F.struct("value", "t", "obs_id", "source_id", "source_kind", "p")
    strong = F.col("p") >= k.floor
    if k.max_assert is not None:
        strong &= F.col("t") > as_of - int(k.max_assert * 1e6)
    tops = rows.groupBy(*KEY).agg(F.max_by(reading, order).alias("n"), F.max_by(F.when(strong, reading), F.when(strong, order)).alias("s"))
    # a weak newest row is not itself strong, so the newest strong row is an earlier one, unless times are equal
    held = (F.col("n.source_kind") == "crowd") & (F.col("n.p") < k.floor) & F.col("s").isNotNull() & (F.col("s.t") < F.col("n.t")) & (F.col("s.value") != F.col("n.value"))
    best = F.when(held, F.col("s")).otherwise(F.col("n"))
    return tops.select(*KEY, best["value"].alias("value"), best["t"].alias("t"), best["source_id"].alias("source_id"), F.coalesce(held, F.lit(False)).alias("held"))


def belief(obs: DataFrame, src: DataFrame, k: Kind = FLOW, as_of: int = AS_OF) -> DataFrame:
    """Rows (key, value, t, source_id, base_confidence, agree, disagree): noisy-OR over agreeing independent units, less for dissent; values that only an unearned crowd asserts are withheld."""
    top = believed_reading(obs, src, k, as_of)
    near = obs.where("modality = 'assertion'").select(*KEY, F.col("value").alias("v"), F.col("t").alias("u"), F.col("source_id").alias("s"))
    near = near.join(top, KEY).where(F.col("u") >= F.col("t") - k.window)
    near = near.join(F.broadcast(src.withColumnRenamed("source_id", "s").withColumnRenamed("source_kind", "sk")), "s")
    same = F.col("v") == F.col("value")
    units = near.groupBy(*KEY, "value", "t", "source_id", "unit").agg(
        F.max(same).alias("agrees"), F.max(~same).alias("dissents"), F.max(same & (F.col("sk") != "crowd")).alias("known"),
        F.coalesce(F.max(F.when(same & (F.col("u") <= F.col("t")), witness_trust(F.col("trust"), F.col("sk")))), F.lit(0.0)).alias("p"),
    )
    out = units.groupBy(*KEY, "value", "t", "source_id").agg(
        F.count_if("agrees").alias("agree"), F.count_if("dissents").alias("disagree"), F.count_if("known").alias("known"),
        (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(0.001)))))).alias("conf"),
    )
    gate = F.col("value").isin(*k.gated) & (F.col("known") == 0) & (F.col("agree") < k.crowd_units)
    conf = F.least(F.lit(D.MAX_CONFIDENCE), F.col("conf") * (1 - D.DISSENT_WEIGHT * F.col("disagree") / F.greatest(F.col("agree") + F.col("disagree"), F.lit(1))))
    return out.withColumn("withheld", gate).withColumn("base_confidence", conf).withColumn("agree", F.greatest("agree", F.lit(1)))


def serve(current: DataFrame, k: Kind = FLOW, as_of: int = AS_OF) -> DataFrame:
    """What is served of a belief at a time: confidence decays, and unknown is a value."""
    age, hl = F.lit(as_of) - F.col("t"), F.lit(k.half_life)
    persistence = D.state_confidence(F.lit(1.0), age, hl)
    df = current.where("NOT withheld").withColumn("confidence", D.served_confidence(F.col("base_confidence"), persistence, F.lit(None).cast("double"))).withColumn("band", D.staleness_band(age, hl))
    served = D.serve_value(F.col("value"), F.col("confidence"), F.lit(k.floor), F.col("band"), age, F.lit(k.max_assert))
    return df.select(*KEY, F.col("value").alias("last_known"), served.alias("value"), "t", F.floor(age / MINUTE).cast("long").alias("age_minutes"), "confidence", "band", "agree", "disagree")


def by_direction(served: DataFrame) -> DataFrame:
    """A row for inbound and outbound each (the newest that speaks of it, a specific one first), and the worse of the two as both; a lone open direction is not open both ways. One aggregate a place."""
    row = F.struct("value", "last_known", "t", "confidence", "direction")

    def newest(way: str) -> Column:
        speaks = F.col("direction").isin(way, "both")
        return F.max_by(F.when(speaks, row), F.when(speaks, F.struct("t", (F.col("direction") == way))))

    g = served.groupBy("place_id").agg(newest("inbound").alias("i"), newest("outbound").alias("o"))
    i, o = F.col("i"), F.col("o")
    bad = lambda x: F.struct(D.severity(x["value"]).alias("s"), x["t"].alias("t"))
    worse = F.when(i.isNull() | (o.isNotNull() & (bad(o) > bad(i))), o).otherwise(i)
    lone = i.isNull() | o.isNull()
    named = lambda way, x, value: F.when(x.isNotNull(), F.struct(F.lit(way).alias("way"), value.alias("value"), *[x[c].alias(c) for c in ("last_known", "t", "confidence", "direction")]))
    three = F.array(named("inbound", i, i["value"]), named("outbound", o, o["value"]), named("both", worse, F.when(lone & (worse["value"] == "open"), "unknown").otherwise(worse["value"])))
    out = g.select("place_id", F.explode(F.array_compact(three)).alias("x"), (~lone & (i["value"] != o["value"])).alias("differs")).select("place_id", "x.*", "differs")
    return out.withColumn("passable", D.passable(F.col("value"))).withColumnRenamed("direction", "reported_for")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief(observations(spark, sf_dir), sources(spark))


# ---- SQL of the same

TRUST = "0.85 * coalesce({0}trust, CASE WHEN {0}source_kind = 'crowd' THEN 0.2 ELSE 1.0 END)"
READING = f"""WITH {OBS}, {SRC},
r AS (SELECT o.*, source_kind, unit, trust, {TRUST.format('')} AS p FROM obs o JOIN src USING (source_id) WHERE modality = 'assertion'),
newest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY place_id, kind, direction ORDER BY t DESC, obs_id DESC) = 1),
strong AS (SELECT * FROM r WHERE p >= 0.25 AND t > {AS_OF} - 1209600000000 QUALIFY row_number() OVER (PARTITION BY place_id, kind, direction ORDER BY t DESC, obs_id DESC) = 1),
latest AS (
  SELECT n.place_id, n.kind, n.direction, h.place_id IS NOT NULL AS held,
    CASE WHEN h.place_id IS NULL THEN n.value ELSE h.value END AS value, CASE WHEN h.place_id IS NULL THEN n.t ELSE h.t END AS t,
    CASE WHEN h.place_id IS NULL THEN n.source_id ELSE h.source_id END AS source_id
  FROM newest n LEFT JOIN strong h ON h.place_id = n.place_id AND h.kind = n.kind AND h.direction = n.direction
    AND n.source_kind = 'crowd' AND n.p < 0.25 AND h.t < n.t AND h.value <> n.value)"""
CORR = READING + """,
near AS (SELECT l.*, r.value AS v, r.t AS u, r.unit, r.source_kind, r.p FROM latest l JOIN r ON r.place_id = l.place_id AND r.kind = l.kind AND r.direction = l.direction AND r.t >= l.t - 1800000000),
corr AS (SELECT place_id, kind, direction, value, t, source_id,
    count(DISTINCT unit) FILTER (WHERE v = value) AS agree, count(DISTINCT unit) FILTER (WHERE v <> value) AS disagree,
    count(DISTINCT unit) FILTER (WHERE v = value AND source_kind <> 'crowd') AS known FROM near GROUP BY ALL),
units AS (SELECT place_id, kind, direction, unit, max(p) AS p FROM near WHERE v = value AND u <= t GROUP BY ALL),
comb AS (SELECT place_id, kind, direction, 1 - exp(sum(ln(greatest(1 - p, 0.001)))) AS conf FROM units GROUP BY ALL),
cur AS (SELECT c.*, conf, c.value = 'open' AND known = 0 AND agree < 2 AS withheld,
    least(0.97, conf * (1 - 0.25 * disagree / greatest(agree + disagree, 1))) AS base_confidence FROM corr c JOIN comb USING (place_id, kind, direction))"""
SERVED = CORR + f""",
s0 AS (SELECT *, {AS_OF} - t AS age, ({AS_OF} - t) / (345600.0 * 1e6) AS h FROM cur WHERE NOT withheld),
s1 AS (SELECT *, base_confidence * CASE WHEN h <= 0 THEN 1.0 WHEN h > 60 THEN 0.0 ELSE greatest(0, least(1, pow(0.5, h))) END AS confidence,
    CASE WHEN h < 1 THEN 'live' WHEN h < 2 THEN 'recent' WHEN h < 8 THEN 'stale' ELSE 'expired' END AS band FROM s0),
served AS (SELECT place_id, kind, direction, value AS last_known, CASE WHEN confidence < 0.25 OR band = 'expired' OR age > 1209600000000 THEN 'unknown' ELSE value END AS value,
    t, age // 60000000 AS age_minutes, confidence, band, greatest(agree, 1) AS agree, disagree FROM s1)"""
FLOWS = SERVED + """,
ways AS (SELECT s.*, d.way FROM served s JOIN (VALUES ('inbound'), ('outbound')) AS d(way) ON s.direction = d.way OR s.direction = 'both'),
dirflow AS (SELECT place_id, way, value, last_known, t, confidence, direction FROM ways QUALIFY row_number() OVER (PARTITION BY place_id, way ORDER BY t DESC, direction = way DESC) = 1),
nd AS (SELECT *, count(*) OVER (PARTITION BY place_id) AS n FROM dirflow),
bothflow AS (SELECT place_id, 'both' AS way, CASE WHEN n < 2 AND value = 'open' THEN 'unknown' ELSE value END AS value, last_known, t, confidence, direction FROM nd
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY CASE value WHEN 'closed' THEN 4 WHEN 'congested' THEN 3 WHEN 'slow' THEN 2 WHEN 'open' THEN 0 ELSE 1 END DESC, t DESC, way) = 1),
differs AS (SELECT place_id, count(DISTINCT value) > 1 AS differs FROM dirflow GROUP BY 1),
flows AS (SELECT f.*, differs, CASE WHEN value IN ('open', 'slow', 'congested') THEN true WHEN value = 'closed' THEN false END AS passable FROM (SELECT * FROM dirflow UNION ALL SELECT * FROM bothflow) f JOIN differs USING (place_id))"""


@query("served_state", SERVED + " SELECT place_id, kind, direction, last_known, value, t, age_minutes, round(confidence, 6) AS confidence, band, agree, disagree FROM served")
def served_state(spark, sf_dir):
    return serve(current(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("wn_latest_per_key", f"WITH {OBS} SELECT place_id, kind, direction, value, t, source_id FROM obs WHERE modality = 'assertion' QUALIFY row_number() OVER (PARTITION BY place_id, kind, direction ORDER BY t DESC, obs_id DESC) = 1")
def wn_latest_per_key(spark, sf_dir):
    return latest_per_key(observations(spark, sf_dir).where("modality = 'assertion'")).select(*KEY, "value", "t", "source_id")


@query("jn_lateral_prev", READING + " SELECT place_id, kind, direction, value, t, source_id, held FROM latest")
def jn_lateral_prev(spark, sf_dir):
    return believed_reading(observations(spark, sf_dir), sources(spark))


@query("ag_distinct_filter", CORR + " SELECT place_id, kind, direction, agree, disagree, known FROM cur")
def ag_distinct_filter(spark, sf_dir):
    # agree counts at least one unit, the reading's own
    return current(spark, sf_dir).select(*KEY, "agree", "disagree", "known")


@query("ag_noisy_or", CORR + " SELECT place_id, kind, direction, round(conf, 6) AS conf FROM cur")
def ag_noisy_or(spark, sf_dir):
    return current(spark, sf_dir).select(*KEY, F.round("conf", 6).alias("conf"))


@query("ag_conf_dissent", CORR + " SELECT place_id, kind, direction, disagree, round(base_confidence, 6) AS base_confidence FROM cur")
def ag_conf_dissent(spark, sf_dir):
    return current(spark, sf_dir).select(*KEY, "disagree", F.round("base_confidence", 6).alias("base_confidence"))


@query("jn_corroboration_window", CORR + " SELECT place_id, kind, direction, unit, v AS value, count(*) AS reports, max(u) AS newest FROM near GROUP BY ALL")
def jn_corroboration_window(spark, sf_dir):
    obs, src = observations(spark, sf_dir), sources(spark)
    top = believed_reading(obs, src).select(*KEY, F.col("t").alias("t0"))
    near = obs.where("modality = 'assertion'").join(top, KEY).where(F.col("t") >= F.col("t0") - FLOW.window).join(F.broadcast(src), "source_id")
    return near.groupBy(*KEY, "unit", "value").agg(F.count(F.lit(1)).alias("reports"), F.max("t").alias("newest"))


@query("rt_crowd_pending", CORR + " SELECT place_id, kind, direction, value, agree, 2 - agree AS needs FROM cur WHERE withheld")
def rt_crowd_pending(spark, sf_dir):
    return current(spark, sf_dir).where("withheld").select(*KEY, "value", "agree", (FLOW.crowd_units - F.col("agree")).alias("needs"))


@query("wn_worse_direction", FLOWS + " SELECT place_id, way, value, last_known, t, direction AS reported_for, differs, passable FROM flows")
def wn_worse_direction(spark, sf_dir):
    return by_direction(serve(current(spark, sf_dir))).select("place_id", "way", "value", "last_known", "t", "reported_for", "differs", "passable")


@query("wn_latest_tiebreak", FLOWS + " SELECT place_id, way, value, t, direction AS reported_for FROM dirflow")
def wn_latest_tiebreak(spark, sf_dir):
    return by_direction(serve(current(spark, sf_dir))).where("way <> 'both'").select("place_id", "way", "value", "t", "reported_for")


@query("jn_direction_expand", FLOWS + " SELECT way, direction, count(*) AS n FROM ways GROUP BY ALL")
def jn_direction_expand(spark, sf_dir):
    served = serve(current(spark, sf_dir))
    ways = F.when(F.col("direction") == "both", F.array(F.lit("inbound"), F.lit("outbound"))).otherwise(F.array("direction"))
    return served.withColumn("way", F.explode(ways)).groupBy("way", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("fn_passable", FLOWS + " SELECT passable, count(*) AS n FROM flows GROUP BY ALL")
def fn_passable(spark, sf_dir):
    return by_direction(serve(current(spark, sf_dir))).groupBy("passable").agg(F.count(F.lit(1)).alias("n"))


@query("ag_flow_summary", SERVED + " SELECT value, band, count(*) AS n, round(avg(CASE WHEN value <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS known_share FROM served GROUP BY ALL")
def ag_flow_summary(spark, sf_dir):
    return serve(current(spark, sf_dir)).groupBy("value", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") != "unknown").cast("double")), 6).alias("known_share"))


def _aged(expr: str) -> str:
    return f"WITH {OBS}, a AS (SELECT obs_id, num, {AS_OF} - t AS age, ({AS_OF} - t) / (86400.0 * 1e6) AS h FROM obs) SELECT obs_id, {expr} FROM a"


def _ages(spark, sf_dir):
    return observations(spark, sf_dir).select("obs_id", "num", (F.lit(AS_OF) - F.col("t")).alias("age"))


CONF = "CASE WHEN h <= 0 THEN 1.0 WHEN h > 60 THEN 0.0 ELSE greatest(0, least(1, 0.9 * pow(0.5, h))) END"
PERS = "greatest(0, least(1, CASE WHEN h <= 0 THEN 0.95 WHEN h > 60 THEN 0.6 ELSE 0.6 + 0.35 * pow(0.5, h) END))"
BAND = "CASE WHEN h < 1 THEN 'live' WHEN h < 2 THEN 'recent' WHEN h < 8 THEN 'stale' ELSE 'expired' END"


@query("fn_state_confidence", _aged(f"round({CONF}, 6) AS confidence"))
def fn_state_confidence(spark, sf_dir):
    return _ages(spark, sf_dir).select("obs_id", F.round(D.state_confidence(F.lit(0.9), F.col("age"), F.lit(86400.0)), 6).alias("confidence"))


@query("fn_value_persistence", _aged(f"round({PERS}, 6) AS persistence"))
def fn_value_persistence(spark, sf_dir):
    return _ages(spark, sf_dir).select("obs_id", F.round(D.value_persistence(F.lit(0.95), F.lit(0.6), F.col("age"), F.lit(86400.0)), 6).alias("persistence"))


@query("fn_served_confidence", _aged(f"round(0.9 * greatest(0, least(1, ({PERS} - 0.5) / (0.95 - 0.5))), 6) AS confidence"))
def fn_served_confidence(spark, sf_dir):
    p = D.value_persistence(F.lit(0.95), F.lit(0.6), F.col("age"), F.lit(86400.0))
    return _ages(spark, sf_dir).select("obs_id", F.round(D.served_confidence(F.lit(0.9), p, F.lit(0.95)), 6).alias("confidence"))


@query("fn_staleness_band", _aged(f"{BAND} AS band"))
def fn_staleness_band(spark, sf_dir):
    return _ages(spark, sf_dir).select("obs_id", D.staleness_band(F.col("age"), F.lit(86400.0)).alias("band"))


@query("fn_serve_value", _aged(f"CASE WHEN {CONF} < 0.25 OR {BAND} = 'expired' OR age > 1728000 * 1e6 THEN 'unknown' ELSE 'seen' END AS value"))
def fn_serve_value(spark, sf_dir):
    hl, age = F.lit(86400.0), F.col("age")
    return _ages(spark, sf_dir).select("obs_id", D.serve_value(F.lit("seen"), D.state_confidence(F.lit(0.9), age, hl), F.lit(0.25), D.staleness_band(age, hl), age, F.lit(1728000.0)).alias("value"))
