"""Measures of sources and of what is held: trust against a plateau, agreement against a control, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.learn import VOTES, WIL, assertions, consensus_of_others, votes
from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, DAY, HOUR, OBS, observations, sources, table

ESTABLISHED = 100


def trust_weights(scores: DataFrame, established: int = ESTABLISHED) -> DataFrame:
    """scores: (unit, n, hits). Adds trust, the lower bound of hits to four places, and weight: trust against the plateau, at most 1.

    The plateau is the upper median of the trust of units with `established` comparisons; without any, weight is
    null. Trust has four places, so that at most 10,001 values are ranked, however many units there are.
    """
    scored = scores.withColumn("trust", F.round(stats.wilson(F.col("hits"), F.col("n"))[0], 4))
    steps = scored.where(F.col("n") >= established).groupBy("trust").agg(F.count(F.lit(1)).alias("c"))
    steps = steps.withColumn("upto", F.sum("c").over(Window.orderBy("trust"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    plateau = steps.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("trust").alias("plateau"))
    return scored.crossJoin(F.broadcast(plateau)).withColumn("weight", F.when(F.col("plateau") > 0, F.round(F.least(F.lit(1.0), F.col("trust") / F.col("plateau")), 4)))


_SCORES = "s AS (SELECT unit, count(*) AS n, count(*) FILTER (WHERE value = others) AS hits FROM cons WHERE others IS NOT NULL GROUP BY 1)"
#: Comparisons that establish a unit on the supplied events; channels have far more.
FEW = 20


@query("ag_trust_weight", f"WITH {VOTES}, {_SCORES}, t AS (SELECT unit, n, round(greatest(0, {WIL.format(h='hits', n='n', s='-')}), 4) AS trust FROM s), p AS (SELECT list_sort(list(trust))[count(*) // 2 + 1] AS plateau FROM t WHERE n >= {FEW}) SELECT unit, n, trust, plateau, CASE WHEN plateau > 0 THEN round(least(1.0, trust / plateau), 4) END AS weight FROM t, p")
def ag_trust_weight(spark, sf_dir):
    got = consensus_of_others(votes(assertions(spark, sf_dir), sources(spark))).where("others IS NOT NULL")
    scores = got.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == F.col("others")).alias("hits"))
    return trust_weights(scores, FEW).select("unit", "n", "trust", "plateau", "weight")


# ---- agreement of one source with the others, beside that of the others among themselves


def nearest(a: DataFrame, b: DataFrame, window: int) -> DataFrame:
    """For each row of a the nearest in time of b at its place, of a compatible direction, at most window away, the least id on a tie: (obs_id, place_id, direction, value, other, seen, same). A band join by buckets of the window's width."""
    left = a.select("obs_id", "place_id", "direction", "t", "value", F.explode(F.array(*[F.expr(f"t div {window}") + k for k in (-1, 0, 1)])).alias("bucket"))
    right = b.select(F.col("obs_id").alias("other"), "place_id", F.col("direction").alias("d"), F.col("t").alias("u"), F.col("value").alias("w"), F.expr(f"t div {window}").alias("bucket"))
    fits = ((F.col("direction") == F.col("d")) | (F.col("direction") == "both") | (F.col("d") == "both")) & (F.abs(F.col("t") - F.col("u")) <= window)
    best = left.join(right, ["place_id", "bucket"]).where(fits).groupBy("obs_id", "place_id", "direction", "value").agg(F.min(F.struct(F.abs(F.col("t") - F.col("u")).alias("gap"), "other", "w", "d")).alias("m"))
    return best.select("obs_id", "place_id", "direction", "value", F.col("m.other").alias("other"), F.col("m.w").alias("seen"), ((F.col("m.d") == F.col("direction")) & (F.col("direction") != "both")).alias("same"))


def earn_out(pairs: DataFrame, control: DataFrame, least: int = 20) -> DataFrame:
    """Rows (part, key, pairs, agreement, control_pairs, control_agreement, gap): over all, by value said, by value where the direction is the same, by direction, by place with `least` pairs. The control is split by value only, and over all."""
    parts = F.array(
        F.struct(F.lit("overall").alias("part"), F.lit("").alias("key")), F.struct(F.lit("class").alias("part"), F.col("value").alias("key")), F.struct(F.lit("direction").alias("part"), F.col("direction").alias("key")),
        F.struct(F.lit("place").alias("part"), F.col("place_id").cast("string").alias("key")), F.when(F.col("same"), F.struct(F.lit("class_same_direction").alias("part"), F.col("value").alias("key"))),
    )
    rate = lambda: (F.count(F.lit(1)).alias("n"), F.round(F.count_if("hit") / F.count(F.lit(1)), 3).alias("rate"))
    split = lambda df: df.select((F.col("value") == F.col("seen")).alias("hit"), F.explode(parts).alias("p")).where("p IS NOT NULL").select("hit", "p.*").groupBy("part", "key").agg(*rate())
    one = split(pairs).where((F.col("part") != "place") | (F.col("n") >= least)).select("part", "key", F.col("n").alias("pairs"), F.col("rate").alias("agreement"))
    other = split(control).where(F.col("part").isin("overall", "class")).select("part", "key", F.col("n").alias("control_pairs"), F.col("rate").alias("control_agreement"))
    return one.join(other, ["part", "key"], "left").withColumn("gap", F.round(F.col("agreement") - F.col("control_agreement"), 3))


_N = """SELECT a.obs_id, a.place_id, a.direction, a.value, b.value AS seen, a.direction = b.direction AND a.direction <> 'both' AS same FROM obs a JOIN obs b ON a.place_id = b.place_id AND (a.direction = b.direction OR a.direction = 'both' OR b.direction = 'both') AND abs(a.t - b.t) <= {w}
 WHERE a.source_id = {s} AND b.source_id < {s} QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY abs(a.t - b.t), b.obs_id) = 1"""
_SPLIT = " UNION ALL ".join(f"SELECT '{part}' AS part, {key} AS key, count(*) AS n, round(avg(CASE WHEN value = seen THEN 1.0 ELSE 0.0 END), 3) AS rate FROM {{0}} {where} GROUP BY 1, 2" for part, key, where in (("overall", "''", ""), ("class", "value", ""), ("direction", "direction", ""), ("place", "CAST(place_id AS VARCHAR)", ""), ("class_same_direction", "value", "WHERE same")))


@query("ag_earnout_control", f"WITH {OBS}, pr AS ({_N.format(w=24 * HOUR, s=6)}), ct AS ({_N.format(w=24 * HOUR, s=5)}), a AS ({_SPLIT.format('pr')}), b AS ({_SPLIT.format('ct')}) SELECT a.part, a.key, a.n AS pairs, a.rate AS agreement, b.n AS control_pairs, b.rate AS control_agreement, round(a.rate - b.rate, 3) AS gap FROM a LEFT JOIN b ON a.part = b.part AND a.key = b.key AND a.part IN ('overall', 'class') WHERE a.part <> 'place' OR a.n >= 5")
def ag_earnout_control(spark, sf_dir):
    """The crowd against the channels, beside one channel against the others."""
    obs = observations(spark, sf_dir)
    pair = lambda s: nearest(obs.where(F.col("source_id") == s), obs.where(F.col("source_id") < s), 24 * HOUR)
    return earn_out(pair(6), pair(5), 5)


# ---- coverage

#: The configured fields; one is retired, one nobody feeds.
FIELDS = {"open": False, "slow": False, "congested": False, "closed": False, "other": True, "flooded": False}
CEILING = 7 * DAY


def field_states(obs: DataFrame, src: DataFrame, fields: dict[str, bool], now: int) -> DataFrame:
    """Every configured field (key, n, newest, state), fed or not: retired, never_reported, crowd_only, stale or live."""
    spark = obs.sparkSession
    known = spark.createDataFrame(list(fields.items()), "key string, retired boolean")
    seen = obs.join(F.broadcast(src), "source_id").groupBy(F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_kind") != "crowd").alias("others"), F.max("t").alias("newest"))
    state = F.when(F.col("retired"), "retired").when(F.col("n").isNull(), "never_reported").when(F.col("others") == 0, "crowd_only").when(F.lit(now) - F.col("newest") > CEILING, "stale").otherwise("live")
    return known.join(seen, "key", "left").select(F.lit("field").alias("part"), "key", F.coalesce("n", F.lit(0)).alias("n"), "newest", state.alias("state"))


def coverage(spark, sf_dir) -> DataFrame:
    """What is held: sources with claims and the newest of each, served states, kinds of places, fields."""
    obs = observations(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    source = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("newest"))
    served = obs.where("modality = 'assertion'").groupBy("place_id", "direction").agg(F.max_by("value", F.struct("t", "obs_id")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    kinds = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda df, name, newest: df.select(F.lit(name).alias("part"), "key", "n", newest.alias("newest"), none("string").alias("state"))
    out = part(source, "source", F.col("newest")).unionByName(part(served, "state", none("long"))).unionByName(part(kinds, "place", none("long")))
    return out.unionByName(field_states(obs, sources(spark), FIELDS, AS_OF))


@query("rt_coverage", f"""WITH {OBS}, sv AS (SELECT place_id, direction, max_by(value, (t, obs_id)) AS key FROM obs WHERE modality = 'assertion' GROUP BY 1, 2), fd(key, retired) AS (VALUES {', '.join(f"('{k}', {str(v).lower()})" for k, v in FIELDS.items())}),
sn AS (SELECT value AS key, count(*) AS n, count(*) FILTER (WHERE source_id <> 6) AS others, max(t) AS newest FROM obs GROUP BY 1)
SELECT 'source' AS part, source AS key, count(*) AS n, max(doc_id) AS newest, NULL AS state FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'state', key, count(*), NULL, NULL FROM sv GROUP BY key UNION ALL SELECT 'place', c_mktsegment, count(*), NULL, NULL FROM customer GROUP BY 2
UNION ALL SELECT 'field', key, coalesce(n, 0), newest, CASE WHEN retired THEN 'retired' WHEN n IS NULL THEN 'never_reported' WHEN others = 0 THEN 'crowd_only' WHEN {AS_OF} - newest > {CEILING} THEN 'stale' ELSE 'live' END FROM fd LEFT JOIN sn USING (key)""")
def rt_coverage(spark, sf_dir):
    return coverage(spark, sf_dir)
