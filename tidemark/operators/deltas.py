"""Retract and reassert: a new version of a classifier moves reports between events by signed deltas.

Only reports whose verdict is not of the current version are read again. What changed is summed
as signed counts into a table of contributions (event, unit, n), so that an event's reports and
independent units follow without a recount. An event that nothing refers to any longer is
retracted and kept; it is live again once something does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.textops import RULES, cascade
from tidemark.plans.register import query
from tidemark.plans.steps import written
from tidemark.sources.analogues import table


def stale(claims: DataFrame, verdicts: DataFrame, version: int) -> DataFrame:
    """Claims without a verdict of this version, with the event they were given, if any."""
    had = verdicts.select("claim", F.col("version").alias("_had"), F.col("event").alias("_old"))
    return claims.join(had, "claim", "left").where(F.col("_had").isNull() | (F.col("_had") < version))


def deltas(again: DataFrame, event: Column) -> DataFrame:
    """again: stale claims. Rows (event, unit, n): signed counts; what did not move sums to nothing and is left out."""
    moved = F.array(F.struct(F.col("_old").alias("event"), F.lit(-1).alias("n")), F.struct(event.alias("event"), F.lit(1).alias("n")))
    rows = again.select("unit", F.explode(moved).alias("x")).select("x.event", "unit", "x.n").where("event IS NOT NULL")
    return rows.groupBy("event", "unit").agg(F.sum("n").alias("n")).where("n != 0")


def apply(contributions: DataFrame, events: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables after changed deltas: contributions (event, unit, n) without zeros, events (event, status, reports, units).

    A sum below zero would take back what was never given and fails the job.
    """
    both = contributions.unionByName(changed).groupBy("event", "unit").agg(F.sum("n").alias("n"))
    ok = F.assert_true(F.col("n") >= 0, F.lit("more is taken back than was given"))
    contributions = written(both.where(ok.isNull() & (F.col("n") != 0)), "contributions")
    touched = changed.select("event").distinct()
    now = contributions.join(touched, "event", "left_semi").groupBy("event").agg(F.sum("n").alias("reports"), F.count(F.lit(1)).alias("units"))
    now = touched.join(now, "event", "left").select("event", F.when(F.col("reports").isNull(), "retracted").otherwise("live").alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reports", "units")])
    return contributions, written(events.join(touched, "event", "left_anti").unionByName(now), "events")


def rebuild(claims: DataFrame, verdicts: DataFrame, contributions: DataFrame, events: DataFrame, version: int, event: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """verdicts, contributions and events after every stale claim was classed by `event`, a column of claims."""
    again = written(stale(claims, verdicts, version), "stale")
    fresh = again.select("claim", F.lit(version).alias("version"), event.alias("event"))
    after = written(verdicts.join(again.select("claim"), "claim", "left_anti").select("claim", "version", "event").unionByName(fresh), "verdicts")
    return after, *apply(contributions, events, deltas(again, event))


# ---- the query: documents are reports, by two versions of the rules


def _named(type_: Column) -> Column:
    return F.when(type_ != "plain", F.concat_ws(":", type_, F.expr("doc_id div 10")))


def _types(text: Column) -> tuple[Column, Column]:
    """The first version knows two rules, in the other order than the second, which knows all."""
    return cascade(text, RULES[:2][::-1]), cascade(text)


_V = "CASE {} ELSE 'plain' END"
_RULE = {"reject": "regexp_matches(text, '(?i)idiot|moron')", "mail": "regexp_matches(text, '[\\w.]+@[\\w.]+')", "number": "regexp_matches(text, '\\d{6,}')", "marked": "regexp_matches(text, '[#$%&*]{3}')"}
_SQL = """WITH v AS (SELECT doc_id, source, CASE {} ELSE 'plain' END AS one, CASE {} ELSE 'plain' END AS two FROM documents),
e AS (SELECT source, CASE WHEN one <> 'plain' THEN one || ':' || CAST(doc_id // 10 AS VARCHAR) END AS one, CASE WHEN two <> 'plain' THEN two || ':' || CAST(doc_id // 10 AS VARCHAR) END AS two, doc_id % 5 = 0 AS ahead FROM v),
now AS (SELECT two AS event, count(*) AS reports, count(DISTINCT coalesce(source, '')) AS units FROM e WHERE two IS NOT NULL GROUP BY 1), was AS (SELECT DISTINCT CASE WHEN ahead THEN two ELSE one END AS event FROM e)
SELECT coalesce(now.event, was.event) AS event, CASE WHEN now.event IS NULL THEN 'retracted' ELSE 'live' END AS status, coalesce(reports, 0) AS reports, coalesce(units, 0) AS units FROM now FULL JOIN (SELECT event FROM was WHERE event IS NOT NULL) was ON was.event = now.event""".format(
    " ".join(f"WHEN {_RULE[k]} THEN '{k}'" for k in ("mail", "reject")), " ".join(f"WHEN {_RULE[k]} THEN '{k}'" for k in ("reject", "mail", "number", "marked"))
)


@query("st_rebuild", _SQL)
def st_rebuild(spark, sf_dir):
    """Events after the second version of the rules: a fifth of the reports had been read by it before. The SQL recounts everything."""
    docs = table(spark, sf_dir, "documents")
    claims = docs.select(F.col("doc_id").alias("claim"), "doc_id", "text", F.coalesce("source", F.lit("")).alias("unit"))
    one, two = map(_named, _types(F.col("text")))
    ahead = F.col("claim") % 5 == 0
    first = claims.select("claim", F.when(ahead, 2).otherwise(1).alias("version"), F.when(ahead, two).otherwise(one).alias("event"), "unit")
    first = written(first, "first")
    none = spark.createDataFrame([], "event string, unit string, n long"), spark.createDataFrame([], "event string, status string, reports long, units long")
    given = first.where("event IS NOT NULL").groupBy("event", "unit").agg(F.count(F.lit(1)).alias("n"))
    contributions, events = apply(*none, given)
    return rebuild(claims, first.drop("unit"), contributions, events, 2, two)[2]
