"""Declared transforms: a specification as data, compiled to columns; and the checks before a load is written."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.analogues import table

Condition = dict[str, Any]


def condition(c: Condition, fetch_day: str | None = None) -> Column:
    """A closed grammar: all, any, always, and tests of one field; values compare as text, and null fits nothing but absent."""
    (op, arg), = ((k, v) for k, v in c.items() if k != "field")
    if op in ("all", "any"):
        out = F.lit(op == "all")
        for x in arg:
            out = out & condition(x, fetch_day) if op == "all" else out | condition(x, fetch_day)
        return out
    if op == "always":
        return F.lit(True)
    value = F.col(c["field"]).cast("string")
    tests = {
        "eq": lambda: value == str(arg), "ne": lambda: value != str(arg), "in": lambda: value.isin([str(x) for x in arg]),
        "startswith": lambda: value.startswith(arg), "endswith": lambda: value.endswith(arg),
        "present": lambda: value.isNotNull() & (value != ""), "absent": lambda: value.isNull() | (value == ""),
        "equals_fetch_day": lambda: F.substring(value, 1, 10) == F.lit(fetch_day),
    }
    if op not in tests:
        raise ValueError(f"no such test: {op}")
    return F.coalesce(tests[op](), F.lit(False))


def template(text: str, slug: bool = False) -> Column:
    """`a.{field}.b`: segments between dots; one whose field is null or empty is left out."""
    parts = []
    for part in text.split("."):
        if part.startswith("{") and part.endswith("}"):
            v = F.col(part[1:-1]).cast("string")
            v = F.btrim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "_"), F.lit("_")) if slug else v
            parts.append(F.when(v != "", v))
        else:
            parts.append(F.lit(part))
    return F.concat_ws(".", *parts)


def resolve_date(rules: list[dict[str, Any]], fetch_day: str) -> Column:
    """The first rule whose condition fits gives (date, precision); a year is its first day; the fetch day itself is no date."""
    out = F.lit(None).cast("struct<date:date,precision:string>")
    for r in reversed(rules):
        d = F.to_date(F.col(r["field"]))
        d = F.trunc(d, r["precision"]) if r["precision"] in ("year", "month") else d
        grade = F.when(d == F.lit(fetch_day).cast("date"), "unknown").otherwise(r["precision"])
        out = F.when(condition(r.get("when", {"always": True}), fetch_day) & d.isNotNull(), F.struct(d.alias("date"), grade.alias("precision"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Spec:
    """A category's transform."""

    indicator: str
    value: str
    dates: list[dict[str, Any]]
    drops: list[tuple[str, Condition]] = field(default_factory=list)
    identity: tuple[str, ...] = ()
    min_records: int = 0
    max_observations: int | None = None
    decided: float = 0.0


def transform(records: DataFrame, spec: Spec, fetch_day: str) -> DataFrame:
    """records with drop (the first reason that fits, else null), indicator, value, at, precision and identity."""
    drop = F.lit(None).cast("string")
    for reason, when in reversed(spec.drops):
        drop = F.when(condition(when, fetch_day), reason).otherwise(drop)
    date = resolve_date(spec.dates, fetch_day)
    identity = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.identity])
    return records.select("*", drop.alias("drop"), template(spec.indicator, slug=True).alias("indicator"), F.col(spec.value).cast("double").alias("value"), date["date"].alias("at"), date["precision"].alias("precision"), identity.alias("identity"))


class Refused(ValueError):
    """A load broke its contract; nothing is written."""


def enforce(rows: DataFrame, spec: Spec) -> dict[str, float]:
    """All checks of a load in one pass over its rows; raises with every problem found."""
    kept = F.col("drop").isNull()
    got = rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(kept).alias("rows"), F.count_distinct(F.when(kept, F.col("identity"))).alias("identities"), F.avg((F.col("precision") != "unknown").cast("double")).alias("decided")).first().asDict()
    problems = []
    if got["records"] < spec.min_records:
        problems.append(f"{got['records']} records, {spec.min_records} are the least")
    if spec.max_observations is not None and got["rows"] > spec.max_observations:
        problems.append(f"{got['rows']} rows, {spec.max_observations} are the most")
    if got["identities"] != got["rows"]:
        problems.append(f"{got['rows']} rows have {got['identities']} identities")
    if (got["decided"] or 0.0) < spec.decided:
        problems.append(f"{got['decided']} of dates are decided, {spec.decided} must be")
    if problems:
        raise Refused("; ".join(problems))
    return got


ORDERS = Spec(
    indicator="orders.{o_orderpriority}.{o_orderstatus}", value="o_totalprice",
    dates=[{"when": {"field": "o_orderstatus", "eq": "P"}, "field": "o_orderdate", "precision": "year"}, {"when": {"field": "o_orderpriority", "startswith": "4"}, "field": "o_orderdate", "precision": "month"}, {"field": "o_orderdate", "precision": "day"}],
    drops=[("small", {"all": [{"field": "o_orderstatus", "in": ["F", "O"]}, {"field": "o_orderpriority", "eq": "5-LOW"}]}), ("odd", {"field": "o_custkey", "endswith": "7"})],
    identity=("o_orderkey", "o_orderdate"), min_records=1, decided=0.5,
)
FETCH = "1998-03-05"
DROP = "CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority = '5-LOW' THEN 'small' WHEN CAST(o_custkey AS VARCHAR) LIKE '%7' THEN 'odd' END"
GRADE = "CASE WHEN o_orderstatus = 'P' THEN 'year' WHEN o_orderpriority LIKE '4%' THEN 'month' ELSE 'day' END"
DATE = f"CAST(date_trunc({GRADE}, o_orderdate) AS DATE)"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.expr("cast(o_orderdate AS timestamp_ntz)"))


@query("etl_transform", f"SELECT o_orderkey, {DROP} AS drop, 'orders.' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') || '.' || lower(o_orderstatus) AS indicator, {DATE} AS at_day, CASE WHEN {DATE} = DATE '{FETCH}' THEN 'unknown' ELSE {GRADE} END AS precision FROM orders")
def etl_transform(spark, sf_dir):
    return transform(_orders(spark, sf_dir), ORDERS, FETCH).select("o_orderkey", "drop", "indicator", F.col("at").alias("at_day"), "precision")


@query("flt_closed_grammar", f"SELECT coalesce({DROP}, 'kept') AS verdict, count(*) AS n FROM orders GROUP BY 1")
def flt_closed_grammar(spark, sf_dir):
    return transform(_orders(spark, sf_dir), ORDERS, FETCH).groupBy(F.coalesce("drop", F.lit("kept")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_resolve_date", f"SELECT CASE WHEN {DATE} = DATE '{FETCH}' THEN 'unknown' ELSE {GRADE} END AS precision, count(*) AS n, min({DATE}) AS first FROM orders GROUP BY 1")
def fn_resolve_date(spark, sf_dir):
    return transform(_orders(spark, sf_dir), ORDERS, FETCH).groupBy("precision").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


@query("etl_enforce", f"SELECT count(*) AS records, count(*) FILTER (WHERE {DROP} IS NULL) AS rows, count(DISTINCT CASE WHEN {DROP} IS NULL THEN o_orderkey END) AS identities FROM orders")
def etl_enforce(spark, sf_dir):
    rows = transform(_orders(spark, sf_dir), ORDERS, FETCH)
    enforce(rows, ORDERS)
    kept = F.col("drop").isNull()
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(kept).alias("rows"), F.count_distinct(F.when(kept, F.col("identity"))).alias("identities"))


@query("fn_identity_key", "SELECT o_orderkey, md5(o_orderkey || '|' || coalesce(o_orderstatus, '') || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS key FROM orders")
def fn_identity_key(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.md5(F.concat_ws("|", "o_orderkey", F.coalesce("o_orderstatus", F.lit("")), F.col("o_orderdate").cast("date").cast("string"))).alias("key"))


@query("fn_content_of", "SELECT sha256('{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS content, count(*) AS n FROM orders GROUP BY 1")
def fn_content_of(spark, sf_dir):
    """A fingerprint of canonical JSON: keys in order."""
    j = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return _orders(spark, sf_dir).groupBy(F.sha2(j, 256).alias("content")).agg(F.count(F.lit(1)).alias("n"))
