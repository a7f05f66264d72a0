"""Independent voices and names that mean one place: sequence similarity, mirrors, merging, registries."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators.places import GENERIC, penalty
from tidemark.plans.register import query
from tidemark.sources.analogues import table


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks of two texts, as a diff finds them; no built-in function gives it. Null for null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@query("fn_seqmatch")
def fn_seqmatch(spark, sf_dir):
    """How much each turn repeats of the turn before it: the first 300 characters of both."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 300).alias("text"))
    t = t.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.round(ratio("before", "text"), 6).alias("ratio"))


def alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio of the whole texts is least or more. Bounds by lengths and by letters come first; then blocks are found as the ratio finds them, the widest open stretch first, until those still open cannot add up to it."""
    whole = len(a) + len(b)
    if a == b or not whole:
        return least <= 1.0
    reach = lambda n: 2.0 * n / whole >= least
    if not reach(min(len(a), len(b))) or not reach((Counter(a) & Counter(b)).total()):
        return False
    m, sure = SequenceMatcher(None, a, b), 0
    most, open_ = min(len(a), len(b)), [(-min(len(a), len(b)), 0, len(a), 0, len(b))]
    while open_ and reach(most) and not reach(sure):
        width, i, j, k, n = heappop(open_)
        x, y, size = m.find_longest_match(i, j, k, n)
        most, sure = most + width + size, sure + size
        for part in ((i, x, k, y), (x + size, j, y + size, n)) if size else ():
            if (width := min(part[1] - part[0], part[3] - part[2])) > 0:
                most += width
                heappush(open_, (-width, *part))
    return reach(sure)


def collapsed(members: DataFrame, least: float = 0.90) -> DataFrame:
    """members (cluster, at, unit, text): how many units of each cluster spoke in their own words.

    In order of time a unit whose text is as good as an earlier one's of another unit joins it. The
    fold keeps one text a unit, so its size is the number of units, not of members: each unit's
    first text stands for it, whole.
    """
    first = members.groupBy("cluster", "unit").agg(F.min_by(F.struct("at", F.coalesce("text", F.lit("")).alias("text")), F.struct("at", "text")).alias("m")).select("cluster", "unit", "m.*")

    def fold(units: pa.Table) -> pa.Table:
        seen: list[str] = []
        for u in sorted(units.to_pylist(), key=lambda u: [(v is not None, v) for v in (u["at"], u["unit"])]):
            if not any(u["text"] and t and alike(u["text"], t, least) for t in seen):
                seen.append(u["text"])
        return pa.table({"cluster": units["cluster"][:1].combine_chunks(), "units": [len(units)], "voices": [len(seen)]})

    # one cluster's texts at a time, over as many tasks as a shuffle has: few bytes can be much work
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(tasks, "cluster").groupBy("cluster").applyInArrow(fold, "cluster long, units long, voices long")


@query("gr_mirror_collapse")
def gr_mirror_collapse(spark, sf_dir):
    """Documents of neighbouring ids as clusters, sources as units; whole texts."""
    d = table(spark, sf_dir, "documents")
    return collapsed(d.select(F.floor(F.col("doc_id") / 20).alias("cluster"), F.col("doc_id").alias("at"), F.col("source").alias("unit"), "text"))


# ---- places that are one

BASES = "salim awad marda yatta zeita rafat halhul aqraba qibya sinjil".split()


def merge_plan(p: DataFrame, at: list[str]) -> DataFrame:
    """Places (id, name, n) at one point: the canonical one, and which others fold into it.

    A name with a status word is no name and always folds; another folds if it shares an identifying
    word with the canonical name; what merely lies on the same point stays. Rows (id, into).
    """
    words = F.filter(F.split(X.normalize(F.col("name")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC) & ~w.rlike("^[0-9]+$"))
    x = penalty(F.col("name"))
    m = p.select("id", "name", *at, words.alias("words"), (x["status"] > 0).alias("no_name"), F.struct(x["status"].alias("a"), (-F.col("n")).alias("b"), x["words"].alias("c"), x["letters"].alias("d"), "id").alias("order"))
    best = m.groupBy(*at).agg(F.min_by(F.struct("id", "words"), "order").alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    j = m.join(best, at).where(F.col("id") != F.col("c.id"))
    return j.select("id", F.when(F.col("no_name") | F.arrays_overlap("words", F.col("c.words")), F.col("c.id")).alias("into"))


@query("gr_place_merge", f"WITH p AS (SELECT c_custkey AS id, c_custkey // 4 AS y, c_custkey % 4 AS f, {BASES!r}[(c_custkey // 4) % 10 + 1] AS base, {BASES!r}[(c_custkey // 4 + 3) % 10 + 1] AS other FROM customer), g AS (SELECT y, count(*) AS k, min(id) AS first FROM p WHERE f IN (0, 1) GROUP BY 1), o AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT p.*, row_number() OVER (PARTITION BY p.y ORDER BY f = 3, -coalesce(n, 0), CASE f WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END, length(CASE f WHEN 0 THEN base WHEN 1 THEN base || ' gate' WHEN 2 THEN other || ' town' ELSE base || ' closed now' END), p.id) AS rn, count(*) OVER (PARTITION BY p.y) AS members FROM p LEFT JOIN o USING (id)), c AS (SELECT y, id AS cid, CASE WHEN f = 2 THEN other ELSE base END AS cword FROM r WHERE rn = 1 AND members > 1) SELECT r.id, CASE WHEN f = 3 OR CASE WHEN f = 2 THEN other ELSE base END = cword THEN cid END AS into FROM r JOIN c USING (y) WHERE rn > 1")
def gr_place_merge(spark, sf_dir):
    """Four names a point: a name, the same at its gate, another place's, and a sentence with a status word."""
    k = F.col("c_custkey")
    pick = lambda shift: F.get(F.array(*map(F.lit, BASES)), ((F.floor(k / 4) + shift) % 10).cast("int"))
    f = k % 4
    name = F.when(f == 0, pick(0)).when(f == 1, F.concat(pick(0), F.lit(" gate"))).when(f == 2, F.concat(pick(3), F.lit(" town"))).otherwise(F.concat(pick(0), F.lit(" closed now")))
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.floor(k / 4).alias("y"), name.alias("name"))
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return merge_plan(p.join(n, "id", "left").na.fill(0, ["n"]), ["y"])


# ---- a registry generated from declared rules

#: Declared rules in order: (test, concept, kind, unit).
REGISTRY = [(("prefix", "ECON"), "trade", "flow", "items"), (("regex", "^(MED|PROMO)"), "stock", "stock", "items"), (("equals", "STANDARD"), "base", "cumulative", "items")]


def registry(seen: DataFrame, rules=REGISTRY) -> DataFrame:
    """seen (indicator, n): the definition of each by the first rule that fits; what no rule knows is unclassified, not guessed. How many rules fit is kept: more than one is a conflict."""
    name = F.col("indicator")
    tests = {"prefix": lambda v: name.startswith(v), "regex": lambda v: name.rlike(v), "equals": lambda v: name == v}
    fits = [(tests[kind](v), concept, measure, unit) for (kind, v), concept, measure, unit in rules]
    pick = F.coalesce(*[F.when(ok, F.struct(F.lit(c).alias("concept"), F.lit(m).alias("kind"), F.lit(u).alias("unit"))) for ok, c, m, u in fits], F.struct(F.lit(None).cast("string").alias("concept"), F.lit("unclassified").alias("kind"), F.lit(None).cast("string").alias("unit")))
    many = sum((ok.cast("int") for ok, *_ in fits), F.lit(0))
    return seen.select("indicator", "n", pick.alias("d"), (many > 1).alias("conflict")).select("indicator", "n", "d.*", "conflict")


@query("mt_registry_load", "SELECT p_type AS indicator, count(*) AS n, CASE WHEN p_type LIKE 'ECON%' THEN 'trade' WHEN regexp_matches(p_type, '^(MED|PROMO)') THEN 'stock' WHEN p_type = 'STANDARD' THEN 'base' END AS concept, CASE WHEN p_type LIKE 'ECON%' THEN 'flow' WHEN regexp_matches(p_type, '^(MED|PROMO)') THEN 'stock' WHEN p_type = 'STANDARD' THEN 'cumulative' ELSE 'unclassified' END AS kind, CASE WHEN p_type LIKE 'ECON%' OR regexp_matches(p_type, '^(MED|PROMO)') OR p_type = 'STANDARD' THEN 'items' END AS unit, false AS conflict FROM part GROUP BY p_type")
def mt_registry_load(spark, sf_dir):
    return registry(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("indicator")).agg(F.count(F.lit(1)).alias("n")))


@query("jn_cross_const", "SELECT o_orderpriority AS category, v.name AS version, count(*) FILTER (WHERE o_totalprice > v.least) AS n FROM orders, (VALUES ('low', 1000.0), ('mid', 100000.0), ('high', 300000.0)) AS v(name, least) GROUP BY 1, 2")
def jn_cross_const(spark, sf_dir):
    """Every row against a few constants: an array of literals, exploded after the partial sums."""
    levels = [("low", 1000.0), ("mid", 100000.0), ("high", 300000.0)]
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(*[F.count_if(F.col("o_totalprice") > v).alias(n) for n, v in levels])
    return g.unpivot(["category"], [n for n, _ in levels], "version", "n")
