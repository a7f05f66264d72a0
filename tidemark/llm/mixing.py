"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's part of `share` of all words, at most `cap` times its own
size; the excess is shared again by weight. A source with target T and size S gives
floor(T / S) complete epochs; the rest is filled in the order of exponential keys
-ln(u) / quality, u a hash of seed, id and text, up to the document that brings the sum
nearest to the target.

The order within a source is cut without sorting the source in one task: keys fall into about
sqrt(n) buckets, bucket sums are prefix-summed, and only the one bucket that holds the cut is
sorted. The cut then is a key, so that choosing is a comparison on each row and texts are not
moved.

Rows that are equal in all columns share a key. Where the cut falls among them, so many are taken
that the sum comes nearest to the target; as they are equal, one of them and two numbers stand for
all, and their rows are made anew, spread over tasks by CHUNK.

Defined results: null text has size 0; null is a source of its own, the last one; null ids are
allowed; sources may meet their caps at the same level; a source of size 0 has target 0
and gives nothing; a cap that is no whole number leaves a full source its fraction, chosen like any
other; texts may be of any length; an empty table gives an empty result. Extra columns are passed on by
`mixed`; the columns it adds start with `mix_`, and any of the input by such a name are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import NO_ID, SPACE, docs_of, written

WEIGHTS, SHARE, CAP, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20240131
#: Equal rows that one step of a task makes.
CHUNK = 10_000


def text_quality(text: Column) -> Column:
    """0.25 to 1: the share of letters among a text's characters that are not white space."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]+", ""))
    return 0.25 + 0.75 * letters / F.greatest(F.length(solid), F.lit(1))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: one row a source (source, source_size, ...). Adds target, by filling in the order of cap / weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    df = sizes.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    df = df.withColumn("_level", (share * F.sum("source_size").over(everything) - before) / rest).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    first_open = F.min(F.when(~F.col("_full"), F.struct("_at", F.col("_level").alias("level")))).over(everything)
    df = df.withColumn("_at", F.row_number().over(order)).withColumn("_open", first_open["level"])
    return df.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_open"))).drop("_w", "_cap", "_ratio", "_level", "_full", "_at", "_open")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target (double) and mix_copies, how often the mix takes the row."""
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident, text), 11)
    key = -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / (text_quality(F.col(text_col)) if quality is None else quality)
    others = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col, source_col)]
    rank = F.struct(key.alias("k"), ident.alias("i"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col), F.col(text_col), *others).alias("o"))

    rows = written(docs.select(F.col(source_col).alias("source"), size.alias("size"), rank.alias("rank")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    plan = targets(sizes, weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("_b", F.ceil(F.sqrt("_n")))
    plan = written(plan, "mix-plan")

    by_source = lambda a, b: a.join(b.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = by_source(rows, plan).withColumn("bucket", F.floor(F.col("_b") * (1 - F.exp(-F.col("rank.k")))))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    w = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(w))
    cross = sums.where("upto > left").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    cross = written(cross.select("source", F.col("x.bucket").alias("xb"), F.col("x.before").alias("before")), "mix-cross")
    inside = by_source(dealt, cross).where("bucket = xb").groupBy("source", "rank", "size", "before", "left").agg(F.count(F.lit(1)).alias("g"))
    w = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("g")).over(w), F.lit(0)))
    nearest = F.floor((F.col("left") - F.col("at")) / F.greatest("size", F.lit(1)) + 0.5)
    inside = inside.withColumn("m", F.when(F.col("size") == 0, F.when(F.col("at") <= F.col("left"), F.col("g")).otherwise(0)).otherwise(F.least("g", nearest)))
    cut = inside.where("m > 0").groupBy("source").agg(F.max(F.struct("rank", "m", "g")).alias("c")).select("source", F.col("c.rank").alias("cut"), F.col("c.m").alias("m"), F.col("c.g").alias("g"))
    left_join = lambda a, b: a.join(b.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = written(left_join(left_join(plan, cross), cut), "mix-cut")

    own = [f"_c{k}" for k in range(len(docs.columns))]  # names of our own: no column of docs can clash with the plan's
    df = docs.select(*[docs[c].alias(k) for c, k in zip(docs.columns, own)], size.alias("mix_size"), rank.alias("rank"), F.col(source_col).alias("_source"))
    df = df.join(plan, F.col("_source").eqNullSafe(F.col("source")), "left")
    bucket = F.floor(F.col("_b") * (1 - F.exp(-F.col("rank.k"))))
    at_cut = F.coalesce((bucket == F.col("xb")) & (F.col("rank") == F.col("cut")), F.lit(False))
    chosen = F.col("xb").isNull() | (bucket < F.col("xb")) | F.coalesce((bucket == F.col("xb")) & (F.col("rank") <= F.col("cut")), F.lit(False))
    extra = F.when((F.col("left") > 0) & (F.col("source_size") > 0), chosen.cast("long")).otherwise(F.lit(0).cast("long"))
    if not plan.where("m < g").isEmpty():  # equal rows at a cut: one stands for all
        parted = at_cut & (F.col("m") < F.col("g"))
        one = df.where(parted).groupBy("_source").agg(*[F.any_value(k).alias(k) for k in [*own, "mix_size", "source_size", "target", "epochs", "left", "m", "g"]])
        steps = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("g") - 1) / CHUNK))).alias("_step")).repartition("_source", "_step")
        numbers = F.sequence(F.col("_step") * CHUNK + 1, F.least("g", (F.col("_step") + 1) * CHUNK))
        made = steps.select("*", F.explode(numbers).alias("_number")).withColumn("extra", (F.col("_number") <= F.col("m")).cast("long"))
        df = df.where(~F.coalesce(parted, F.lit(False))).withColumn("extra", extra)
        df = df.select(*own, "mix_size", "source_size", "target", "epochs", "extra").unionByName(made.select(*own, "mix_size", "source_size", "target", "epochs", "extra"))
    else:
        df = df.withColumn("extra", extra)
    copies = F.col("extra") + F.when(F.col("source_size") > 0, F.col("epochs")).otherwise(0)
    return df.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, own)], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.cast("long").alias("mix_copies"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixed(docs_of(spark, sf_dir).select("doc_id", "text", "source"))
    return df.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
