"""Versioned tables: as-of reading, superseding, identities, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.analogues import AS_OF, DAY, OBS, SRC, VERSIONS, observations, sources, versions

AT = 820_454_400_000_000  # 1996-01-01, inside the orders' span


def valid_at(at: int | Column, sys_from: str = "sys_from", sys_to: str = "sys_to") -> Column:
    """Half-open validity: from <= at < to, an open end never closes. Pushes down to the scan for a literal."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.col(sys_from) <= at) & (F.col(sys_to).isNull() | (F.col(sys_to) > at))


def supersede(held: DataFrame, emitted: DataFrame, key: list[str], content: list[str], at: int, complete: bool = False, max_absent: float = 0.05) -> DataFrame:
    """A new state of a versioned table from what a source now says.

    held: key, content, sys_from, sys_to. Open rows with another content are closed at `at` and a
    new version opened; new keys are opened; with complete=True open keys that are not emitted
    are closed, but the job fails if more than max_absent of them would be. Nothing is deleted.
    """
    now, old = held.where("sys_to IS NULL"), held.where("sys_to IS NOT NULL")
    same = F.struct(*[F.col(f"h.{c}") for c in content]).eqNullSafe(F.struct(*[F.col(f"e.{c}") for c in content]))
    on = F.lit(True)
    for k in key:
        on &= F.col(f"h.{k}").eqNullSafe(F.col(f"e.{k}"))
    met = now.withColumn("_h", F.lit(1)).alias("h").join(emitted.withColumn("_e", F.lit(1)).alias("e"), on, "full")
    status = F.when(F.col("_h").isNull(), "new").when(F.col("_e").isNull(), "absent").when(same, "same").otherwise("changed")
    met = met.withColumn("_s", status)
    if complete:
        n = met.agg(F.count_if(F.col("_s") == "absent").alias("a"), F.count_if(F.col("_h") == 1).alias("h")).first()
        if n["h"] and n["a"] > max_absent * n["h"]:
            raise ValueError(f"{n['a']} of {n['h']} open rows would vanish")
    closing = F.col("_s") == "changed"
    if complete:
        closing |= F.col("_s") == "absent"
    cols = [*key, *content]
    kept = met.where("_h = 1").select(*[F.col(f"h.{c}").alias(c) for c in cols], F.col("sys_from"), F.when(closing, F.lit(at)).alias("sys_to"))
    opened = met.where("_s IN ('new', 'changed')").select(*[F.col(f"e.{c}").alias(c) for c in cols], F.lit(at).cast("long").alias("sys_from"), F.lit(None).cast("long").alias("sys_to"))
    return old.select(*cols, "sys_from", "sys_to").unionByName(kept).unionByName(opened)


def scd2(changes: DataFrame, key: list[str], order: list[str], content: list[str], t: str = "t") -> DataFrame:
    """Versions from a log of changes: a row counts if its content differs from the one before, and holds until the next that counts."""
    w = Window.partitionBy(*key).orderBy(*order)
    value = F.struct(*content)
    log = changes.withColumn("_p", F.lag(value).over(w)).where(F.col("_p").isNull() | ~value.eqNullSafe(F.col("_p")))
    return log.select(*key, *content, F.col(t).alias("sys_from"), F.lead(t).over(w).alias("sys_to"))


def rollup_daily(obs: DataFrame, src: DataFrame) -> DataFrame:
    """Rows (place_id, kind, day, indicator, value): reports, reports by value, and distinct units, of distinct reports a day."""
    day = F.floor(F.col("t") / DAY).cast("int")
    one = obs.where("modality = 'assertion'").join(F.broadcast(src.select("source_id", "unit")), "source_id").select("place_id", "kind", day.alias("day"), "t", "value", "unit", "direction").distinct()
    base = one.groupBy("place_id", "kind", "day", "value").agg(F.count(F.lit(1)).alias("n"))
    by_value = base.select("place_id", "kind", "day", F.concat(F.lit("reports."), "value").alias("indicator"), F.col("n").alias("value"))
    total = base.groupBy("place_id", "kind", "day").agg(F.sum("n").alias("value")).select("place_id", "kind", "day", F.lit("reports").alias("indicator"), "value")
    units = one.groupBy("place_id", "kind", "day").agg(F.count_distinct("unit").alias("value")).select("place_id", "kind", "day", F.lit("units").alias("indicator"), "value")
    return total.unionByName(by_value).unionByName(units)


@query("flt_as_of", f"WITH {VERSIONS} SELECT key, owner, status, value FROM versions WHERE sys_from <= {AT} AND (sys_to IS NULL OR {AT} < sys_to)")
def flt_as_of(spark, sf_dir):
    return versions(spark, sf_dir).where(valid_at(AT)).select("key", "owner", "status", "value")


@query("flt_row_cursor", f"WITH {OBS} SELECT obs_id, t FROM obs WHERE t > {AS_OF} - 864000000000 OR (t = {AS_OF} - 864000000000 AND obs_id > 500) ORDER BY t, obs_id LIMIT 200")
def flt_row_cursor(spark, sf_dir):
    at = AS_OF - 10 * DAY
    return observations(spark, sf_dir).where((F.col("t") > at) | ((F.col("t") == at) & (F.col("obs_id") > 500))).orderBy("t", "obs_id").limit(200).select("obs_id", "t")


@query("flt_null_safe", f"WITH {VERSIONS}, p AS (SELECT *, lag(sys_to) OVER (PARTITION BY owner ORDER BY sys_from, key) AS prev FROM versions) SELECT count(*) AS n FROM p WHERE sys_to IS DISTINCT FROM prev")
def flt_null_safe(spark, sf_dir):
    w = Window.partitionBy("owner").orderBy("sys_from", "key")
    return versions(spark, sf_dir).withColumn("p", F.lag("sys_to").over(w)).where(~F.col("sys_to").eqNullSafe(F.col("p"))).agg(F.count(F.lit(1)).alias("n"))


SCD = f"""{OBS}, c AS (SELECT *, lag(value) OVER w AS p FROM obs WHERE modality = 'assertion' WINDOW w AS (PARTITION BY place_id, kind, direction ORDER BY t, obs_id)),
k AS (SELECT * FROM c WHERE value IS DISTINCT FROM p), v AS (SELECT place_id, kind, direction, value, t AS sys_from, lead(t) OVER (PARTITION BY place_id, kind, direction ORDER BY t, obs_id) AS sys_to FROM k)"""


@query("wn_change_detect_keep", f"WITH {SCD} SELECT * FROM v")
def wn_change_detect_keep(spark, sf_dir):
    return scd2(observations(spark, sf_dir).where("modality = 'assertion'"), ["place_id", "kind", "direction"], ["t", "obs_id"], ["value"])


@query("ag_event_versions", f"WITH {SCD} SELECT value, count(*) AS versions, count(*) FILTER (WHERE sys_to IS NULL) AS open, round(avg(sys_to - sys_from) / 6e7, 3) AS minutes FROM v GROUP BY 1")
def ag_event_versions(spark, sf_dir):
    return wn_change_detect_keep(spark, sf_dir).groupBy("value").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("sys_to").isNull()).alias("open"), F.round(F.avg(F.col("sys_to") - F.col("sys_from")) / 6e7, 3).alias("minutes"))


ROLL = f"""{OBS}, {SRC}, one AS (SELECT DISTINCT place_id, kind, CAST(floor(t / 86400000000) AS INTEGER) AS day, t, value, unit, direction FROM obs JOIN src USING (source_id) WHERE modality = 'assertion'),
roll AS (SELECT place_id, kind, day, 'reports' AS indicator, count(*) AS value FROM one GROUP BY ALL
  UNION ALL SELECT place_id, kind, day, 'reports.' || value, count(*) FROM one GROUP BY place_id, kind, day, value
  UNION ALL SELECT place_id, kind, day, 'units', count(DISTINCT unit) FROM one GROUP BY place_id, kind, day)"""


@query("ag_rollup_daily", f"WITH {ROLL} SELECT * FROM roll")
def ag_rollup_daily(spark, sf_dir):
    return rollup_daily(observations(spark, sf_dir), sources(spark))


@query("ag_history_area", f"WITH {ROLL} SELECT CAST(place_id % 5 AS BIGINT) AS area, day, indicator, CAST(sum(value) AS BIGINT) AS value FROM roll WHERE indicator <> 'units' GROUP BY ALL")
def ag_history_area(spark, sf_dir):
    roll = rollup_daily(observations(spark, sf_dir), sources(spark)).where("indicator <> 'units'")
    return roll.groupBy((F.col("place_id") % 5).alias("area"), "day", "indicator").agg(F.sum("value").alias("value"))


@query("ag_history_place", f"WITH {ROLL} SELECT place_id, day, CAST(coalesce(sum(value) FILTER (WHERE indicator = 'reports'), 0) AS BIGINT) AS reports, CAST(coalesce(sum(value) FILTER (WHERE indicator = 'reports.closed'), 0) AS BIGINT) AS closed, CAST(coalesce(sum(value) FILTER (WHERE indicator = 'units'), 0) AS BIGINT) AS units FROM roll GROUP BY ALL")
def ag_history_place(spark, sf_dir):
    roll = rollup_daily(observations(spark, sf_dir), sources(spark))
    got = roll.groupBy("place_id", "day").pivot("indicator", ["reports", "reports.closed", "units"]).agg(F.sum("value"))
    return got.select("place_id", "day", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c.split(".")[-1]) for c in ("reports", "reports.closed", "units")])


@query("ag_rollup_pending", f"WITH {OBS}, d AS (SELECT DISTINCT CAST(floor(t / 86400000000) AS INTEGER) AS day FROM obs), done AS (SELECT day FROM d WHERE day % 3 <> 0), s AS (SELECT CAST(unnest(range(min(day), CAST({AS_OF} // 86400000000 AS INTEGER))) AS INTEGER) AS day FROM d) SELECT day FROM s SEMI JOIN d USING (day) ANTI JOIN done USING (day)")
def ag_rollup_pending(spark, sf_dir):
    """Complete days with data and without a roll-up; here every third day's is missing."""
    days = observations(spark, sf_dir).select(F.floor(F.col("t") / DAY).cast("int").alias("day")).distinct()
    done = days.where("day % 3 <> 0")
    span = days.agg(F.min("day").alias("a")).select(F.explode(F.sequence("a", F.lit(AS_OF // DAY - 1))).alias("day"))
    return span.join(days, "day", "left_semi").join(done, "day", "left_anti")


EMITTED = "emitted AS (SELECT key, CASE WHEN key % 7 = 0 THEN value + 1 ELSE value END AS value FROM versions WHERE sys_to IS NULL AND key % 11 <> 0 UNION ALL SELECT -key, value FROM versions WHERE key % 13 = 0)"


def emitted(v: DataFrame) -> DataFrame:
    """A later load of the open rows: some revised, some gone, some new."""
    live = v.where("sys_to IS NULL AND key % 11 <> 0").select("key", F.when(F.col("key") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return live.unionByName(v.where("key % 13 = 0").select((-F.col("key")).alias("key"), "value"))


@query("jn_identity_match", f"""WITH {VERSIONS}, {EMITTED}, h AS (SELECT key, value FROM versions WHERE sys_to IS NULL)
SELECT CASE WHEN h.key IS NULL THEN 'new' WHEN e.key IS NULL THEN 'absent' WHEN h.value IS NOT DISTINCT FROM e.value THEN 'same' ELSE 'changed' END AS status, count(*) AS n, round(sum(coalesce(e.value, h.value)), 2) AS value FROM h FULL JOIN emitted e ON h.key = e.key GROUP BY 1""")
def jn_identity_match(spark, sf_dir):
    v = versions(spark, sf_dir)
    h, e = v.where("sys_to IS NULL").select("key", F.col("value").alias("hv"), F.lit(1).alias("h")), emitted(v).select("key", F.col("value").alias("ev"), F.lit(1).alias("e"))
    met = h.join(e, "key", "full")
    status = F.when(F.col("h").isNull(), "new").when(F.col("e").isNull(), "absent").when(F.col("hv").eqNullSafe(F.col("ev")), "same").otherwise("changed")
    return met.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("ev", "hv")), 2).alias("value"))


@query("mt_generation_repair", f"""WITH {VERSIONS}, {EMITTED}, h AS (SELECT key, value, sys_from, sys_to FROM versions),
r AS (SELECT h.key, h.value, sys_from, CASE WHEN sys_to IS NOT NULL THEN sys_to WHEN e.key IS NOT NULL AND h.value IS DISTINCT FROM e.value THEN {AS_OF} END AS sys_to FROM h LEFT JOIN emitted e ON e.key = h.key
UNION ALL SELECT e.key, e.value, {AS_OF}, NULL FROM emitted e LEFT JOIN (SELECT * FROM h WHERE sys_to IS NULL) o ON o.key = e.key WHERE o.key IS NULL OR o.value IS DISTINCT FROM e.value) SELECT key, value, sys_from, sys_to FROM r""")
def mt_generation_repair(spark, sf_dir):
    v = versions(spark, sf_dir)
    return supersede(v.select("key", "value", "sys_from", "sys_to"), emitted(v), ["key"], ["value"], AS_OF)


MULTI = "a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0), an AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY k) AS rn FROM a), bn AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY k) AS rn FROM b)"


def multiset_match(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Per key, how many rows match, are only in a, only in b. Counting is the multiset join by occurrence number, and needs no order."""
    n = lambda df, c: df.groupBy(*key).agg(F.count(F.lit(1)).alias(c))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return n(a, "x").join(n(b, "y"), key, "full").select(*key, F.least(x, y).alias("matched"), F.greatest(x - y, F.lit(0)).alias("only_a"), F.greatest(y - x, F.lit(0)).alias("only_b"))


@query("jn_multiset_match", f"WITH {MULTI} SELECT coalesce(an.k, bn.k) AS k, coalesce(an.s, bn.s) AS s, count(*) FILTER (WHERE an.k IS NOT NULL AND bn.k IS NOT NULL) AS matched, count(*) FILTER (WHERE bn.k IS NULL) AS only_a, count(*) FILTER (WHERE an.k IS NULL) AS only_b FROM an FULL JOIN bn ON an.k = bn.k AND an.s = bn.s AND an.rn = bn.rn GROUP BY ALL")
def jn_multiset_match(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return multiset_match(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["k", "s"])


@query("wn_multiset_rank", "SELECT o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders")
def wn_multiset_rank(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")).cast("long").alias("rn"))


@query("mt_cut_diff", f"""WITH {VERSIONS}, {EMITTED}, h AS (SELECT key, value FROM versions WHERE sys_to IS NULL)
SELECT coalesce(h.key, e.key) AS key, CASE WHEN h.key IS NULL THEN 'arrived' WHEN e.key IS NULL THEN 'departed' ELSE 'changed' END AS verdict FROM h FULL JOIN emitted e ON h.key = e.key WHERE h.key IS NULL OR e.key IS NULL OR h.value IS DISTINCT FROM e.value""")
def mt_cut_diff(spark, sf_dir):
    v = versions(spark, sf_dir)
    h, e = v.where("sys_to IS NULL").select("key", F.struct("value").alias("hv")), emitted(v).select("key", F.struct("value").alias("ev"))
    met = h.join(e, "key", "full").where(~F.col("hv").eqNullSafe(F.col("ev")))
    return met.select("key", F.when(F.col("hv").isNull(), "arrived").when(F.col("ev").isNull(), "departed").otherwise("changed").alias("verdict"))


@query("mt_asof_proof", f"WITH {VERSIONS}, a AS (SELECT key FROM versions WHERE sys_from <= {AT} AND (sys_to IS NULL OR {AT} < sys_to)), b AS (SELECT o_orderkey AS key FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderstatus <> 'F' OR o_orderdate > TIMESTAMP '1995-12-02')) SELECT (SELECT count(*) FROM a) AS valid, (SELECT count(*) FROM a ANTI JOIN b USING (key)) AS only_table, (SELECT count(*) FROM b ANTI JOIN a USING (key)) AS only_archive")
def mt_asof_proof(spark, sf_dir):
    """Keys valid at a time against those that an archive of that day would hold: both differences are empty."""
    a = versions(spark, sf_dir).where(valid_at(AT)).select("key", F.lit(1).alias("a"))
    day = F.expr("cast(o_orderdate AS timestamp_ntz)")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    b = o.where((day <= F.expr("TIMESTAMP_NTZ'1996-01-01'")) & ((F.col("o_orderstatus") != "F") | (day > F.expr("TIMESTAMP_NTZ'1995-12-02'")))).select(F.col("o_orderkey").alias("key"), F.lit(1).alias("b"))
    return a.join(b, "key", "full").agg(F.count("a").alias("valid"), F.count_if(F.col("b").isNull()).alias("only_table"), F.count_if(F.col("a").isNull()).alias("only_archive"))


@query("mt_identity_collisions", "SELECT o_orderstatus AS dataset, count(*) AS rows, count(DISTINCT o_custkey * 100000 + CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)) AS identities, CASE WHEN count(*) - count(DISTINCT o_custkey * 100000 + CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)) <= 0.05 * count(*) THEN 'ok' ELSE 'collides' END AS verdict FROM orders GROUP BY 1")
def mt_identity_collisions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.expr("cast(cast(o_orderdate AS timestamp_ntz) AS date)"))
    got = o.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey", "d").alias("identities"))
    return got.withColumn("verdict", F.when(F.col("rows") - F.col("identities") <= 0.05 * F.col("rows"), "ok").otherwise("collides"))


@query("mt_snapshot_replay", f"""WITH {OBS}, d AS (SELECT DISTINCT place_id, CAST(t // 86400000000 AS INTEGER) AS day FROM obs), g AS (SELECT *, day - row_number() OVER (PARTITION BY place_id ORDER BY day) AS island FROM d)
SELECT place_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY place_id, island""")
def mt_snapshot_replay(spark, sf_dir):
    """Gaps and islands: the runs of days on which a place was seen."""
    d = observations(spark, sf_dir).select("place_id", F.expr(f"cast(t div {DAY} AS int)").alias("day")).distinct()
    g = d.withColumn("island", F.col("day") - F.row_number().over(Window.partitionBy("place_id").orderBy("day")))
    return g.groupBy("place_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


def wrapped(total: Column) -> Column:
    """A decimal sum as the long that has the same lowest 64 bits."""
    half, whole = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")
    return (F.pmod(total + half, whole) - half).cast("long")


@query("mt_emission_hash", "WITH h AS (SELECT o_orderstatus AS dataset, o_orderpriority AS category, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus), 1, 12))::BIGINT AS x FROM orders) SELECT dataset, category, count(*) AS rows, CAST(sum(x) AS BIGINT) AS hash FROM h GROUP BY 1, 2")
def mt_emission_hash(spark, sf_dir):
    """A fingerprint of what a dataset emits that does not depend on the rows' order: the sum of the rows' own hashes modulo 2^64 as a signed number, beside their number.

    The sum of 48-bit hashes passes 63 bits from some 65,000 rows a group on; it is taken as a decimal and wraps, so that sums of parts still add up.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.conv(F.substring(F.md5(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus")), 1, 12), 16, 10).cast("long")
    return o.groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("rows"), wrapped(F.sum(x.cast("decimal(20,0)"))).alias("hash"))
