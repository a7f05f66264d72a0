"""Audits and catalogue searches: integrity of versions, liveness of feeds, names worth promoting, what is where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.catalogue import PLACES, SERVING, serving, within
from tidemark.operators.places import _GAZ, fold_for_match, gazetteer, mentions
from tidemark.plans.register import query
from tidemark.sources.analogues import DAY, OBS, SERIES, VERSIONS, observations, series, table, versions


def integrity(v: DataFrame, key: list[str]) -> DataFrame:
    """Rows (rule, violations) of a versioned table (key, sys_from, sys_to): validity is half-open and not empty, versions of a key do not
    overlap, at most one is current, and nothing is current behind a later version."""
    w = Window.partitionBy(*key).orderBy("sys_from", F.col("sys_to").asc_nulls_last())
    d = v.withColumn("next", F.lead("sys_from").over(w)).withColumn("current", F.col("sys_to").isNull().cast("int"))
    bad = {
        "empty validity": F.col("sys_to") <= F.col("sys_from"), "overlap": F.col("next").isNotNull() & F.col("sys_to").isNotNull() & (F.col("sys_to") > F.col("next")),
        "open behind a later version": F.col("sys_to").isNull() & F.col("next").isNotNull(), "no start": F.col("sys_from").isNull(),
    }
    one = d.groupBy(*key).agg(F.sum("current").alias("c"), *[F.count_if(t).alias(n) for n, t in bad.items()])
    got = one.agg(F.count_if(F.col("c") > 1).alias("several current"), *[F.coalesce(F.sum(F.col(f"`{n}`")), F.lit(0)).alias(n) for n in bad])
    return got.unpivot([], ["several current", *bad], "rule", "violations")


_VIOL = "v AS (SELECT owner % 200 AS key, sys_from, sys_to FROM versions), d AS (SELECT *, lead(sys_from) OVER (PARTITION BY key ORDER BY sys_from, sys_to NULLS LAST) AS next FROM v)"


@query("integrity_checks", f"WITH {VERSIONS}, {_VIOL} SELECT 'empty validity' AS rule, count(*) FILTER (WHERE sys_to <= sys_from) AS violations FROM d UNION ALL SELECT 'overlap', count(*) FILTER (WHERE sys_to > next) FROM d UNION ALL SELECT 'open behind a later version', count(*) FILTER (WHERE sys_to IS NULL AND next IS NOT NULL) FROM d UNION ALL SELECT 'no start', count(*) FILTER (WHERE sys_from IS NULL) FROM d UNION ALL SELECT 'several current', count(*) FROM (SELECT key FROM v WHERE sys_to IS NULL GROUP BY 1 HAVING count(*) > 1)")
def integrity_checks(spark, sf_dir):
    """The rules on a key that the table does not keep unique, so that there is something to find."""
    return integrity(versions(spark, sf_dir).select((F.col("owner") % 200).alias("key"), "sys_from", "sys_to"), ["key"])


_LIVE = "d AS (SELECT source_id, t // {0} AS day, count(*) AS n, CAST(sum(('0x' || substr(md5(CAST(place_id AS VARCHAR) || '|' || direction || '|' || value), 1, 12))::BIGINT) AS BIGINT) AS h FROM obs GROUP BY 1, 2)".format(DAY)


@query("mt_liveness", f"WITH {OBS}, {_LIVE}, l AS (SELECT *, lag(h) OVER (PARTITION BY source_id ORDER BY day) AS before, lag(day) OVER (PARTITION BY source_id ORDER BY day) AS last FROM d) SELECT source_id, count(*) AS days, count(*) FILTER (WHERE h = before) AS frozen, count(*) FILTER (WHERE day - last > 1) AS gaps, max(n) AS most FROM l GROUP BY 1")
def mt_liveness(spark, sf_dir):
    """Days on which a source gave just what it gave the day before, whatever its ids and times: content hashes without the fields that always change."""
    x = F.conv(F.substring(F.md5(F.concat_ws("|", "place_id", "direction", "value")), 1, 12), 16, 10).cast("long")
    d = observations(spark, sf_dir).groupBy("source_id", F.expr(f"t div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("h"))
    w = Window.partitionBy("source_id").orderBy("day")
    d = d.withColumns({"before": F.lag("h").over(w), "last": F.lag("day").over(w)})
    return d.groupBy("source_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("h") == F.col("before")).alias("frozen"), F.count_if(F.col("day") - F.col("last") > 1).alias("gaps"), F.max("n").alias("most"))


@query("mt_promote_localities", f"""WITH {PLACES}, {_GAZ}, me AS (SELECT user_id AS place, substr(name, 1, 3) || substr(name, 5) AS key FROM events JOIN gz ON user_id = place WHERE event_id % 5 = 3), k AS (SELECT key, count(*) AS n, min(place) AS at_ FROM me WHERE key NOT IN (SELECT name FROM gz) GROUP BY 1 HAVING count(*) >= 3),
a AS (SELECT k.*, lat, lon FROM k JOIN pl ON pl.id = at_), m AS (SELECT key, n, at_, su.id, 111195.0 * sqrt(pow(a.lat - su.lat, 2) + pow((a.lon - su.lon) * cos(radians(31.5)), 2)) AS m FROM a, su) SELECT key, n, (SELECT arg_min(id, (round(m, 3), id)) FROM m WHERE m.key = k.key AND m.m <= 1500) AS neighbour FROM k""")
def mt_promote_localities(spark, sf_dir):
    """Names that three reports or more use and no place has, with the known place within 1,500 m of where they are used, if there is one."""
    from tidemark.operators.catalogue import places

    used = mentions(spark, sf_dir).where("form = 3").select(fold_for_match(F.col("text")).alias("key"), "place")
    owed = used.join(gazetteer(spark, sf_dir).select(F.col("name").alias("key")), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at")).where("n >= 3")
    where = owed.join(places(spark, sf_dir, "customer", "c_custkey", 37, 91).withColumnRenamed("id", "at"), "at")
    near = within(where.select(F.col("at").alias("id"), "lat", "lon"), places(spark, sf_dir, "supplier", "s_suppkey", 53, 17), 1500.0)
    best = near.groupBy(F.col("a_id").alias("at")).agg(F.min_by("b_id", F.struct(F.round("m", 3), "b_id")).alias("neighbour"))
    return owed.join(best, "at", "left").select("key", "n", "neighbour")


@query("sr_indicator_search", f"WITH {SERIES}, i AS (SELECT indicator, count(*) AS points, count(DISTINCT place_id) AS places, min(mon) AS first, max(mon) AS last FROM series GROUP BY 1), q(term) AS (VALUES ('urgent'), ('high'), ('low specified'), ('specified not')) SELECT term, indicator, points, places, first, last FROM q, i WHERE len(list_filter(string_split(term, ' '), lambda x: NOT contains(lower(indicator), x))) = 0")
def sr_indicator_search(spark, sf_dir):
    """Measures whose names hold all words of a term, for a few terms at once, with span and reach."""
    i = series(spark, sf_dir).groupBy("indicator").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("place_id").alias("places"), F.min("mon").alias("first"), F.max("mon").alias("last"))
    terms = ["urgent", "high", "low specified", "specified not"]
    return search(i, terms)


def search(i: DataFrame, terms: list[str]) -> DataFrame:
    q = F.explode(F.array(*map(F.lit, terms)))
    return i.withColumn("term", q).where(F.forall(F.split("term", " "), lambda w: F.contains(F.lower("indicator"), w))).select("term", *i.columns)


@query("sr_where", f"WITH {SERIES} SELECT indicator, place_id, count(*) AS points, min(mon) AS first, max(mon) AS last, round(max_by(value, mon), 2) AS newest FROM series GROUP BY 1, 2")
def sr_where(spark, sf_dir):
    """Where each measure is known, since when, and its newest value."""
    return series(spark, sf_dir).groupBy("indicator", "place_id").agg(F.count(F.lit(1)).alias("points"), F.min("mon").alias("first"), F.max("mon").alias("last"), F.round(F.max_by("value", "mon"), 2).alias("newest"))


@query("sr_categories", f"WITH {SERVING} SELECT category, count(*) AS rows, count(DISTINCT dataset) AS datasets, count(DISTINCT source) AS sources, count(*) FILTER (WHERE licence IN ('open', 'attribution')) AS open FROM serving GROUP BY 1")
def sr_categories(spark, sf_dir):
    return serving(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dataset").alias("datasets"), F.count_distinct("source").alias("sources"), F.count_if(F.col("licence").isin("open", "attribution")).alias("open"))


_WORDS = "w AS (SELECT source, lower(word) AS word FROM (SELECT source, unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents) WHERE length(word) >= 4)"


@query("ag_unmet_words", f"WITH {_WORDS}, c AS (SELECT word, count(*) AS n, count(DISTINCT source) AS sources FROM w GROUP BY 1), known AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(string_split_regex(text, '[^\\p{{L}}]+')) AS word FROM conversations)) SELECT word, n, sources FROM c WHERE n >= 20 AND word NOT IN (SELECT word FROM known)")
def ag_unmet_words(spark, sf_dir):
    """Words that documents use twenty times or more and no conversation has: what nobody has asked about."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).select(*keep, F.lower("word").alias("word"))
    c = words(table(spark, sf_dir, "documents"), "source").where("length(word) >= 4").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources")).where("n >= 20")
    return c.join(words(table(spark, sf_dir, "conversations")).distinct(), "word", "left_anti").select("word", "n", "sources")
