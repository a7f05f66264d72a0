"""Feeds in and files out: contracts, frozen corpora, CSV and XML answers, cursors, slices, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalogue import PLACES, places
from tidemark.plans.register import query
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import AS_OF, DAY, HOUR, OBS, observations, table
from tidemark.sources.files import frozen, geojson, rss

# ---- what a fetch must look like


def contracts(df: DataFrame, key: str, least: int, most: int, fingerprint: str | None, before: DataFrame) -> DataFrame:
    """A row a feed: rows, and failed, drifted, skipped, unchanged or ok. before: (key, digest), what each feed gave last time.

    Too few or too many rows fail; other columns than agreed are drift; a feed that gives nothing is
    skipped; the same rows as last time, whatever their order, are no news.
    """
    columns = sorted(c for c in df.columns if c != key)
    seen = "|".join(columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).cast("decimal(38,0)")
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest"))
    g = before.select(key, F.col("digest").alias("old")).join(g, key, "full")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "skipped").when((n < least) | (n > most), "failed").when(F.lit(fingerprint is not None and fingerprint != seen), "drifted").when(F.col("digest") == F.col("old"), "unchanged").otherwise("ok")
    return g.select(key, n.alias("n"), status.alias("status"))


@query("src_fetch_contract", "WITH n AS (SELECT source, count(*) AS n, bool_or(doc_id % 97 = 5) AS changed FROM documents GROUP BY 1) SELECT source, n, CASE WHEN n < 10 THEN 'failed' WHEN changed THEN 'ok' ELSE 'unchanged' END AS status FROM n UNION ALL SELECT 'gone', 0, 'skipped'")
def src_fetch_contract(spark, sf_dir):
    """Sources as feeds; those with an id in one class of 97 have changed since the last fetch, and one feed gives nothing any more."""
    now = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    was = now.withColumn("lang", F.when(F.col("doc_id") % 97 == 5, "xx").otherwise(F.col("lang")))
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "lang")]).cast("decimal(38,0)")
    before = was.groupBy("source").agg(F.sum(row).alias("digest")).unionByName(spark.range(1).select(F.lit("gone").alias("source"), F.lit(0).cast("decimal(38,0)").alias("digest")))
    return contracts(now, "source", 10, 10**9, "doc_id|lang", before)


@query("src_frozen_manifest", "SELECT o_orderstatus AS status, count(*) AS records, true AS ok FROM orders GROUP BY 1")
def src_frozen_manifest(spark, sf_dir):
    """A corpus is frozen with a manifest of its files' digests and record counts; reading it again checks both."""
    path = new_path(spark, "frozen")
    table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice").write.partitionBy("status").json(path)
    manifest_path = new_path(spark, "manifest")
    manifest(spark, path).write.json(manifest_path)
    return checked(spark, path, spark.read.schema("path string, sha256 string, records long").json(manifest_path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = frozen(spark, f"{path}/*/*.json").select("path", "sha256")
    records = spark.read.text(f"{path}/*/*.json").groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("records"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.withColumn("path", plain("path")).join(records.withColumn("path", plain("path")), "path")


def checked(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records by partition, and whether every file still has the digest and the count of the manifest."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("sha"), F.col("records").alias("n"))
    j = wanted.join(now, "path", "full")
    same = (F.col("sha256").eqNullSafe(F.col("sha")) & F.col("records").eqNullSafe(F.col("n")))
    return j.groupBy(F.regexp_extract("path", "status=([^/]*)", 1).alias("status")).agg(F.sum("n").alias("records"), F.bool_and(same).alias("ok"))


@query("src_csv_api", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value, count(*) FILTER (WHERE value > 100) AS high FROM events GROUP BY 1")
def src_csv_api(spark, sf_dir):
    """An answer as CSV with a header and a declared schema; lines that do not fit it are counted, not guessed."""
    path = new_path(spark, "csv")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    got = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema("event_id long, event_type string, value double, _bad string").csv(path)
    return got.where("_bad IS NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"), F.count_if(F.col("value") > 100).alias("high"))


@query("src_rss", "SELECT page_id AS id, 'https://example.org/' || page_id AS link, 'Page ' || page_id AS title FROM pages")
def src_rss(spark, sf_dir):
    """A feed of items as XML, written and read by Spark's XML source."""
    path, k = new_path(spark, "rss"), F.col("page_id").cast("string")
    items = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://example.org/"), k).alias("link"), F.concat(F.lit("Page "), k).alias("title"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    got = rss(spark, path)
    return got.select(F.regexp_extract("link", "([0-9]+)$", 1).cast("long").alias("id"), "link", "title")


@query("src_sqlite_cursor", f"WITH {OBS}, s AS (SELECT obs_id FROM obs WHERE t <= {AS_OF - 5 * DAY} AND obs_id % 10 <> 0) SELECT t // {DAY} AS day, count(*) AS n FROM obs WHERE t > {AS_OF - 5 * DAY - 12 * HOUR} AND obs_id NOT IN (SELECT obs_id FROM s) GROUP BY 1")
def src_sqlite_cursor(spark, sf_dir):
    """A foreign table read from twelve hours before the cursor, so that late rows come too; rows already held are skipped by identity."""
    o, cursor = observations(spark, sf_dir), AS_OF - 5 * DAY
    held = o.where((F.col("t") <= cursor) & (F.col("obs_id") % 10 != 0)).select("obs_id")
    return overlap(o, held, cursor, 12 * HOUR, ["obs_id"]).groupBy(F.expr(f"t div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def overlap(foreign: DataFrame, held: DataFrame, cursor: int, back: int, identity: list[str]) -> DataFrame:
    return foreign.where(F.col("t") > cursor - back).join(held, identity, "left_anti")


@query("src_ocha", "WITH n AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT 'status' AS slice, count(*) AS total FROM n UNION ALL SELECT 'priority', count(*) FILTER (WHERE k % 500 <> 1) FROM n UNION ALL SELECT 'segment', count(*) FILTER (WHERE k % 50 <> 1) FROM n) SELECT slice, total, abs(total - (SELECT total FROM s WHERE slice = 'status')) <= 0.005 * (SELECT total FROM s WHERE slice = 'status') AS agrees FROM s")
def src_ocha(spark, sf_dir):
    """The same total by three slices; a slice that is off by more than half a percent does not agree."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    cut = lambda name, col, keep: o.where(keep).groupBy(F.lit(name).alias("slice"), F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    slices = cut("status", "o_orderstatus", F.lit(True)).unionByName(cut("priority", "o_orderpriority", k % 500 != 1)).unionByName(cut("segment", "c_mktsegment", k % 50 != 1))
    return reconciled(slices, "status", 0.005)


def reconciled(slices: DataFrame, main: str, tolerance: float) -> DataFrame:
    """slices (slice, label, n): each slice's total, and whether it agrees with the main one's."""
    t = slices.groupBy("slice").agg(F.sum("n").alias("total"))
    base = t.where(F.col("slice") == main).select(F.col("total").alias("base"))
    return t.crossJoin(F.broadcast(base)).select("slice", "total", (F.abs(F.col("total") - F.col("base")) <= tolerance * F.col("base")).alias("agrees"))  # base is one row


@query("snk_csv_geojson", f"WITH {PLACES} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, 'Point' AS kind FROM pl")
def snk_csv_geojson(spark, sf_dir):
    """Features as JSON lines and the same rows as CSV, read back and joined: both exports say the same."""
    p, at = places(spark, sf_dir, "customer", "c_custkey", 37, 91), new_path(spark, "export")
    geojson(p).write.text(f"{at}/geojson")
    p.write.option("header", True).csv(f"{at}/csv")
    f = spark.read.schema("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:bigint>").json(f"{at}/geojson")
    c = spark.read.option("header", True).schema("id long, lat double, lon double").csv(f"{at}/csv")
    j = f.select(F.col("properties.id").alias("id"), "geometry").join(c, "id")
    x = F.col("geometry.coordinates")
    return j.where((F.get(x, F.lit(0)) == F.col("lon")) & (F.get(x, F.lit(1)) == F.col("lat"))).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("geometry.type").alias("kind"))


# ---- pages as articles


def article(html: Column) -> tuple[Column, Column]:
    """Title and text of a page: scripts, styles, navigation, asides and comments go, then paragraphs and list items are kept, without tags and entities."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|aside|footer)\b.*?</\1>|<!--.*?-->", " ")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>"), 1)
    plain = lambda x: F.btrim(F.regexp_replace(F.replace(F.replace(F.replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), r"\s+", " "))
    return plain(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.array_join(F.filter(F.transform(parts, plain), lambda x: x != ""), "\n")


_PLAIN = "trim(regexp_replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'), ' ')"


@query("src_html_text", f"WITH b AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<aside\\b.*?</aside>|<footer\\b.*?</footer>|<!--.*?-->', ' ', 'g') AS body FROM pages), p AS (SELECT page_id, html, regexp_extract_all(body, '(?is)<(?:p|li)\\b[^>]*>(.*?)</(?:p|li)>', 1) AS parts FROM b) SELECT page_id, {_PLAIN.format(chr(39).join(['regexp_extract(html, ', '(?is)<title>(.*?)</title>', ', 1)']))} AS title, md5(array_to_string(list_filter([{_PLAIN.format('x')} FOR x IN parts], lambda x: x <> ''), chr(10))) AS text_md5 FROM p")
def src_html_text(spark, sf_dir):
    """The title of every page and a digest of its whole text."""
    title, text = article(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.md5(text).alias("text_md5"))
