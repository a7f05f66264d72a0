"""Readers and writers of files: JSON corpora, feeds, frozen corpora, exports, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalogue import SERVING, serving
from tidemark.plans.register import query
from tidemark.plans.steps import new_path


def json_corpus(spark: SparkSession, roots: list[str], pattern: str = "*.json*", schema: str | None = None) -> DataFrame:
    """Arrays of records in JSON files, plain or gzip, that match a pattern under the first of the declared roots that has any; a schema spares the inference pass."""
    reader = spark.read.option("multiLine", True)
    for root in roots:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return (reader.schema(schema) if schema else reader).json(f"{root}/{pattern}")
    raise FileNotFoundError(f"no files {pattern} under any of {roots}")


def rss(spark: SparkSession, path: str, item: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", item).load(path)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, to be compared with a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fetch_contract(df: DataFrame, least: int, most: int, fingerprint: str | None = None) -> dict:
    """Row count and schema fingerprint of a fetch, and its status."""
    n, seen = df.count(), "|".join(sorted(df.columns))
    status = "failed" if n < least or n > most else "drifted" if fingerprint not in (None, seen) else "ok"
    return {"rows": n, "fingerprint": seen, "status": status}


def open_collection(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """A gzip CSV folder for every tuple of `by`; returns the manifest (by, rows)."""
    df.write.partitionBy(*by).option("compression", "gzip").option("header", True).csv(path)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def geojson(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A feature a row, as JSON text, to be written with write.text."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def backup_manifest(now: DataFrame, before: DataFrame, most_lost: float = 0.05) -> DataFrame:
    """Table counts (name, n) now and before, and whether one shrank by too much."""
    b = before.withColumnRenamed("n", "was")
    return now.join(b, "name", "full").withColumn("ok", F.coalesce(F.col("n") >= (1 - most_lost) * F.col("was"), F.col("was").isNull()))


TUPLE = ["source_name", "licence", "attribution", "terms", "share_alike"]


def with_terms(df: DataFrame) -> DataFrame:
    """What goes with a licence: who must be named, under which terms, and whether copies must be shared alike."""
    lic = F.col("licence")
    return df.withColumns({"attribution": F.when(lic.isin("attribution", "share-alike"), F.concat(F.lit("by "), "source_name")).otherwise("none"), "terms": F.when(lic == "open", "free").otherwise("conditions"), "share_alike": (lic == "share-alike").cast("string")})


@query("snk_open_collection", f"WITH {SERVING}, t AS (SELECT source_name, licence, CASE WHEN licence IN ('attribution', 'share-alike') THEN 'by ' || source_name ELSE 'none' END AS attribution, CASE WHEN licence = 'open' THEN 'free' ELSE 'conditions' END AS terms, CASE WHEN licence = 'share-alike' THEN 'true' ELSE 'false' END AS share_alike, licence IN ('open', 'attribution', 'share-alike') AS free FROM serving) SELECT source_name, licence, CASE WHEN free THEN attribution END AS attribution, CASE WHEN free THEN terms END AS terms, CASE WHEN free THEN share_alike END AS share_alike, CASE WHEN free THEN 'exported' ELSE 'withheld' END AS state, count(*) AS rows, free AS checked FROM t GROUP BY ALL")
def snk_open_collection(spark, sf_dir):
    """A gzip CSV folder for every tuple of source, licence, attribution, terms and share-alike; its manifest against what the files hold; and a report of what is withheld."""
    s = serving(spark, sf_dir)
    free = F.col("licence").isin("open", "attribution", "share-alike")
    path = new_path(spark, "open")
    listed = open_collection(with_terms(s.where(free)), path, TUPLE).withColumnRenamed("rows", "listed")
    back = spark.read.option("header", True).csv(path).groupBy(*[F.col(c).cast("string").alias(c) for c in TUPLE]).agg(F.count(F.lit(1)).alias("rows"))
    exported = listed.join(back, TUPLE, "left").select(*TUPLE, F.lit("exported").alias("state"), F.coalesce("rows", F.lit(0)).alias("rows"), F.col("listed").eqNullSafe(F.col("rows")).alias("checked"))
    none = [F.lit(None).cast("string").alias(c) for c in TUPLE[2:]]
    held = s.where(~free).groupBy("source_name", "licence").agg(F.count(F.lit(1)).alias("rows")).select("source_name", "licence", *none, F.lit("withheld").alias("state"), "rows", F.lit(False).alias("checked"))
    return exported.unionByName(held)


@query("snk_append_ledgers", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def snk_append_ledgers(spark, sf_dir):
    path = new_path(spark, "ledger")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    ledger(o.where("o_orderkey % 2 = 0"), path)
    ledger(o.where("o_orderkey % 2 = 1"), path)
    return spark.read.schema("o_orderkey long, status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("src_json_corpus", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def src_json_corpus(spark, sf_dir):
    """Files that hold an array of a thousand records each, gzip, found by pattern under the second of two declared roots."""
    root = new_path(spark, "corpus")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    arrays = e.groupBy(F.floor(F.col("event_id") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct("event_type", "value"))).alias("value"))
    arrays.repartition("k").select("k", "value").write.partitionBy("k").option("compression", "gzip").text(root)
    got = json_corpus(spark, [f"{root}/nowhere", root], "k=*/*.txt.gz", "event_type string, value double")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
