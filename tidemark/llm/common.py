"""What the operators of this package share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without belongs to the cluster's default file system, as Spark's own writers take it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if re.match("file:/(?!/)", full) else full


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with its scheme. In a local session (tests) it may be unset; then an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: What a written table's job runs with. Its shuffle files are of no use once it is written, and go. Rows reach Python in batches
#: of at most so many bytes: a batch is held by the JVM, the worker and its copies at once, in every core of an executor.
JOB = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def write_table(df: DataFrame, path: str) -> None:
    """Writes df as Parquet, under the settings JOB."""
    spark = df.sparkSession
    before = {key: spark.conf.get(key) for key in JOB}
    for key, value in JOB.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, tag)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key that holds more than one in HOT of all rows is hot; there are fewer than HOT of them, whatever the input.
HOT = 1000


def meet(rows: DataFrame, table: DataFrame, on: list[str], count: str, spread: list[str], total: int | None = None) -> DataFrame:
    """The rows that have a partner in table, which holds a key once, how many rows have it (`count`) and what to attach.

    Hot keys are at most HOT rows of the table and are broadcast; their rows are then dealt by
    `spread` instead of the key, so that no task gets more than its share of them.
    """
    total = table.agg(F.sum(count)).first()[0] if total is None else total
    attached = [c for c in table.columns if c not in (*on, count)]
    hot = F.col(count) * HOT > F.lit(total or 0)
    named = lambda which, tag: table.where(which).select(*[F.col(c).alias(f"_{tag}{c}") for c in (*on, *attached)], F.lit(True).alias(f"_{tag}"))
    few, rest = named(hot, "h"), named(~hot, "r")
    df = rows.join(F.broadcast(few), [F.col(c) == F.col(f"_h{c}") for c in on], "left")
    keys = [F.when(F.col("_h"), F.xxhash64(F.lit(c), *spread) if k == 0 else F.lit(None)).otherwise(F.col(c)).alias(f"_k{c}") for k, c in enumerate(on)]
    df = df.select("*", *keys).join(rest.hint("merge"), [F.col(f"_k{c}") == F.col(f"_r{c}") for c in on], "left").where("_h OR _r")
    return df.select(*rows.columns, *[F.when(F.col("_h"), F.col(f"_h{c}")).otherwise(F.col(f"_r{c}")).alias(c) for c in attached])


def words(text: Column) -> Column:
    """`[^\\x20\\x09-\\x0D]+` of a text in order; null gives no words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
