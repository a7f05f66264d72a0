"""Readers with durable cursors: each organ reads claims once, in the order of their arrival, and only what has settled.

A cursor is the (time, id) of the last claim that a run saw, whether the organ wanted it or not, so that a
filter never holds it back. It is written after the run's rows are; a run that is cut short is run
again with the same number and the same claims or more, and its rows are written over. A cursor
never goes backwards. Rows younger than the settle delay wait: a claim may arrive a little after
one with a later time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import AS_OF, DAY, MINUTE, OBS, observations

CURSORS = "organ string, run int, seen long, matched long, t long, id long"


class Organ:
    def __init__(self, spark: SparkSession, path: str, name: str, wanted: Column, settle: int):
        self.spark, self.path, self.name, self.wanted, self.settle = spark, path.rstrip("/"), name, wanted, settle

    def _runs(self) -> list[int]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        root = fs.Path(f"{self.path}/cursors/{self.name}")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [int(x.getPath().getName()) for x in store.listStatus(root) if store.exists(fs.Path(x.getPath(), "_SUCCESS"))] if store.exists(root) else []

    def cursor(self) -> tuple[int, int | None, int | None]:
        """Number of the last run that ended, and the last claim it saw."""
        run = max(self._runs(), default=0)
        if not run:
            return 0, None, None
        r = self.spark.read.schema(CURSORS).parquet(f"{self.path}/cursors/{self.name}/{run}").first()
        return run, r.t, r.id

    def advance(self, claims: DataFrame, now: int) -> bool:
        """claims: (t, id, ...). Reads what is settled and new, writes the wanted rows and then the cursor; whether there was anything."""
        run, t, ident = self.cursor()
        new = claims.where(F.col("t") < now - self.settle)
        if t is not None:
            new = new.where((F.col("t") > t) | ((F.col("t") == t) & (F.col("id") > ident)))
        got = new.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.coalesce(self.wanted, F.lit(False))).alias("matched"), F.max(F.struct("t", "id")).alias("last")).first()
        if not got.seen:
            return False
        upto = F.struct("t", "id") <= F.struct(F.lit(got.last.t).cast("long").alias("t"), F.lit(got.last.id).cast("long").alias("id"))  # what arrives meanwhile is the next run's
        new.where(self.wanted & upto).write.mode("overwrite").parquet(f"{self.path}/rows/{self.name}/run={run + 1}")
        row = self.spark.createDataFrame([(self.name, run + 1, got.seen, got.matched, got.last.t, got.last.id)], CURSORS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cursors/{self.name}/{run + 1}")
        return True

    def history(self) -> DataFrame:
        return self.spark.read.schema(CURSORS).parquet(*[f"{self.path}/cursors/{self.name}/{n}" for n in self._runs()])

    def rows(self) -> DataFrame:
        """The wanted rows of all runs that ended."""
        return self.spark.read.option("basePath", f"{self.path}/rows/{self.name}").parquet(*[f"{self.path}/rows/{self.name}/run={n}" for n in self._runs()])


SETTLE = 10 * MINUTE
NOWS = [AS_OF - 20 * DAY, AS_OF - 20 * DAY, AS_OF - 11 * DAY, AS_OF]
_BOUNDS = sorted({n - SETTLE for n in NOWS})
_RUNS = ", ".join(f"({k + 1}, {a}, {b})" for k, (a, b) in enumerate(zip([-1, *_BOUNDS], _BOUNDS)))


@query("st_reader_cursors", f"WITH {OBS}, r(run, a, b) AS (VALUES {_RUNS}), g(organ) AS (VALUES ('all'), ('closures')) SELECT organ, CAST(run AS INTEGER) AS run, count(*) AS seen, count(*) FILTER (WHERE organ = 'all' OR value = 'closed') AS matched, max(t) AS t, arg_max(obs_id, (t, obs_id)) AS id FROM obs JOIN r ON t >= a AND t < b, g GROUP BY ALL")
def st_reader_cursors(spark, sf_dir):
    """Two organs over the same claims, run four times, once in vain."""
    claims = observations(spark, sf_dir).select("t", F.col("obs_id").alias("id"), "value")
    path, out = new_path(spark, "readers"), None
    for name, wanted in (("all", F.lit(True)), ("closures", F.col("value") == "closed")):
        organ = Organ(spark, path, name, wanted, SETTLE)
        for now in NOWS:
            organ.advance(claims, now)
        out = organ.history() if out is None else out.unionByName(organ.history())
    return out
