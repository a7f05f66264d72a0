"""Queries of loads: orders as emitted rows, loaded twice, and a third time against the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.load import Contract, Rule, Table, load
from tidemark.plans.register import query
from tidemark.plans.spec import Refused
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import table

CONTRACT = Contract({"F": Rule(complete=True, max_absent=10**12, collisions=10**12), "O": Rule(collisions=10**12), "P": Rule(indistinguishable=True)}, min_records=1, drops=("low",))
FIRST, SECOND = 1000, 2000


def emitted(orders: DataFrame, run: int) -> DataFrame:
    """The first run lacks some orders; the second lacks others, revises some, and gives some twice, half of them with another value."""
    k = F.col("o_orderkey")
    rows = orders.where(k % 10 != 3).withColumn("again", F.lit(0)) if run == 1 else orders.where(k % 13 != 0).withColumn("again", F.explode(F.when(k % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    value = cents if run == 1 else cents + (k % 7 == 0).cast("long") + ((F.col("again") == 1) & (k % 2 == 0)).cast("long")
    keyless = F.col("o_orderstatus") == "P"
    return rows.select(
        F.col("o_orderstatus").alias("dataset"), F.concat_ws(":", k, F.when(F.col("again") == 1, F.lit("b"))).alias("stable_id"), F.when(~keyless, k.cast("string")).alias("identity"), value.cast("string").alias("content"),
        (2 * k + F.col("again")).alias("seq"), (k % 5 != 0).alias("located"), F.when((F.col("o_orderpriority") == "5-LOW") & (k % 3 == 0), "low").alias("drop"), value.alias("value"),
    )


def loaded(spark, sf_dir) -> tuple[Table, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    t = Table(spark, new_path(spark, "loads"), emitted(orders, 1).schema)
    load(t, emitted(orders, 1), CONTRACT, FIRST)
    return t, load(t, emitted(orders, 2), CONTRACT, SECOND)


_E = """o AS (SELECT *, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 AS low FROM orders),
a AS (SELECT o_orderstatus AS dataset, k, cents AS value, low FROM o WHERE k % 10 <> 3),
b AS (SELECT o_orderstatus AS dataset, k, x.again, cents + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN x.again = 1 AND k % 2 = 0 THEN 1 ELSE 0 END AS value, low FROM o, (VALUES (0), (1)) AS x(again) WHERE k % 13 <> 0 AND (x.again = 0 OR k % 17 = 0)),
c AS (SELECT b.dataset, b.k, b.again, b.value, a.value AS had, CASE WHEN b.low THEN 'drop:low' WHEN b.dataset = 'P' THEN CASE WHEN a.k IS NOT NULL AND b.again = 0 THEN 'refetched' ELSE 'kept_copy' END
  WHEN b.again = 1 THEN CASE WHEN k % 2 = 0 THEN 'conflict_in_run' ELSE 'duplicate_in_run' END WHEN a.k IS NULL THEN 'new' WHEN a.value = b.value THEN 'held_same' ELSE 'correction' END AS class FROM b LEFT JOIN (SELECT * FROM a WHERE NOT low) a USING (dataset, k)),
gone AS (SELECT a.* FROM a WHERE NOT low AND dataset = 'F' AND k % 13 = 0)"""


@query("etl_load_classes", f"WITH {_E} SELECT dataset, class, count(*) AS n FROM (SELECT dataset, class FROM c UNION ALL SELECT dataset, 'absent_closed' FROM gone) GROUP BY ALL")
def etl_load_classes(spark, sf_dir):
    """The report of a second load: what it found of each dataset."""
    return loaded(spark, sf_dir)[1]


@query("etl_load_table", f"""WITH {_E}, t AS (SELECT a.dataset, a.value, CAST({FIRST} AS BIGINT) AS sys_from, CAST(CASE WHEN c.class = 'correction' OR gone.k IS NOT NULL THEN {SECOND} END AS BIGINT) AS sys_to FROM a LEFT JOIN (SELECT * FROM c WHERE class = 'correction') c USING (dataset, k) LEFT JOIN gone USING (dataset, k) WHERE NOT a.low
UNION ALL SELECT dataset, value, {SECOND}, NULL FROM c WHERE class IN ('new', 'kept_copy', 'correction')) SELECT dataset, sys_from, sys_to, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM t GROUP BY ALL""")
def etl_load_table(spark, sf_dir):
    """Open and closed rows after two loads."""
    t, _ = loaded(spark, sf_dir)
    both = t.rows("open").unionByName(t.rows("closed"))
    return both.groupBy("dataset", "sys_from", "sys_to").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("etl_load_refused", f"WITH {_E} SELECT 2 AS version, 3 AS problems, (SELECT count(*) FROM a WHERE NOT low) - (SELECT count(*) FROM gone) + (SELECT count(*) FROM c WHERE class IN ('new', 'kept_copy')) AS n")
def etl_load_refused(spark, sf_dir):
    """A third load breaks its contract in three ways; readers stay on the second version."""
    t, _ = loaded(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    strict = Contract({**CONTRACT.rules, "F": Rule(complete=True, collisions=10**12, max_absent=0), "O": Rule(collisions=10**12, located=0.99)}, drops=())
    found = 0
    try:
        load(t, emitted(orders, 2).where("dataset != 'F' OR cast(identity AS long) % 4 != 0"), strict, 3000)
    except Refused as e:
        found = len(str(e).split("; "))
    return t.rows("open").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.version()).alias("version"), F.lit(found).alias("problems"), "n")
