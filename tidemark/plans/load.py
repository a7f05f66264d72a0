"""A load as one transaction: rows are classed against what is held, checked, and become visible all at once or not at all.

A table is a folder of loads and of manifests. A manifest says, for each dataset, which loads hold
its open rows, and which loads hold closed ones; the newest manifest is the table, and it appears by
one rename after everything it names is written. A load that closes rows of a dataset writes that
dataset's open rows anew, another only adds to it; closed rows are never written again. One writer
at a time holds the table's lock.

Emitted rows: dataset, stable_id, identity (null: the dataset keeps no key), content (what the row
says), seq (the order of the input), located, drop (a reason, or null) and any others. Rows whose
stable id or seq is null are refused as a whole load.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import Refused
from tidemark.plans.steps import dropped, written

KEY = ["dataset", "identity"]
OPENS = ["new", "kept_copy", "correction"]
ALONE = ["absent", "held"]  # held rows of which nothing is emitted


@dataclass(frozen=True)
class Rule:
    """What a dataset may do. complete: the input is all that its source says now, so that held rows it lacks are closed, up to max_absent of them (null: a twentieth)."""

    indistinguishable: bool = False
    collisions: int = 0
    complete: bool = False
    max_absent: int | None = None
    located: float = 0.0


@dataclass(frozen=True)
class Contract:
    rules: dict[str, Rule]
    min_records: int = 0
    max_rows: int | None = None
    located: float = 0.0
    drops: tuple[str, ...] = field(default=())


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        """schema: of the emitted rows; the table has sys_from and sys_to, in microseconds, besides, and no drop."""
        self.spark, self.path = spark, path.rstrip("/")
        kept = [f for f in schema.fields if f.name != "drop"]
        self.schema = T.StructType([*kept, T.StructField("sys_from", T.LongType()), T.StructField("sys_to", T.LongType())])
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._at(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    @contextmanager
    def locked(self) -> Iterator[None]:
        self._fs.mkdirs(self._at("manifests"))
        try:
            self._put("lock", "", False)
        except Exception as e:
            if self._fs.exists(self._at("lock")):
                raise Refused(f"another load holds {self.path}/lock") from e
            raise
        try:
            yield
        finally:
            self._fs.delete(self._at("lock"), False)

    def version(self) -> int:
        """The newest manifest's number; 0 before the first load."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"open": {}, "closed": []}
        text = self.spark.read.text(f"{self.path}/manifests/{version}", wholetext=True).first()
        return json.loads(text[0])

    def commit(self, manifest: dict, version: int) -> None:
        self._put(f"manifests/.{version}", json.dumps(manifest), True)
        if self._fs.exists(self._at(f"manifests/{version}")) or not self._fs.rename(self._at(f"manifests/.{version}"), self._at(f"manifests/{version}")):
            raise Refused(f"version {version} is there already")

    def _read(self, load: int, part: str, datasets: list[str] | None = None) -> DataFrame:
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/load-{load}/{part}").select(self.schema.names)
        return df if datasets is None else df.where(F.col("dataset").isin(datasets))

    def rows(self, part: str, version: int | None = None) -> DataFrame:
        """Open or closed rows of a version."""
        m = self.manifest(version)
        if part == "closed":
            parts = [self._read(n, "closed") for n in m["closed"]]
        else:
            loads = sorted({n for x in m["open"].values() for n in x})
            parts = [self._read(n, "open", [d for d, x in m["open"].items() if n in x]) for n in loads]
        out = self.spark.createDataFrame([], self.schema)
        for p in parts:
            out = out.unionByName(p)
        return out

    def as_of(self, t: int) -> DataFrame:
        both = self.rows("open").unionByName(self.rows("closed"))
        return both.where((F.col("sys_from") <= t) & (F.col("sys_to").isNull() | (t < F.col("sys_to"))))


def classed(emitted: DataFrame, held: DataFrame, contract: Contract, fallback: bool) -> DataFrame:
    """Emitted rows without drops, one a stable id, with `class`, and held keyed rows.

    An identity's first row stands for it: it is new, the same as held, a correction, or refused as it comes from a
    fallback; what follows in the same run is a duplicate or a conflict. Rows without identity are held by stable id only.
    A held row is `had` of its identity's first row; where nothing of its identity is emitted, it is a row of its own,
    absent if its dataset is complete and else held. So each side is shuffled once by stable id and once by identity.
    """
    # what tells most rows apart leads the sorts; only the first rows of a key are shuffled
    by_id = ["stable_id", "dataset"]
    one = emitted.where("drop IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*by_id).orderBy("seq"))).where("_n = 1").drop("_n")
    ids = held.select(*by_id).distinct().withColumn("id_held", F.lit(True))
    # rows without identity are keys of their own: they meet nothing and do not gather in one task
    own = one.join(ids, by_id, "left").withColumns({"_key": F.coalesce("identity", "stable_id"), "_keyed": F.col("identity").isNotNull()})
    at = ["_key", "dataset", "_keyed"]
    upto = Window.partitionBy(*at).orderBy("seq", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = own.withColumns({"first": F.first(F.struct("seq", "content")).over(upto), "_n": F.row_number().over(upto)})
    had = held.where("identity IS NOT NULL").select(F.col("identity").alias("_key"), "dataset", F.col("identity").isNotNull().alias("_keyed"), F.struct(*held.columns).alias("had"))
    df = run.join(had, at, "full")
    loose, complete = ([d for d, r in contract.rules.items() if getattr(r, x)] for x in ("indistinguishable", "complete"))
    same = F.col("content").eqNullSafe(F.col("had.content"))
    later = F.col("seq") != F.col("first.seq")
    kind = (
        F.when(F.col("_n").isNull(), F.when(F.col("dataset").isin([] if fallback else complete), "absent").otherwise("held"))
        .when(F.col("identity").isNull(), F.when(F.col("id_held"), "refetched").when(F.col("dataset").isin(loose), "kept_copy").otherwise("new"))
        .when(later, F.when(F.col("content").eqNullSafe(F.col("first.content")), "duplicate_in_run").otherwise("conflict_in_run"))
        .when(F.col("had").isNull(), F.when(F.col("id_held"), "stable_id_disagrees").otherwise("new"))
        .when(same, "held_same").otherwise("fallback_refused" if fallback else "correction")
    )
    values = [F.coalesce("identity", "had.identity").alias(c) if c == "identity" else F.col(c) for c in emitted.columns]
    return df.select(*values, kind.alias("class"), F.when(F.coalesce("_n", F.lit(1)) == 1, F.col("had")).alias("had"))


def problems(emitted: DataFrame, rows: DataFrame, held: DataFrame, gone: DataFrame, contract: Contract) -> list[str]:
    """Everything that a load breaks, from four small aggregates."""
    out = []
    of = lambda df: {r.dataset: r for r in df.collect()}  # noqa: E731  a row a dataset
    got = emitted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stable_id").isNull() | F.col("seq").isNull()).alias("bad")).first()
    if got.bad:
        out.append(f"{got.bad} rows without stable id or order")
    if got.n < contract.min_records:
        out.append(f"{got.n} records, {contract.min_records} are the least")
    reasons = emitted.where(F.col("drop").isNotNull() & ~F.col("drop").isin(list(contract.drops))).groupBy("drop").count().limit(20).collect()
    out += [f"{r['count']} drops for a reason that is not declared: {r['drop']}" for r in sorted(reasons)]
    sums = of(rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("located").alias("located"), F.count_if(F.col("class").isin("duplicate_in_run", "conflict_in_run")).alias("collisions"), F.count_if(F.col("class") == "stable_id_disagrees").alias("disagree")))
    n, located = sum(r.n for r in sums.values()), sum(r.located for r in sums.values())
    if contract.max_rows is not None and n > contract.max_rows:
        out.append(f"{n} rows, {contract.max_rows} are the most")
    if located < contract.located * n:
        out.append(f"{located} of {n} rows are located, {contract.located} must be")
    held_n, gone_n = of(held.where("identity IS NOT NULL").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))), of(gone.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))
    for name, r in sorted(sums.items()):
        rule = contract.rules.get(name)
        if rule is None:
            out.append(f"{name}: no such dataset")
            continue
        if r.collisions > rule.collisions:
            out.append(f"{name}: {r.collisions} rows share an identity, {rule.collisions} may")
        if r.disagree:
            out.append(f"{name}: {r.disagree} rows have a held stable id and another identity")
        if r.located < rule.located * r.n:
            out.append(f"{name}: {r.located} of {r.n} rows are located, {rule.located} must be")
    for name, r in sorted(gone_n.items()):
        most = contract.rules[name].max_absent
        most = max(1, held_n[name].n // 20) if most is None else most
        if r.n > most:
            out.append(f"{name}: {r.n} of {held_n[name].n} held rows are absent, {most} may be")
    return out


def load(table: Table, emitted: DataFrame, contract: Contract, now: int, fallback: bool = False) -> DataFrame:
    """Loads rows into the table; returns the run's report (dataset, class, n). Raises Refused, and changes nothing, if a check fails."""
    with table.locked():
        version = table.version()
        held = table.rows("open", version)
        emitted = written(emitted, "emitted")
        both = written(classed(emitted, held, contract, fallback), "classed")
        rows, gone = both.where(~F.col("class").isin(ALONE)), both.where("class = 'absent'").select(KEY)
        if found := problems(emitted, rows, held, gone, contract):
            raise Refused("; ".join(found))
        closing = F.col("class").isin("correction", "absent")
        anew = [r.dataset for r in both.where(closing).select("dataset").distinct().collect()]  # of the contract's datasets
        new = rows.where(F.col("class").isin(OPENS)).drop("class", "drop", "had").withColumn("sys_from", F.lit(now).cast("long")).withColumn("sys_to", F.lit(None).cast("long"))
        stay = both.where(F.col("dataset").isin(anew) & F.col("had").isNotNull() & ~closing).select("had.*").unionByName(held.where(F.col("dataset").isin(anew) & F.col("identity").isNull()))
        at = f"{table.path}/load-{version + 1}"
        stay.select(table.schema.names).unionByName(new.select(table.schema.names)).write.mode("overwrite").partitionBy("dataset").parquet(f"{at}/open")
        both.where(closing).select("had.*").withColumn("sys_to", F.lit(now).cast("long")).select(table.schema.names).write.mode("overwrite").parquet(f"{at}/closed")
        report = rows.groupBy("dataset", "class").agg(F.count(F.lit(1)).alias("n")).unionByName(gone.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.lit("absent_closed")))
        least = emitted.where("drop IS NULL").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.groupBy("dataset").agg((-F.count(F.lit(1))).alias("n")))
        repeated = least.groupBy("dataset").agg(F.sum("n").alias("n")).where("n > 0").withColumn("class", F.lit("stable_id_repeated"))
        report.unionByName(repeated).unionByName(emitted.where("drop IS NOT NULL").groupBy("dataset", F.concat(F.lit("drop:"), "drop").alias("class")).agg(F.count(F.lit(1)).alias("n"))).write.mode("overwrite").parquet(f"{at}/report")
        old = table.manifest(version)
        touched = [r.dataset for r in rows.where(F.col("class").isin(OPENS)).select("dataset").distinct().collect()]  # as many as the contract names
        opened = {d: (x if d not in anew else []) for d, x in old["open"].items()}
        for d in {*anew, *touched}:
            opened[d] = [*opened.get(d, []), version + 1]
        table.commit({"open": opened, "closed": [*old["closed"], version + 1]}, version + 1)
        dropped(emitted)
        dropped(both)
    return table.spark.read.parquet(f"{at}/report")
