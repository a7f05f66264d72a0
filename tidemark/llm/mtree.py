"""Exact top-k inner product search on a paged M-tree.

Vectors x get one more coordinate, sqrt(M - |x|^2) with M the largest |x|^2, and queries 0, so
that the largest inner products are the least Euclidean distances, and the triangle inequality
holds. Every vector belongs to the nearest of a bounded sample of routing objects (at most
`MOST_ROUTES`, the rows of least id hash; only the sample is bounded, every row is indexed). A
route's members are cut by their distance to it, stored with them, into rings, and a ring into
pages of about `PAGE` rows by hash; equal vectors, however many, so fill many pages.

A query first opens the rings of least distance bound until they hold enough rows, which gives
a score to beat; then every ring whose bound allows that score. Within a page, the stored
distance to the route excludes rows before any product is taken. Queries and pages meet in
groups of one page and one block of queries.

Defined results: null vectors, vectors with null or non-finite components, and rows with a null
id take no part; repeated rows (same id, same vector) are one; shorter vectors are filled with
zeros; fewer than k candidates give as many rows; an empty table gives none. Products must fit
a long. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written

K, STEP, SCALE = 5, 50, 256
ROUTE_ROWS, MOST_ROUTES, RINGS, PAGE, QUERY_BLOCK = 1024, 1024, 4, 512, 1024
SLACK = 1e-6
#: Distances that a task holds at once, and about the visits that it hands on at once: neither grows with the table.
CELLS, VISITS = 1 << 20, 1 << 14


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Distinct rows (id, v): floor(scale * x) of the vectors that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(scale * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).distinct()


def matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def slices(batches, width: int):
    """The rows of batches, so many at a time that each against `width` others makes about CELLS."""
    step = max(1, CELLS // max(1, width))
    for b in batches:
        for at in range(0, len(b), step):
            yield b.iloc[at : at + step]


class Tree:
    """The directory: routes, and the rings' ranges of distances; of bounded size."""

    def __init__(self, routes: np.ndarray, norm: float, width: int):
        self.routes, self.norm, self.width = routes, norm, width
        self.up = np.sqrt(np.maximum(0, norm - (routes**2).sum(axis=1)))
        self.rings = pd.DataFrame()

    def distances(self, v: np.ndarray, lift: np.ndarray | float) -> np.ndarray:
        """From augmented vectors to every route."""
        sq = (v**2).sum(axis=1)[:, None] + (self.routes**2).sum(axis=1)[None] - 2 * v @ self.routes.T + (np.reshape(lift, (-1, 1)) - self.up[None]) ** 2
        return np.sqrt(np.maximum(0, sq))

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least distance that a ring's rows can have to queries at distances d from the routes."""
        r = self.rings
        to = d[:, r["route"].to_numpy()]
        return np.maximum(0, np.maximum(to - r["far"].to_numpy() * (1 + SLACK), r["near"].to_numpy() * (1 - SLACK) - to))

    def best_score(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """No row at this distance or farther has a larger product."""
        base = ((q**2).sum(axis=1) + self.norm)[:, None]
        return (base - bound**2) / 2 + SLACK * base + 1


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, step: int = STEP) -> DataFrame:
    """Rows (query_id, rank, id, score). queries: rows like vectors; null: those whose id is divisible by step."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(F.col("id") % step == 0) if queries is None else quantised(queries, id_col, vector_col, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm"), F.max(F.size("v")).alias("width")).first()
    empty = "query_id long, rank int, id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    width = max(1, facts["width"], asked.agg(F.max(F.size("v"))).first()[0] or 0)
    wanted = min(MOST_ROUTES, max(4, facts["n"] // ROUTE_ROWS))
    sample = rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(wanted).toPandas()
    tree = Tree(np.unique(matrix(sample["v"], width), axis=0), float(facts["norm"]), width)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        t = shared.value
        for b in slices(batches, len(t.routes)):
            v = matrix(b["v"], t.width)
            d = t.distances(v, np.sqrt(np.maximum(0, t.norm - (v**2).sum(axis=1))))
            route = d.argmin(axis=1)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "route": route.astype("int32"), "d": d[np.arange(len(b)), route]})

    placed = written(rows.mapInPandas(place, "id long, v array<long>, route int, d double"), "placed")
    radii = placed.groupBy("route").agg(F.max("d").alias("radius"))
    ring = F.least(F.floor(RINGS * F.col("d") / F.greatest(F.col("radius"), F.lit(1e-9))), F.lit(RINGS - 1)).cast("int")
    placed = placed.join(F.broadcast(radii), "route").withColumn("ring", ring)  # a row a route, MOST_ROUTES at most
    rings = placed.groupBy("route", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("near"), F.max("d").alias("far"))
    tree.rings = rings.toPandas().sort_values(["route", "ring"], ignore_index=True)  # RINGS rows a route at most
    tree.rings["pages"] = -(-tree.rings["n"] // PAGE)
    shared = spark.sparkContext.broadcast(tree)
    per_ring = spark.createDataFrame(tree.rings[["route", "ring", "pages"]])
    paged = placed.join(F.broadcast(per_ring), ["route", "ring"]).withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int")).select("route", "ring", "page", "id", "v", "d")

    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks)).cast("int"))

    def visits(first: bool):
        def plan(batches):
            t = shared.value
            r = t.rings
            for b in slices(batches, len(r)):
                q = matrix(b["v"], t.width)
                d = t.distances(q, 0.0)
                bound = t.bounds(d)
                if first:
                    order = bound.argsort(axis=1, kind="stable")
                    held = np.cumsum(r["n"].to_numpy()[order], axis=1)
                    open_ = np.zeros(bound.shape, bool)
                    np.put_along_axis(open_, order, (held - r["n"].to_numpy()[order]) <= k, axis=1)
                else:
                    beat = b["beat"].fillna(-np.inf).to_numpy(float)
                    open_ = t.best_score(q, bound) >= beat[:, None]
                rows, found = np.nonzero(open_)
                cuts = np.flatnonzero(np.diff((np.cumsum(r["pages"].to_numpy()[found]) - 1) // VISITS)) + 1
                for at, which in zip(np.split(rows, cuts), np.split(found, cuts), strict=True):
                    at, which = (np.repeat(x, r["pages"].to_numpy()[which]) for x in (at, which))
                    page = np.arange(len(at)) - np.maximum.accumulate(np.where(np.r_[True, (at[1:] != at[:-1]) | (which[1:] != which[:-1])], np.arange(len(at)), 0)) if len(at) else at
                    yield pd.DataFrame({"route": r["route"].to_numpy()[which], "ring": r["ring"].to_numpy()[which], "page": page.astype("int32"), "block": b["block"].to_numpy()[at], "id": b["id"].to_numpy()[at], "v": b["v"].to_numpy()[at], "d": d[at, r["route"].to_numpy()[which]], "beat": np.full(len(at), np.nan) if first else beat[at]})

        return plan

    kind = "route int, ring int, page int, block int, id long, v array<long>, d double, beat double"
    key = ["route", "ring", "page", "block"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries against one page: the k best of each."""
        t, out = shared.value, []
        if len(left) and len(right):
            right = right.rename(columns=lambda c: c.removeprefix("x_")).sort_values("id", ignore_index=True)
            q, x = matrix(left["v"], t.width), matrix(right["v"], t.width)
            ids, dist = right["id"].to_numpy(), right["d"].to_numpy()
            base = (q**2).sum(axis=1) + t.norm
            beat = left["beat"].fillna(-np.inf).to_numpy()
            # stored distances: |d(q, route) - d(x, route)| bounds d(q, x) before any product
            gap = np.maximum(0, np.abs(left["d"].to_numpy()[:, None] - dist[None]) - SLACK * (left["d"].to_numpy()[:, None] + dist[None]))
            allowed = ((base[:, None] - gap**2) / 2 + SLACK * base[:, None] + 1 >= beat[:, None]) & (ids[None] != left["id"].to_numpy()[:, None])
            cols = allowed.any(axis=0)
            score = products(q, x[cols])
            for i in range(len(q)):
                ok = allowed[i, cols]
                s, c = score[i, ok], ids[cols][ok]
                best = np.lexsort((c, -s))[:k]
                out.append(pd.DataFrame({"query_id": left["id"].iloc[i], "id": c[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")

    def run(visit: DataFrame) -> DataFrame:
        visit = written(visit, "visits")
        need = visit.select(*key).distinct()
        pages = paged.join(need, ["route", "ring", "page"]).select(*key, "id", "v", "d")
        pages = pages.select(*(F.col(c).alias(f"x_{c}") for c in pages.columns))
        found = visit.groupBy(*key).cogroup(pages.groupBy(*(f"x_{c}" for c in key))).applyInPandas(meet, "query_id long, id long, score long")
        best = found.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))).alias("b"))
        return best.select("query_id", F.slice(F.array_sort("b"), 1, k).alias("b"))

    first = written(run(asked.mapInPandas(visits(True), kind)), "first")
    known = first.select(F.col("query_id").alias("id"), F.when(F.size("b") >= k, -F.get("b", F.lit(k - 1))["s"]).cast("double").alias("beat"))
    second = run(asked.join(known, "id", "left").mapInPandas(visits(False), kind))
    return second.select("query_id", F.posexplode("b").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
