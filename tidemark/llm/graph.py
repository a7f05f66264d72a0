"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """edges: rows (u, v), in one direction. Rows (node, comp) of their nodes; comp is one of the component's nodes.

    Every round each node points to its least neighbour or itself, pointers are followed
    `jumps` times, and the edges between what is left make the next, smaller graph.
    """
    maps = []
    live = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "edges")
    while not live.isEmpty():
        up = live.groupBy("u").agg(F.min("v").alias("p")).withColumn("p", F.least("u", "p"))
        for _ in range(jumps):
            up = written(up, "pointers")
            up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        up = written(up, "pointers")
        maps.append(up)
        ends = live.join(up.select("u", F.col("p").alias("a")), "u").select("a", "v")
        live = written(ends.join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("comp"))
    for up in maps[1:]:
        out = out.join(up.select(F.col("u").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
    return written(out, "components")
