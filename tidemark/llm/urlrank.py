"""URL filters [native]: rules, then link-graph propagation of trust and distrust.

A url's longest fitting rule decides. Other urls are judged by their host: a personalised
PageRank spreads trust, along links, from hosts most of whose pages allow rules fit; a reversed
one spreads distrust, against links, from hosts most of whose pages block rules fit, both over host edges weighted by the
number of links. A host is blocked where distrust times `penalty` exceeds trust. Mass of hosts
without links leaves the graph, as it would in a walk that stops there.

Steps go on until every host's masses have settled: five steps change none of them, nor reach a
new host, by more than a share of TOLERANCE. So a host counts however many links from a seed it is.

State and contributions are rows (host, kind, mass); a step is one join with the edges and one
pre-aggregated sum, so that a host with a third of all links is summed in parts and its edges
can be split.

Defined results: null urls and urls without `://` have an empty host and path, fit no rule and
are allowed; an empty host is no node; repeated pages count their links again; null html has no
links; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, STEPS, PENALTY = 0.85, 10, 1.0
TOLERANCE = 1e-6
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        out = F.when(fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Rows (src, dst, n): absolute links between different hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("dst"))
    return links.withColumn("dst", ascii_lower(F.col("dst"))).where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def flows(edges: DataFrame) -> DataFrame:
    """Rows (host, kind, to, part): where a host's trust, and its distrust, goes."""
    both = edges.select(F.col("src").alias("host"), F.lit("t").alias("kind"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.col("dst").alias("host"), F.lit("d").alias("kind"), F.col("src").alias("to"), "n"))
    total = both.groupBy("host", "kind").agg(F.sum("n").alias("total"))
    return both.join(total, ["host", "kind"]).select("host", "kind", "to", (F.col("n") / F.col("total")).alias("part"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, every: int = 5, tolerance: float | None = None) -> DataFrame:
    """seeds: rows (host, kind, mass). The masses after `steps` steps, or, with a tolerance, once `every` steps change none by more than this share of it.

    The lineage is cut every few steps.
    """
    moves, rank = written(flows(edges), "rank-flows"), seeds
    before = seeds
    for step in itertools.count(1) if tolerance is not None else range(1, steps + 1):
        sent = moves.join(rank, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (damping * F.col("part") * F.col("mass")).alias("mass"))
        rank = seeds.withColumn("mass", (1 - damping) * F.col("mass")).unionByName(sent).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if step % every == 0:
            rank = written(rank, "rank-step")
            if tolerance is not None and settled(before, rank, tolerance):
                break
            before = rank
    return rank


def settled(before: DataFrame, now: DataFrame, tolerance: float) -> bool:
    both = before.select("host", "kind", (-F.col("mass")).alias("gain"), F.lit(0.0).alias("mass")).unionByName(now.select("host", "kind", F.col("mass").alias("gain"), "mass"))
    return both.groupBy("host", "kind").agg(F.sum("gain").alias("gain"), F.sum("mass").alias("mass")).where(F.abs("gain") > tolerance * F.col("mass")).isEmpty()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, penalty: float = PENALTY) -> DataFrame:
    """Rows (id, host, path, rule, verdict) of every page."""
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("_r", longest_rule(rules, F.col("host"), F.col("path")))
    # a host is a trusted seed where allow rules fit most of its pages, a blocked one where block rules do
    count = lambda v: F.count_if(F.coalesce(F.col("_r.verdict") == v, F.lit(False)))
    tally = urls.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow").alias("t"), count("block").alias("d"))
    votes = tally.unpivot(["host", "pages"], ["t", "d"], "kind", "n").where("2 * n > pages").select("host", "kind", "n")
    totals = votes.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = written(votes.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("n") / F.col("all")).alias("mass")), "rank-seeds")  # totals has two rows at most
    rank = propagate(host_edges(pages, url_col, html_col), seeds, damping, tolerance=tolerance)
    mass = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0))
    bad = rank.groupBy("host").agg(mass("t").alias("trust"), mass("d").alias("distrust")).where(F.col("distrust") * penalty > F.col("trust")).select("host", F.lit("block").alias("_m"))
    out = urls.join(bad, "host", "left")
    return out.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.col("_m"), F.lit("allow")).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
