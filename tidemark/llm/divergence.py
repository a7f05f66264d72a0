"""Source divergence audit: how far the term shares of each source of a language lie from those of the others.

A term's row holds its nonzero counts in source order. Rows are the paths of a frequent-pattern
tree: a node is a prefix of such a path, with as many terms as pass through it, so that terms
with the same counts in the first sources share its nodes. A pair of sources is summed in three
parts, all whole numbers: the value of two zero counts for every term; what one nonzero count
changes, from how often each count occurs in a source; and what two nonzero counts change
beyond that, once for each combination of a node and one of its ancestors, times the node's
terms.

Words are counted in the tasks that read the texts; a task gives up its counts whenever it
holds HELD of them, so that its memory is bounded, and only counts are shuffled.

Defined results: null text, lang and source are empty strings; repeated rows are documents of
their own; texts without terms still make their group occur; an empty table gives an empty
result; texts may be of any length. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import docs_of, written

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Distinct counts that a task holds at most before it gives them up.
HELD = 400_000
#: What is no part of a term becomes a blank, A-Z small letters; bytes of 128 and more belong to other letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """docs: text, lang, source. Rows (lang, source, term, n, d): occurrences and documents; a null term tells that the group occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        d: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                own = d[lang, source]
                words = [None, *terms]
                arrays = [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([0, *terms.values()], pa.int64()), pa.array([0, *map(own.__getitem__, terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "d"])
            n.clear()
            d.clear()

        for batch in batches:
            for text, *group in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                terms = text.translate(FOLD).split()
                n[tuple(group)].update(terms)
                d[tuple(group)].update(set(terms))
                if len(n[tuple(group)]) > held:
                    yield from given()
            if sum(map(len, n.values())) > held:
                yield from given()
        yield from given()

    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *plain)
    parts = rows.mapInArrow(scan, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", exact(F.lit(UNIT)) * exact(count + 2), exact(total + 2 * terms))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def tree_nodes(rows: DataFrame) -> DataFrame:
    """rows: lang, path. Rows (lang, path, m): the tree's nodes as paths from the root, with the terms that pass through."""
    leaves = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))
    prefixes = leaves.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"), "m")
    return prefixes.groupBy("lang", "path").agg(F.sum("m").alias("m"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for every other source, part `term` for the terms that a source has most beyond its language."""
    counts = written(counted(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))), "term-counts")
    items = F.array_sort(F.collect_list(F.struct("source", "n")))
    rows = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all_n"), items.alias("path")).where(F.col("d") >= min_docs)
    rows = written(rows.select("lang", "term", "all_n", "path"), "term-rows")

    nodes = written(tree_nodes(rows), "tree")
    last = F.element_at("path", -1)
    single = nodes.groupBy("lang", last["source"].alias("source"), last["n"].alias("n")).agg(F.sum("m").alias("m"))
    single = written(single, "tree-counts")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    sums = single.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_n")])
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")

    def side(tag: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(tag), F.col("total").alias(f"total_{tag}"), F.col("zero").alias(f"zero_{tag}"), *(["v"] if tag == "a" else []))

    pairs = side("a").join(side("b"), "lang").where("a != b")
    nothing = gap(F.col("zero_a"), F.col("zero_b"))
    shares = single.join(groups, ["lang", "source"]).select("lang", F.col("source").alias("a"), "m", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    one = shares.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("zero_b")) - nothing)).alias("one"))

    both = nodes.where(F.size("path") > 1).select("lang", "m", last.alias("y"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("x"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("x.n").alias("na"), F.col("y.source").alias("b"), F.col("y.n").alias("nb")).agg(F.sum("m").alias("m"))
    both = both.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    p, q = share(F.col("na"), F.col("total_a"), F.col("v")), share(F.col("nb"), F.col("total_b"), F.col("v"))
    both = both.select("lang", "a", "b", "m", "zero_a", "zero_b", p.alias("p"), q.alias("q"))
    beyond = gap(F.col("p"), F.col("q")) - gap(F.col("p"), F.col("zero_b")) - gap(F.col("zero_a"), F.col("q")) + nothing
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * beyond).alias("value"))

    parts = pairs.select("lang", "a", "b", F.coalesce(F.col("v") * nothing, F.lit(0)).alias("value"))
    for a, b, df in (("a", "b", one.withColumnRenamed("one", "value")), ("a", "b", both)):
        parts = parts.unionByName(df.select("lang", "a", "b", "value")).unionByName(df.select("lang", F.col(b).alias("a"), F.col(a).alias("b"), "value"))
    pair = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    term = rows.select("lang", F.col("term").alias("item"), "all_n", F.inline("path").alias("source", "n")).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    term = term.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(names).unionByName(term.select(names))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(docs_of(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM d GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p, 1 + (1000000000 * (k.lang_n + 2)) // (v.lang_total + 2 * v.v) AS q
    FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL (SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS k FROM term) WHERE k <= 10)
"""
