"""Main text of HTML pages by a minimum cut.

A page is read into blocks, in page order: runs of text that no block-level tag parts. Each block
has a cost for being called content and one for being called boilerplate. They come from the
tags, roles, classes and ids above it and from a classifier of its length, links, marks and tag:
log-odds of each feature, fitted on blocks whose surroundings tell what they are, of SAMPLE pages
at most, those of least hashed id. The costs are the capacities of a block's arcs from
the source and to the sink. Blocks are joined to their neighbour in the page, more strongly the
closer they stand in the tree of elements, and to the block before them in their own container.
A minimum cut, found by maximum flow, separates content from boilerplate; of several minimum
cuts, the one with most content counts. Blocks whose own capacity outweighs all their joints are
settled before the flow, which leaves the cut as it is.

Reading and the flow run in Python inside the tasks, a page at a time; features, the fit and
costs are column expressions.

Defined results: null html is an empty page with an empty text, null ids and urls are kept,
repeated rows are pages of their own, an empty table gives an empty result; a tag that never
closes, or a quote in it, takes the rest of the page, as in browsers. Pages may be of any length.
Other columns play no part.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages at most that the classifier is fitted on.
SAMPLE = 2000
#: Cost of going against the surroundings, against a page's own <article> where it has one, and a joint's capacity per step of distance.
SURE, LIKELY, OUTSIDE, JOINT, MOST_ODDS = 8000, 4500, 3000, 800, 1000

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags, roles and words of class and id that never hold an article; <form> and <header> may stand around or in one.
NEVER = set("nav aside footer menu dialog noscript template button select svg canvas audio video object applet".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "status", "menu", "menubar", "toolbar"}
WORDS = set(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored sponsors promo promos promoted promotion promotions
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars rail footer footers masthead topbar toolbar toc
    cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup signin login register search
    comment comments commentlist respond reply replies discussion disqus share sharing social follow related recommended recommendations trending popular copyright
    hidden""".split()
)
MAIN = {"article", "main"}
KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: What the elements above a block say.
UNKNOWN, ARTICLE, NO_ARTICLE, MAYBE_NOT, IN_MAIN = 0, 1, 2, 3, 4


def says(tag: str, attributes: str, above: int) -> int:
    """What a new element says, given what the one above it does."""
    if above == NO_ARTICLE or tag in NEVER:
        return NO_ARTICLE
    if attributes.strip(" \t\r\n\f/"):
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        style = re.sub(r"\s", "", found.get("style", "").lower())
        if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return NO_ARTICLE
        if tag not in MAIN:
            names = {x.lower() for x in NAME.findall(found.get("class", "") + " " + found.get("id", ""))}
            if names & WORDS:
                return NO_ARTICLE
            if "header" in names and above != ARTICLE:
                return MAYBE_NOT
        if role in MAIN:
            tag = role
    if tag == "article":
        return ARTICLE
    if tag == "main":
        return above if above == ARTICLE else IN_MAIN
    if tag == "form" or tag == "header" and above not in (ARTICLE, IN_MAIN):
        return MAYBE_NOT
    return above


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, kind, what surrounds it, characters in links, distance from the block before, last block of its container or -1)."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, int, list[int]]] = [("", UNKNOWN, [-1])]  # tag, what it says, its last block
    opened: Counter = Counter()
    parts: list[str] = []
    link, linked, at, low = False, 0, 0, 1  # low: depth of the lowest common ancestor with the block before
    before = 0

    def close() -> None:
        nonlocal linked, low, before
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            tag, said, _ = stack[-1]
            own = stack[-2][2] if tag in KINDS and len(stack) > 1 else stack[-1][2]
            depth = len(stack)
            out.append((text, KINDS.get(tag, 0), said, min(linked, len(text)), max(1, before + depth - 2 * low), own[0]))
            own[0], before, low = len(out) - 1, depth, depth
        linked = 0

    def pop(n: int) -> None:
        nonlocal low
        for tag, _, _ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]
        low = min(low, n)

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            linked += len(piece) if link else 0
        if not m:
            break
        at = m.end()
        end, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not end:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
            continue
        if tag == "a":
            link = not end
        elif tag in ("br", "hr"):
            parts.append(" ")
        if tag in INLINE or tag in VOID or tag in RAW:
            continue
        close()
        link = False
        if tag in ("html", "head", "body"):
            continue
        if end:
            if opened[tag]:
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                pop(n)
            continue
        if stack[-1][0] == "p":
            pop(len(stack) - 1)
        shut = CLOSES.get(tag, ())
        while stack[-1][0] in shut:
            pop(len(stack) - 1)
        stack.append((tag, says(tag, m[3] or "", stack[-1][1]), [-1]))
        opened[tag] += 1
    close()
    return out


FIELDS = {"text": "string", "kind": "int", "said": "int", "linked": "int", "distance": "int", "last": "int"}


def read_pages(pages: DataFrame) -> DataFrame:
    """pages: columns of which html is one. The others, and arrays of the blocks' fields."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    types = {"string": pa.string(), "int": pa.int32()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                columns = [[[b[n] for b in page] for page in found] for n in range(len(FIELDS))]
                arrays = [part.column(f.name) for f in kept] + [pa.array(c, pa.list_(types[t])) for c, t in zip(columns, FIELDS.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + list(FIELDS))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} array<{t}>" for n, t in FIELDS.items()])
    return pages.mapInArrow(scan, schema)


def bins(text: Column, kind: Column, linked: Column) -> list[Column]:
    """The features of a block as small numbers."""
    n = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, ".,;:!?", ""))
    steps = lambda c, edges: sum((c >= e).cast("int") for e in edges)
    return [kind, steps(n, (12, 25, 50, 100, 200, 400)), steps(100 * linked / n, (1, 20, 50, 80)), steps(100 * marks / n, (0.5, 1, 2, 4)), F.least(marks, F.lit(4))]


BINS = (5, 7, 5, 5, 5)


def fit(read: DataFrame) -> list[list[int]]:
    """For each feature and bin, thousandths of log-odds of content, from blocks whose surroundings tell; one block of each kind is added everywhere."""
    rows = read.select(F.explode(F.arrays_zip("text", "kind", "said", "linked")).alias("b")).where(F.col("b.said").isin(ARTICLE, IN_MAIN, NO_ARTICLE))
    good = (F.col("b.said") != NO_ARTICLE).cast("int")
    found = bins(F.col("b.text"), F.col("b.kind"), F.col("b.linked"))
    rows = rows.select(good.alias("good"), F.posexplode(F.array(*found)).alias("feature", "bin")).groupBy("feature", "bin").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    counts = {(r.feature, r.bin): (r.good, r.n - r.good) for r in rows.collect()}  # 27 rows at most
    out = []
    for k, size in enumerate(BINS):
        pairs = [counts.get((k, b), (0, 0)) for b in range(size)]
        g, x = sum(p[0] for p in pairs) + size, sum(p[1] for p in pairs) + size
        out.append([round(1000 * math.log((a + 1) / g * x / (b + 1))) for a, b in pairs])
    return out


def settled(costs: np.ndarray, distance: np.ndarray, last: np.ndarray) -> list[bool]:
    """Which blocks are content. costs: what calling a block boilerplate costs beyond calling it content."""
    n = len(costs)
    cost = [int(c) for c in costs]
    joints: list[dict[int, int]] = [{} for _ in range(n)]
    for k in range(1, n):
        for other, capacity in ((k - 1, JOINT // max(1, int(distance[k]))), (int(last[k]), JOINT // 2)):
            if other >= 0 and capacity:
                joints[k][other] = joints[other][k] = joints[k].get(other, 0) + capacity
    weight = [sum(j.values()) for j in joints]
    content: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if content[k] is None and (cost[k] >= weight[k] or -cost[k] > weight[k]):
            content[k] = cost[k] >= weight[k]
            for other, c in joints[k].items():
                if content[other] is None:
                    cost[other] += c if content[k] else -c
                    weight[other] -= c
                    todo.append(other)
    left = [k for k in range(n) if content[k] is None]
    if left:
        cut(left, cost, joints, content)
    return content


def cut(left: list[int], cost: list[int], joints: list[dict[int, int]], content: list) -> None:
    """Dinic's maximum flow over the blocks that are left; content are those from which the sink cannot be reached."""
    number = {k: i for i, k in enumerate(left)}
    s, t = len(left), len(left) + 1
    to, room, arcs = [], [], [[] for _ in range(len(left) + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        arcs[a].append(len(to)), to.append(b), room.append(there)
        arcs[b].append(len(to)), to.append(a), room.append(back)

    for k in left:
        if cost[k] > 0:
            join(s, number[k], cost[k], 0)
        elif cost[k] < 0:
            join(number[k], t, -cost[k], 0)
        for other, c in joints[k].items():
            if other in number and k < other:
                join(number[k], number[other], c, c)

    def levels(root: int, forward: bool) -> list[int]:
        level = [-1] * len(arcs)
        level[root] = 0
        queue = deque([root])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if level[to[e]] < 0 and room[e if forward else e ^ 1] > 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels(s, True))[t] >= 0:
        at, path = [0] * len(arcs), []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            own = arcs[a]
            while at[a] < len(own) and not (room[own[at[a]]] > 0 and level[to[own[at[a]]]] == level[a] + 1):
                at[a] += 1
            if at[a] < len(own):
                path.append(own[at[a]])
                a = to[own[at[a]]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break
    reach = levels(t, False)
    for k in left:
        content[k] = reach[number[k]] < 0


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def kept_blocks(costs: pd.Series, distance: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([settled(*x) for x in zip(costs, distance, last)], dtype=object)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """Rows (page_id, url, text, n_chars) by these names."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    few = rows.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    odds = fit(read_pages(rows.join(F.broadcast(few), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html")).select("html")))
    read = read_pages(rows)
    article = F.exists("said", lambda x: x == ARTICLE)

    def cost(b: Column) -> Column:
        found = bins(b["text"], b["kind"], b["linked"])
        guess = sum(F.get(F.array(*map(F.lit, o)), c) for o, c in zip(odds, found))
        guess = F.greatest(F.least(guess, F.lit(MOST_ODDS)), F.lit(-MOST_ODDS))
        said = F.when(b["said"] == ARTICLE, LIKELY).when(b["said"] == NO_ARTICLE, -SURE).when(F.col("_article"), F.when(b["said"] == IN_MAIN, 0).otherwise(-OUTSIDE)).when(b["said"] == IN_MAIN, LIKELY).when(b["said"] == MAYBE_NOT, -OUTSIDE).otherwise(0)
        return (guess + said).cast("int")

    read = read.withColumn("_article", article).withColumn("costs", F.transform(F.arrays_zip("text", "kind", "said", "linked"), cost))
    read = read.withColumn("kept", kept_blocks("costs", "distance", "last"))
    text = F.array_join(F.filter("text", lambda _, k: F.get("kept", k)), " ")
    return read.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
