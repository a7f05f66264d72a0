"""HTML extraction, source divergence, phrase collocations; ties and repeats of the mix; headers of the archive."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, extraction, jaccard, mixing, phrases, warc
from tidemark.llm.common import new_path, qualified
from tidemark.llm.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
BASE = [
    (1, "", "en", "a"), (2, None, None, None), (None, "null id, null id; null id", "en", None), (3, "Same text of words. " * 40, "en", "b"), (4, "Same text of words. " * 40, "en", "c"), (4, "Same text of words. " * 40, "en", "c"),
    (5, " \n\t ", "en", "d"), (6, "w" * 3000 + " x" * 200, "de", "a"), (7, "É🙂 日本 İstanbul É🙂 " * 60, None, "a"), (8, "12 34 .,;", "fr", ""), (9, "\x00a\x1cb a b " * 120, "fr", "z"), (10, "a,a.a:a!a?a;a a a " * 60, "fr", "y"),
]
ODD = BASE + [(100 + k, f"common words here {'rare' * (k % 3)} and there, often. Common WORDS here", ("en", "de")[k % 2], ("a", "b", None)[k % 3]) for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "y", 2) for r in ODD], DOCS + ", n int, term string, path int")


def by_sql(spark, df, sql, tmp_path):
    path = str(tmp_path / "documents")
    df.coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    q = c.sql(sql)
    return q.columns, sorted(map(repr, q.fetchall()))


def same(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == rows


@pytest.mark.parametrize("name, f", [("op12_source_divergence", divergence.divergence), ("op13_phrase_collocations", phrases.collocations)])
def test_sql_on_odd_rows(spark, odd, tmp_path, name, f):
    columns, rows = by_sql(spark, odd, ORACLE[name], tmp_path)
    assert rows
    same(f(odd), columns, rows)
    assert f(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_phrase_collocations"])
def test_sql_on_the_table(spark, tmp_path, name):
    columns, rows = by_sql(spark, spark.read.parquet(f"{DATA}/documents.parquet"), ORACLE[name], tmp_path)
    same(QUERIES[name](spark, DATA), columns, rows)


def test_counts_given_up_early(odd):
    rows = odd.select(F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    assert sorted(map(str, divergence.counted(rows, held=1).collect())) == sorted(map(str, divergence.counted(rows).collect()))


def test_tree_shares_paths(spark):
    rows = spark.createDataFrame([("en", [("a", 1), ("b", 2)]), ("en", [("a", 1), ("b", 2)]), ("en", [("a", 1)]), ("en", [("b", 2)])], "lang string, path array<struct<source: string, n: long>>")
    got = {tuple(map(tuple, r.path)): r.m for r in divergence.tree_nodes(rows).collect()}
    assert got == {(("a", 1),): 3, (("a", 1), ("b", 2)): 2, (("b", 2),): 1}


def test_automata_add_up():
    rnd, words = random.Random(4), [b"a", b"bb", b"c", b"\xc3\xa9"]
    grams = [[tuple(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(200)] for _ in range(4)]

    def built(rows):
        ids = np.array([[words.index(w) for w in g] + [-1] * (5 - len(g)) for g in rows])
        return phrases.automaton(ids, np.ones(len(rows), np.int64), words)

    whole = phrases.union([built(g) for g in grams])
    want = {}
    for g in itertools.chain(*grams):
        for k in range(1, len(g) + 1):
            want[g[:k]] = want.get(g[:k], 0) + 1
    read = lambda blob: {tuple(names[i] for i in row): n for names, ids, f, _ in phrases.paths(blob) for row, n in zip(ids.tolist(), f.tolist())}
    assert read(whole) == want
    assert read(phrases.union([built(g) for g in grams], 9)) == {g: f for g, f in want.items() if f >= 9}
    assert len(whole) <= len(phrases.automaton(np.array([[words.index(w) for w in g] + [-1] * (5 - len(g)) for g in itertools.chain(*grams)]), np.ones(800, np.int64), words))


def test_hash_is_sparks(spark):
    r = spark.sql("SELECT xxhash64('en', 'wörd') AS h").first().h
    assert r % (1 << 64) == phrases.word_hash("en", "wörd".encode())


def test_hot_and_wide_ranges(spark, monkeypatch):
    """Held n-grams are given up often, and blobs wait for unions in small lots."""
    rows = [(k, "a b " * 300 + f"u{k} v", "en", "s") for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    want = phrases.collocations(df).collect()
    monkeypatch.setattr(phrases, "HELD_GRAMS", 50)
    monkeypatch.setattr(phrases, "HELD_BYTES", 1)
    assert phrases.collocations(df).collect() == want and {r.phrase for r in want} >= {"a b a b a"}


def cost_of(costs, distance, last, labels):
    out = 0
    for k, x in enumerate(labels):
        out += max(0, -costs[k]) if x else max(0, costs[k])
        out += extraction.JOINT // max(1, distance[k]) * (k > 0 and labels[k - 1] != x)
        out += extraction.JOINT // 2 * (last[k] >= 0 and labels[last[k]] != x)
    return out


def test_minimum_cut_by_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(0, 9)
        costs = [rnd.choice([-1000, -700, -400, -200, 0, 200, 400, 700, 1000]) for _ in range(n)]
        distance, last = [rnd.randint(1, 6) for _ in range(n)], [rnd.randint(-1, k - 1) if k else -1 for k in range(n)]
        every = {x: cost_of(costs, distance, last, x) for x in itertools.product((False, True), repeat=n)}
        best = [x for x, v in every.items() if v == min(every.values())]
        assert tuple(map(bool, extraction.settled(np.array(costs), np.array(distance), np.array(last)))) == tuple(map(any, zip(*best)))


ARTICLE = "<p>The story begins here, with a long sentence; it has marks, and words enough.</p><p>It goes on&nbsp;&amp; on, telling <a href=x>more</a> of\n what happened there, and why.</p>"
STORY = "The story begins here, with a long sentence; it has marks, and words enough. It goes on & on, telling more of what happened there, and why."
PAGES = [
    ("", ""), (None, ""), ("just text &copy; here", None), ("<article><h1>Nd.</h1><p><b>Nd.<br></article><footer>f</footer>", "Nd. Nd."),
    (f"<nav>menu</nav><article>{ARTICLE}<aside>also</aside><div class='share-box'>share</div></article><section id=comments><article class=comment><p>nice, very nice, indeed!</p></article></section>", STORY),
    (f"<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header>{ARTICLE}<footer>by</footer></article></main>", "Title " + STORY),
    (f"<div class=cookie-notice>We use cookies, and more.</div><article>{ARTICLE}</article><form>Name <input><button>Go</button></form><div class=AdSlot>buy</div>", STORY),
    (f"<form action=/><div id=sidebar>x</div><article>{ARTICLE}</article></form>", STORY),
    (f"<script>var a='<article>no</article>'</script><style>p</style><!-- <p>no</p> --><article title='a > b'>{ARTICLE}</article><div hidden>no</div>", STORY),
    (f"<article>{ARTICLE}</article><p title=\"never closed> text", STORY), (f"<article>{ARTICLE}</article><!-- never closed <p>no", STORY), (f"<article>{ARTICLE}</article><script>never closed <p>no", STORY),
    (f"<ARTICLE>{ARTICLE}<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>", STORY + " one two c d"), ("<article>fo<b>ob</b>ar<div>it's <i>x</i></div> a &lt;b&gt; </article>", "foobar it's x a <b>"),
    (f"<div id=top><a href=/>Home</a> <a href=/n>News</a></div><div>{ARTICLE}</div><div class=footer>c</div>", STORY),
]


def test_extraction(spark):
    trained = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("kept", F.lit(1)).withColumn("said", F.lit("x"))
    odd = spark.createDataFrame([(10**6 + k, "u", h, 1, "x") for k, (h, _) in enumerate(PAGES)] + [(None, None, "<article>n</article>", 1, "x")] * 2, "page_id long, url string, html string, kept int, said string")
    rows = extraction.main_text(trained.unionByName(odd)).collect()
    got = {r.page_id: r for r in rows}
    for k, (_, text) in enumerate(PAGES):
        assert text is None or got[10**6 + k].text == text, PAGES[k]
        assert got[10**6 + k].n_chars == len(got[10**6 + k].text)
    assert [r.text for r in rows if r.page_id is None] == ["n", "n"]
    assert extraction.main_text(odd.limit(0)).count() == 0


def test_extraction_of_the_table(spark):
    """Pages are made with one article each; a tag or entity inside is the only mark-up."""
    import html
    import re

    want = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<(p|h1|/p|/h1|br)>", " ", inner))).split())
    assert {r.page_id: r.text for r in QUERIES["op11_html_extraction"](spark, DATA).collect()} == want


def test_long_and_deep_pages():
    n = 20_000
    page = "<div>" * n + "<p>x" * n + "</div>" * n
    found = extraction.blocks(page)
    assert len(found) == n and extraction.blocks("<" * n) == [("<" * n, 0, 0, 0, 1, -1)]
    rnd = random.Random(1)
    costs = np.array([rnd.choice([-1000, -300, 300, 1000]) for _ in range(n)])
    assert len(extraction.settled(costs, np.full(n, 2), np.array([-1, *range(n - 1)]))) == n


def filled(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, cap=mixing.CAP):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, full = {s: weights[k % len(weights)] for k, s in enumerate(names)}, set()
    while rest := [s for s in names if s not in full]:
        level = (share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        if not (over := {s for s in rest if weight[s] * level >= cap * sizes[s] - 1e-9}):
            break
        full |= over
    return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}


def test_targets_of_equal_ratios(spark):
    rnd = random.Random(3)
    for case in [{"a": 10_000, "b": 10_000, "c": 5_000}, *({(f"s{k}" if k else None): rnd.choice([0, 100, 200, 500, 1000, 2500, 5000]) for k in range(rnd.randint(1, 7))} for _ in range(10))]:
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(case.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(filled(case)) and min(got.values()) >= 0


def test_equal_rows_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(7, "one two three four five " * 10 + "six", "a", {"k": "v"})] * 300 + [(k, f"w{k} " * 10, "b", None) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string, string>")
    got = mixing.mixed(df).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_target").alias("target"), F.max("mix_size").alias("most"), F.max("mix_copies").alias("copies")).collect()
    assert {r.source: r.n for r in got} == {"a": 300, "b": 1000}
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 and r.copies <= 2 for r in got)


def test_urls_with_control_characters(spark):
    rows = [(1, "http://a.org/y\r\n\r\nz", "<p>1"), (2, "http://a.org/y\r\nWARC-Type: metadata", "<p>2"), (3, "http://a.org/a b\x7f\x00", "")]
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.parse_records(warc.read_archive(spark, path)).collect()}
    assert [got[k].record_type for k in (1, 2, 3)] == ["response"] * 3
    assert got[1].uri == "http://a.org/y%0D%0A%0D%0Az" and got[2].uri == "http://a.org/y%0D%0AWARC-Type:%20metadata" and got[3].uri == "http://a.org/a%20b%7F%00"
    assert {r.page_id: r.url for r in spark.read.parquet(f"{path}/headers").collect()} == {r[0]: r[1] for r in rows}


def test_paths_without_a_scheme(spark):
    assert qualified(spark, "/x/y") == "file:///x/y" and qualified(spark, "file:///x") == "file:///x" and new_path(spark, "t").startswith("file:///")


def test_index_keys_are_made_once(spark, monkeypatch):
    """op10: shingles are hashed into keys once and read again from files, which go when the members are known."""
    seen = []
    plain = jaccard.meet
    monkeypatch.setattr(jaccard, "meet", lambda rows, *rest, **more: seen.append(rows) or plain(rows, *rest, **more))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words are here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    made = next(df for df in seen if df.columns == ["k", "c"])
    assert "MapInArrow" not in made._jdf.queryExecution().toString()
    assert not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in made.inputFiles())
