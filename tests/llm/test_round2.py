"""Hash twins, hot keys, the growing table of ratios, clashing names, and the pipeline on odd and empty tables."""

import base64
import collections
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, quality, substrings, suffixes, warc, windows
from tidemark.llm.common import meet, new_path
from tidemark.llm.registry import QUERIES

from test_operators import DATA, DOCS, ODD, WORD, linked  # noqa: E402


def twins(n):
    """A word of Thue and Morse over two letters, and its mirror: equal under any polynomial hash modulo a power of two."""
    bits = np.array([bin(k).count("1") & 1 for k in range(n)], np.uint8)
    return (bits + 97).tobytes().decode(), (98 - bits).tobytes().decode()


def test_twins_hash_apart():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in twins(2048))
    values = [windows._BYTES[1][x] for x in (a, b)]
    full = [windows.PrimeHashes(v).of(np.array([0]), np.array([len(v)]))[0] for v in values]
    assert full[0] != full[1]
    words = [windows.word_symbols(x, np.array([0, len(x)]))[0][0] for x in (a, b)]
    assert words[0] != words[1]


def test_twin_words(spark):
    a, b = twins(1024)
    rows = [(1, " ".join([a] + [f"x{k}" for k in range(30)]), "s"), (2, " ".join([b] + [f"y{k}" for k in range(30)]), "s"), (3, " ".join([a] * 25), "s"), (4, " ".join([b] * 25), "s")]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.n_removed for r in substrings.remove_duplicates(df, digests_only=True).collect()} == {1: 0, 2: 0, 3: 24, 4: 24}
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(linked(rows, 3, 90))
    raw = spark.createDataFrame([(1, a, "s"), (2, b, "s")], DOCS)
    assert all(r.n_removed < 1024 for r in suffixes.remove_repeats(raw, width=1024, gram=64, node=0).collect())


def test_prime_arithmetic():
    p, rng = 2**31 - 1, np.random.default_rng(5)
    x = rng.integers(0, 2**62, 1000, dtype=np.uint64)
    assert (windows.remainder(x) == x % np.uint64(p)).all()
    v = rng.integers(0, 2**64, 300, dtype=np.uint64)
    h = windows.PrimeHashes(np.concatenate([v, v[:7], v]))
    start = np.arange(0, 290)
    assert (h.of(start, start + 10) == h.of(start + 307, start + 317)).all() and len(set(h.of(start, start + 10).tolist())) == 290


def test_meet_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2500).alias("k"), F.lit("x").alias("_note"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("k % 2 = 1")
    got = {r.id: r.first for r in meet(rows, table, ["k"], "n", ["id"]).collect()}
    want, first = {}, {}
    for i in range(5000):
        k = 7 if i % 3 == 0 else i % 2500
        first.setdefault(k, i)
        if k % 2 == 1:
            want[i] = first[k]
    assert got == want
    assert meet(rows, table.where("n < 0"), ["k"], "n", ["id"]).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_given_up_weight(percent):
    """Sets at the edge of the similarity always share a key, however their segments fill."""
    rng = np.random.default_rng(percent)
    for n in [5, 6, 9, 10, 11, 15, 20, 33, 60, 150, 400, 1000]:
        for _ in range(12):
            s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            most = len(s) * (100 - percent) // 100
            drop = rng.integers(0, most + 1)
            t = s[rng.permutation(len(s))[drop:]]
            add = next(a for a in range(most, -1, -1) if 100 * len(t) >= percent * (len(s) + a))
            t = np.unique(np.concatenate([t, rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both >= percent * (len(s) + len(t) - both) and len(s) and both != len(s) + len(t) - both:
                assert len(np.intersect1d(jaccard.set_keys(s, percent), jaccard.set_keys(t, percent)))


def spark_hash(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed)


def test_op7_brute_force(spark):
    """llr and the verdict of every document, by the same hashes in plain Python."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, DATA).collect()}
    buckets = quality.buckets_for(spark.read.parquet(f"{DATA}/documents.parquet"), "text")
    grams = {}
    for i, t in rows:
        h = [spark_hash(w.encode()) for w in WORD.findall(t or "")]
        pairs = [spark_hash(b.to_bytes(8, "little"), spark_hash(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:])]
        grams[i] = [x & (buckets - 1) for x in h + pairs]
    n, good = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        n.update(g)
        if i in trusted:
            good.update(g)
    share = sum(good.values()) / sum(n.values())
    unit = {b: round(float(np.round(quality.UNIT * np.log((good[b] + quality.SMOOTHING) / (c * share + quality.SMOOTHING))))) for b, c in n.items()}
    for i, g in grams.items():
        llr = sum(unit[b] for b in g) / quality.UNIT / max(1, len(g))
        assert got[i].llr == pytest.approx(llr, abs=2e-3 / quality.UNIT * 1024)
        assert got[i].kept == (not got[i].base_failed and got[i].llr >= quality.THRESHOLD)


def test_op7_table_grows_and_both_ways_agree(spark):
    small, large = (spark.read.parquet(f"/root/testdata/{sf}/documents.parquet") for sf in ("sf0.001", "sf0.1"))
    assert quality.buckets_for(large, "text") >= 4 * quality.buckets_for(small, "text") and quality.buckets_for(small.limit(0), "text") == quality.LEAST
    odd = spark.createDataFrame(ODD + [(30, "word " * 400_000, "a")], DOCS)
    one, two = (quality.score(odd, odd.where("doc_id = 7").select("doc_id"), most_in_array=m) for m in (quality.MOST_IN_ARRAY, 0))
    assert one.count() == len(ODD) + 1 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_op8_names_and_fractions(spark):
    names = "target cut epochs source_size xb _s _b rank left".split()
    df = spark.createDataFrame([(k, "w " * (k % 17 + 1), "abc"[k % 3] if k % 5 else None, *range(9)) for k in range(600)] + [(None, "v " * 300_000, "z", *range(9))], DOCS + "".join(f", {n} int" for n in names))
    for cap in (1.25, 1.5, 2.0):
        got = mixing.mixed(df, cap=cap)
        assert got.columns[: len(df.columns)] == df.columns
        for r in got.where("source IS NULL OR source <> 'z'").groupBy("source").agg(F.first("mix_target").alias("t"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("n"), F.max("mix_copies").alias("m")).collect():
            assert abs(r.n - r.t) <= 9 and r.m <= np.ceil(cap)


def test_op6_digests(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["op6_warc_archive"](spark, DATA).collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode()
    df = spark.createDataFrame([(1, "u", "y" * 5_000_000, 3, "d"), (2, "u", "y" * 5_000_000, 3, "d")], "page_id long, url string, html string, digest int, payload string")
    path = new_path(spark, "warc")
    warc.write_archive(df, path)
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.parse_records(warc.read_archive(spark, path), digests_only=True).collect()) == [(1, "revisit", 5_000_000), (2, "response", 5_000_000)]


def test_pipeline_odd_and_empty(spark):
    import corpus_pipeline

    rows = [(i, t, "en", s, len(t or ""), "extra") for i, t, s in ODD] + [(100 + k, " ".join(f"w{(k * 31 + j * j) % 4001}" for j in range(120)), "en", "s", 0, None) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    for given in (rows, []):
        folder = new_path(spark, "tables")
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(100 + k, 1, 0) for k in range(10)] if given else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        out = got.collect()
        assert {"doc_id", "source", "ids", "n_tokens", "round_trip"} <= set(got.columns)
        assert bool(out) == bool(given) and all(r.round_trip for r in out) and all(r.doc_id >= 100 for r in out)


def test_tiles_across_components(spark, monkeypatch):
    """One key with a large component, smaller ones and strangers: every link between different components is found, with tiles of three."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for group, size in ((0, 14), (1, 5), (2, 1), (3, 1)):  # groups share half of their words, so that some keys hold all of them
        own = base[:24] + [f"g{group}_{k}" for k in range(16)]
        for _ in range(size):
            w = list(own)
            w[int(rng.integers(24, 40))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "s"))
    df = spark.createDataFrame(rows, DOCS)
    for percent in (80, 90):
        got = jaccard.jaccard_components(df, percent=percent, n=1, tile=3, rounds=1).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect())) == sorted(linked(rows, 1, percent))
