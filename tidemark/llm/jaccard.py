"""N-gram Jaccard join by universe partition, and the components of its links.

Documents with equal shingle sets are one class, dealt with through one of them. Two sets of
Jaccard similarity percent/100 or more differ in at most H shingles, H fixed by a band of sizes.
The universe of shingles is dealt by hash into segments whose weights add up to H + 1 + 2x: a
segment of weight 1 is indexed by the part of the set that falls in it; one of weight 2 also by
that part less each one of its shingles (one-deletion neighbourhood). Each set may give up
weight x of its choice, and more where it is smaller than the band allows (`spare`), and by the
pigeonhole principle two such sets still share a key: sets give up the weight that costs most,
which is that of empty segments, whose key would bring many small sets together. `allocation`
picks the weights of a band by the keys that they make and by how many of them are of one
shingle or none, so that small sets have one-deletion neighbourhoods and larger ones exact parts. An empty segment that is not given up
is only a key together with a part of a second, independent partition.

Candidates of a key are not all paired. First every member meets the key's hub, chosen anew in
each of a few rounds; verified links merge components. What is left, members of one key in
different components, is compared in tiles of bounded size; each candidate first passes a bound
from a parity sketch (the sketches of two sets differ in no more bits than the sets in
shingles), and no pair that links is lost. Links are verified on the exact sets.

Defined results: null, empty or blank text has an empty set and is linked with nothing; repeated
rows are documents of one class; a null id is linked like others, but a component's name is its
least id that is not null (null if there is none); texts may be of any length; sets of equal
size and ties of any kind are no special case; an empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import docs_of, dropped, meet, written
from tidemark.llm.graph import components
from tidemark.llm.windows import K1, K2, K3, Hashes, keyed, mix, segments, text_bytes, word_symbols

WORDS, PERCENT, TILE, FEW, ROUNDS = 3, 90, 256, 16, 3
BAND = 1.25
THIN = 5  # what a part of at most one shingle, which many sets share, costs in keys


@lru_cache(4)
def bands(percent: int) -> np.ndarray:
    """Upper ends of the size bands."""
    out, hi = [], 0
    while hi < 1 << 31:
        hi = max(hi + 1, int((hi + 1) * BAND))
        out.append(hi)
    return np.array(out)


def most_apart(hi: int, percent: int) -> int:
    """How many shingles two linked sets of up to hi shingles can differ in."""
    return 2 * hi * (100 - percent) // (100 + percent)


def spare(hi: int, n: int, percent: int) -> int:
    """Weight that a set of n shingles in the band up to hi may give up: its partners differ from it by so much less."""
    return (hi - n) * (100 - percent) // (100 + percent)


@lru_cache(4096)
def allocation(lo: int, hi: int, percent: int) -> tuple[int, int, int]:
    """(segments of weight 2, segments of weight 1, weight x that each set may give up) of least keys, for sets of more than lo and up to hi shingles and their smaller partners."""
    most, sizes = most_apart(hi, percent), np.unique(np.linspace(max(1, (lo + 1) * percent // 100), hi, 5).astype(int))
    best = None
    for two in {0, most // 4, most // 2, (most + 1) // 2}:
        for x in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32):
            one, m = most + 1 + 2 * x - 2 * two, most + 1 + 2 * x - two
            if x > most + 1:
                break
            cost = 0.0
            for n in sizes:
                fill, left = n / m, x + spare(hi, n, percent)
                empty = (one + 2 * two + two * fill) * np.exp(-fill)  # weight that all empty parts and deletions would need
                over = max(0.0, empty - left) + 0.4 * np.sqrt(empty) * np.exp(-abs(empty - left) / np.sqrt(empty + 0.1))
                kept = max(0, two - max(0, left - empty)) if two else 0
                cost += one + two - max(0, left - two) + kept * fill + over * (most + 1) + THIN * m * (1 + fill) * np.exp(-fill)
            best = min(best or (cost, two, one, x), (cost, two, one, x))
    return best[1:]


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed word n-grams of each text, A-Z lower-cased; fewer words are one shingle."""
    lengths = np.diff(text_bytes(texts)[1])
    for a, b in segments(lengths, 1 << 20):
        data, offsets = text_bytes(texts.slice(a, b - a))
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        v1, _, at = word_symbols(data, offsets)
        every = Hashes(v1)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= n:
                p = np.arange(lo, hi - n + 1)
                yield np.unique(every.of(p, p + n))
            else:
                yield every.of(np.array([lo]), np.array([hi])) if hi > lo else np.empty(0, np.uint64)


def sketch(s: np.ndarray, percent: int) -> bytes:
    """Parity of the set's counts in hash buckets, over sixteen times as many as linked sets may differ in, so that few others pass."""
    bits = 64
    while bits < 16 * most_apart(len(s), percent):
        bits *= 2
    odd = np.bincount((mix(s * K3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A parity sketch, as bytes, over fewer buckets."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def weights(counts: np.ndarray, two: int, budget: int) -> np.ndarray:
    """The segments' weights of a set, with up to `budget` given up: first what an empty part or deletion needs, then what has most keys."""
    w = np.where(np.arange(len(counts)) < two, 2, 1)
    for which, cost in (((w == 1) & (counts == 0), 1), ((w == 2) & (counts == 1), 1), ((w == 2) & (counts == 0), 2)):
        chosen = np.flatnonzero(which)[: budget // cost]
        w[chosen] -= cost
        budget -= cost * len(chosen)
    wide = np.flatnonzero((w == 2) & (counts > 1))
    wide = wide[np.argsort(-counts[wide], kind="stable")][:budget]
    w[wide] = 1
    budget -= len(wide)
    narrow = np.flatnonzero((w == 1) & (counts > 0))
    w[narrow[np.argsort(counts[narrow], kind="stable")][:budget]] = 0
    return w


def set_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a sorted set under every band of its possible partners."""
    n, ends, out = len(s), bands(percent), []
    value, value2 = mix(s * K1), mix(s * K2 + K3)
    for b in range(int(np.searchsorted(ends, n)), int(np.searchsorted(ends, n * 100 // percent)) + 1):
        hi = int(ends[b])
        if most_apart(hi, percent) == 0:
            continue
        two, one, extra = allocation(int(ends[b - 1]) if b else 0, hi, percent)
        m, salt = two + one, np.uint64((b + 1) * 0x9E3779B97F4A7C15 % 2**64)
        seg = (mix(s + salt) % np.uint64(m)).astype(np.int64)
        sums, counts = np.zeros(m, np.uint64), np.bincount(seg, minlength=m)
        np.add.at(sums, seg, value)
        w = weights(counts, two, extra + spare(hi, n, percent))
        tag = lambda part, i: mix(part * K2 + i.astype(np.uint64) * K3 + salt)
        full = np.flatnonzero((w > 0) & (counts > 0))
        out.append(tag(sums[full], full))
        if two:
            less = (w[seg] == 2) & (counts[seg] > 1)
            out.append(tag(sums[seg[less]] - value[less], seg[less]))
        blank = np.flatnonzero((w > 0) & (counts == 0) | (w == 2) & (counts == 1))
        if len(blank):
            m2 = most_apart(hi, percent) + 1
            seg2 = (mix(s * K2 + salt) % np.uint64(m2)).astype(np.int64)
            sums2 = np.zeros(m2, np.uint64)
            np.add.at(sums2, seg2, value2)
            parts = sums2 * K1 + np.arange(m2).astype(np.uint64) * K2 + (salt ^ np.uint64(0xFFFFFFFFFFFFFFFF))
            out.append(mix(parts[None] + ((blank.astype(np.uint64) + np.uint64(1)) * K3)[:, None]).ravel())
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _cls(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = np.sum(mix(s ^ K1)), np.sum(mix(s ^ K2))
        return int(np.int64(mix(np.array([one + np.uint64(len(s)) * K3]))[0].view(np.int64))), int(two.view(np.int64))


def profiles(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Rows (d, id, n, c, c2, sketch): the document's number, its id, set size, the class's two hashes, parity sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_cls(s), sketch(s, percent)) for s in shingles(batch.column("text"), n)]
            if rows:
                size, c, c2, sk = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("id"), pa.array(size, pa.int32()), pa.array(c, pa.int64()), pa.array(c2, pa.int64()), pa.array(sk, pa.binary())], names=["d", "id", "n", "c", "c2", "sketch"])

    return docs.select("d", "id", "text").mapInArrow(scan, "d long, id long, n int, c long, c2 long, sketch binary")


def keys(reps: DataFrame, percent: int, n: int) -> DataFrame:
    """Rows (k, c): the index keys of each class; reps: (c, text), a row a class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, cs, held = [], [], 0
            for c, s in zip(batch.column("c").to_pylist(), shingles(batch.column("text"), n), strict=True):
                ks.append(set_keys(s, percent))
                cs.append(np.full(len(ks[-1]), c, np.int64))
                held += len(ks[-1])
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs))], names=["k", "c"])
                    ks, cs, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs))], names=["k", "c"])

    return reps.mapInArrow(scan, "k long, c long")


def _sets(reps: DataFrame, n: int) -> DataFrame:
    """Rows (c, s): the exact sorted set, as bytes, of each class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, c = 0, batch.column("c")
            for a, b in segments(np.diff(text_bytes(batch.column("text"))[1]), 1 << 20):
                made = [s.tobytes() for s in shingles(batch.column("text").slice(a, b - a), n)]
                yield pa.RecordBatch.from_arrays([c.slice(at, b - a), pa.array(made, pa.binary())], names=["c", "s"])
                at = b

    return reps.mapInArrow(scan, "c long, s binary")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, nu, nv, su, sv) whose sizes and sketches allow a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("nu", "nv"))
            keep = np.zeros(len(nu), bool)
            su, sv = batch.column("su"), batch.column("sv")
            for k in range(len(nu)):
                x, y = (np.frombuffer(z[k].as_py(), np.uint8) for z in (su, sv))
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                keep[k] = apart * (100 + percent) <= (100 - percent) * (nu[k] + nv[k])
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    sized = pairs.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return sized.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(scan, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("x")), "u")
    return one.join(sets.select(F.col("c").alias("v"), F.col("s").alias("y")), "v").select("u", "v", "x", "y").mapInArrow(scan, "u long, v long")


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """members (k, own, ti, tj, b, other, c, comp, n, sketch), a tile together: pairs in different components that sizes and sketches allow.

    A tile has members outside their key's main component, either among themselves (own) or against a block of the main one.
    """
    import pandas as pd

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out_u, out_v = [], []
        bits = np.frombuffer(b"".join(fold(np.frombuffer(x, np.uint8), size).tobytes() for size in [min(map(len, pdf["sketch"]))] for x in pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        n, comp, c, b, other = (pdf[x].to_numpy() for x in ("n", "comp", "c", "b", "other"))
        own, ti, tj = (pdf[x].iloc[0] for x in ("own", "ti", "tj"))
        left = np.flatnonzero(b == ti) if own else np.flatnonzero(other)
        right = np.flatnonzero(b == tj) if own else np.flatnonzero(~other)
        for i in left:
            r = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)]
            if own and ti == tj:
                r = r[c[r] > c[i]]
            if len(r):
                apart = np.bitwise_count(bits[r] ^ bits[i]).sum(axis=1, dtype=np.int64)
                r = r[apart * (100 + percent) <= (100 - percent) * (n[r].astype(np.int64) + n[i])]
                out_u.append(np.full(len(r), c[i]))
                out_v.append(c[r])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_u, out_v))
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return members.groupBy("k", "own", "ti", "tj").applyInPandas(compare, "u long, v long")


def _dealt(open_: DataFrame, tile: int) -> DataFrame:
    """open_ (k, c, comp, main, f, m): each member with the tiles it belongs to; f members are outside the main component, m in it."""
    blocks = lambda n: F.ceil(F.col(n) / tile).cast("int")
    d = open_.withColumn("other", F.col("comp") != F.col("main")).withColumn("b", F.pmod(F.xxhash64("c", "k"), F.when(F.col("other"), blocks("f")).otherwise(blocks("m"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    at = lambda own, i, j: F.struct(F.lit(own).alias("own"), i.alias("ti"), j.alias("tj"))
    among = F.transform(upto("f"), lambda o: at(True, F.least("b", o), F.greatest("b", o)))
    across = F.when(F.col("other"), F.transform(upto("m"), lambda o: at(False, F.col("b"), o))).otherwise(F.transform(upto("f"), lambda o: at(False, o, F.col("b"))))
    return d.select("k", "c", "comp", "other", "b", F.explode(F.when(F.col("other"), F.concat(among, across)).otherwise(across)).alias("x")).select("k", "x.*", "b", "other", "c", "comp")


def _joined(rows: DataFrame, percent: int, n: int, tile: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of all documents (d, id, text), and rows (c, c2, copies, rep, least, comp) of all classes."""
    every = written(profiles(rows, percent, n), "profiles")
    classes = every.where("n > 0").groupBy("c", "c2").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    info = classes.select(F.col("rep").alias("c"), "n", "sketch")
    reps = rows.select(F.col("d").alias("c"), "text").join(info.select("c").hint("merge"), "c", "left_semi").dropDuplicates(["c"])
    reps = written(reps, "reps")

    made = written(keys(reps, percent, n), "made")  # read twice: shingles cost more than their keys' files
    shared = made.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo != hi").select("k", "g")
    members = written(meet(made, written(shared, "shared"), ["k"], "g", ["c"]), "members")
    dropped(made)
    sets = written(_sets(reps.join(members.select("c").distinct(), "c", "left_semi"), n), "sets")

    links = None
    comps = members.select("c").distinct().select("c", F.col("c").alias("comp"))
    for turn in range(rounds):
        placed = members.join(comps, "c") if turn else members.withColumn("comp", F.col("c"))
        hubs = placed.groupBy("k").agg(F.min_by(F.struct("c", "comp"), F.xxhash64(F.lit(turn), *(["k", "c"] if turn else ["c"]))).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("k", "hub")
        pairs = placed.join(hubs, "k").where("comp != hub.comp").select(F.least("c", "hub.c").alias("u"), F.greatest("c", "hub.c").alias("v")).distinct()
        found = _join_links(pairs, info, sets, percent)
        links = found if links is None else written(links.unionByName(found), "links")
        comps = _placed(members, links)

    placed = written(members.join(comps, "c"), "placed")
    per = placed.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.sum("m").alias("g"), F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    sizes = per.where("comps > 1 AND g > 2").select("k", "g", F.col("g").alias("size"), F.col("top.comp").alias("main"), F.col("top.m").alias("m"), (F.col("g") - F.col("top.m")).alias("f"))
    # two members met as member and hub; few are paired by a join; many in tiles, the main component never with itself
    open_ = written(placed.join(sizes.drop("g"), "k"), "open")
    few = open_.where(F.col("size") <= FEW).select("k", "c", "comp")
    pairs = few.join(few.select("k", F.col("c").alias("v"), F.col("comp").alias("vcomp")), "k").where("c < v AND comp != vcomp").select(F.col("c").alias("u"), "v").distinct()
    found = _join_links(pairs, info, sets, percent)
    dealt = _dealt(open_.where(F.col("size") > FEW), tile).join(info, "c")
    found = found.unionByName(_verified(written(_tiles(dealt, percent).distinct(), "near"), sets, percent))
    links = written(links.unionByName(found), "links")

    comps = _placed(members, links)
    named = classes.withColumnRenamed("rep", "_c").join(comps.withColumnRenamed("c", "_c"), "_c", "left")
    return every, named.select("c", "c2", "copies", F.col("_c").alias("rep"), "least", F.coalesce("comp", "_c").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = WORDS, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, n_shingles, class_id, component_id): a row a document; class_id is the least id of its equal sets."""
    rows, _ = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text")
    every, named = _joined(rows, percent, n, tile, rounds)
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(named.join(names, "comp").select("c", "c2", "copies", F.col("least").alias("class_id"), "component_id"), "named")
    every = every.select("d", "id", F.col("n").cast("long").alias("n_shingles"), "c", "c2")
    linked = meet(every.where("n_shingles > 0"), named, ["c", "c2"], "copies", ["d", "id"])
    alone = every.where("n_shingles = 0").select("*", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = WORDS, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs without those linked, directly or not, to one of smaller id (null first, then by text hash); of repeated rows one. Rows with an empty set all stay, of repeated ones one."""
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # names of our own: no column of docs can clash
    every_row, _ = keyed(docs.toDF(*own.values()).withColumn(own[id_col], F.col(own[id_col]).cast("long")), own[id_col], own[text_col])
    every, named = _joined(every_row.select("d", F.col(own[id_col]).alias("id"), F.col(own[text_col]).alias("text")), percent, n, tile, rounds)
    stay = named.groupBy("comp").agg(F.min("rep").alias("d")).select("d").unionByName(every.where("n = 0").select("d").distinct())
    kept = every_row.join(written(stay, "stay").hint("merge"), "d", "left_semi").dropDuplicates(["d"])
    return kept.select(*[F.col(c).cast(docs.schema[name].dataType).alias(name) for name, c in own.items()])


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    comps = components(links)
    return written(members.select("c").distinct().join(comps.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("comp", "c").alias("comp")), "comps")


def _join_links(pairs: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(info.select(F.col("c").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u").join(info.select(F.col("c").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
    return written(_verified(written(_near(both, percent), "near"), sets, percent), "links")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(docs_of(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
