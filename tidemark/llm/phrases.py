"""Phrase collocations by weighted acyclic automata.

Each task turns the word sequences of its shard into sorted n-grams and those into acyclic
automata: an arc has a word and how many n-grams pass it, states with equal arcs are one state,
and all last arcs end in state 0. There is an automaton for each language and prefix range, a
range being a hash of an n-gram's first two words, so that a frequent first word is dealt over
many ranges. Automata of a range meet in one task, one after the other, and their weights are
summed; what stays under the least count is cut off. Parts of candidates are looked up by
walking the automaton of the part's range.

A phrase is frequent only if all its parts are, so that words are counted first, then pairs of
frequent words, then longer runs of frequent pairs. The tasks know frequent words and pairs by
bitmaps of at most MOST_BITS bits (32 MB), which are broadcast; a bit that two share only lets
more n-grams be counted, exact counts decide.

Defined results: null text is empty, null lang is `und`; a language without candidates has no
rows; repeated rows count as often as they occur; texts may be of any length; an empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import docs_of, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: A bitmap has 16 bits for each frequent word or pair, up to this many.
MOST_BITS = 1 << 28
#: Words that a task counts, and n-grams that it holds, before it gives them up; bytes of automata that wait for a union.
HELD_WORDS, HELD_GRAMS, HELD_BYTES = 500_000, 2_000_000, 32 << 20
#: Occurrences that one prefix range is meant for, and how many ranges there are at most.
RANGE_WORDS, MOST_RANGES = 8_000_000, 20_000
#: A-Z become small letters, the ends of pieces line ends, a tab a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Stands between pieces; no byte of UTF-8.
BREAK = b"\xff"


def of_langs(batch: pa.RecordBatch, gap: bytes) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch's texts by language, pieces parted by gap."""
    texts: dict[str, list[bytes]] = defaultdict(list)
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
        texts[lang].append(text)
    for lang, own in texts.items():
        yield lang, b"\n".join(own).translate(FOLD).replace(b"\n", gap).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text (binary), lang. Rows (lang, word, f)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, found in of_langs(batch, b" "):
                held[lang].update(found)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from given()
        yield from given()

    return docs.mapInArrow(scan, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_hash(lang: str, word: bytes) -> int:
    """As xxhash64(lang, word) of Spark, unsigned."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(ranges)).astype(np.int32)


def automaton(ids: np.ndarray, weight: np.ndarray, words: list[bytes], least: int = 0) -> bytes:
    """ids: n-grams as rows of places in words, which are sorted, -1 after the end. Arcs that fewer than `least` pass are cut off."""
    used = np.zeros(len(words) + 1, bool)  # the last one stands for -1
    used[ids] = True
    order = np.flatnonzero(used[:-1])
    place = np.full(len(words) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    ids = place[ids]
    levels, at, rows = [], np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in range(ids.shape[1]):
        go = ids[rows, k] >= 0
        rows, at = rows[go], at[go]
        key, back = np.unique(at << 32 | ids[rows, k], return_inverse=True)
        passed = np.bincount(back, weight[rows], len(key)).astype(np.int64)
        stay = passed >= least
        go = stay[back]
        rows, at = rows[go], (np.cumsum(stay) - 1)[back[go]]
        levels.append((key[stay] >> 32, key[stay] & 0xFFFFFFFF, passed[stay]))
        if not len(rows):
            break
    known: dict[bytes, int] = {b"": 0}
    arcs: list[np.ndarray] = []
    target = np.zeros(len(levels[-1][0]), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        parent, label, passed = levels[k]
        table = np.column_stack([label, passed, target])
        n = len(levels[k - 1][0]) if k else 1
        cuts = np.searchsorted(parent, np.arange(n + 1))
        target = np.zeros(n, np.int64)
        for state, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                own = table[a:b]
                target[state] = known.setdefault(own.tobytes(), len(known))
                if target[state] > len(arcs):
                    arcs.append(own)
    starts = np.cumsum([0, 0, *map(len, arcs)])
    flat = np.concatenate(arcs) if arcs else np.zeros((0, 3), np.int64)
    passed = flat[:, 1] if flat[:, 1].max(initial=0) >> 31 else flat[:, 1].astype(np.int32)
    return zstandard.compress(pickle.dumps((b" ".join(words[k] for k in order.tolist()), starts.astype(np.int32), flat[:, 0].astype(np.int32), passed, flat[:, 2].astype(np.int32), int(target[0])), 5), 1)


def opened(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Words; where each state's arcs start; label, weight and target of every arc; the first state."""
    names, starts, label, passed, target, root = pickle.loads(zstandard.decompress(blob))
    return names.split(b" ") if names else [], starts, label, passed.astype(np.int64), target, root


def paths(blob: bytes) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the words, the n-grams as rows, how many pass, and how many end there."""
    words, starts, label, passed, target, root = opened(blob)
    state, ids, weight = np.array([root]), np.zeros((1, 0), np.int32), np.zeros(1, np.int64)
    while len(state):
        n = starts[state + 1] - starts[state]
        back = np.repeat(np.arange(len(state)), n)
        arc = np.repeat(starts[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if ids.shape[1]:
            yield words, ids, weight, weight - np.bincount(back, passed[arc], len(state)).astype(np.int64)
        state, ids, weight = target[arc], np.column_stack([ids[back], label[arc]]), passed[arc]


def union(blobs: list[bytes], least: int = 0) -> bytes:
    """One automaton with the summed weights of all."""
    place: dict[bytes, int] = {}
    ids, ends = [], []
    for blob in blobs:
        for words, own, _, end in paths(blob):
            own, end = own[end > 0], end[end > 0]
            new = np.array([place.setdefault(w, len(place)) for w in words] + [-1])
            ids.append(np.pad(new[own], ((0, 0), (0, LONGEST - own.shape[1])), constant_values=-1))
            ends.append(end)
    if not ids:
        return automaton(np.zeros((0, 1), np.int64), np.zeros(0), [])
    words, new = in_order(list(place))
    return automaton(new[np.concatenate(ids)], np.concatenate(ends), words, least)


def in_order(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words sorted, and the new place of each; the last place stays -1."""
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.full(len(words) + 1, -1, np.int32)
    place[order] = np.arange(len(order))
    return [words[k] for k in order], place


class Words(dict):
    """Of a language: word to its place among the shard's frequent words, -1 for all others."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__({BREAK: -1})
        self.bits, self.names, self.hashes = bits, [], []
        self.seed, self.mask = xxhash.xxh64_intdigest(lang.encode(), 42), 8 * len(bits) - 1

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        at = h & self.mask
        self[word] = place = len(self.names) if self.bits[at >> 3] >> (at & 7) & 1 else -1
        if place >= 0:
            self.names.append(word)
            self.hashes.append(h)
        return place


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def cut_up(lang: str, names: list[bytes], ids: np.ndarray, weight: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An automaton for each range."""
    order = np.argsort(where, kind="stable")
    found, at = np.unique(where[order], return_index=True)
    for r, rows in zip(found.tolist(), np.split(order, at[1:])):
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang]), pa.array([automaton(ids[rows], weight[rows], names)], pa.binary())], names=["range", "lang", "automaton"])


AUTOMATA = "range int, lang string, automaton binary"


def shard_automata(docs: DataFrame, ranges: int, words: Broadcast, pairs: Broadcast | None = None) -> DataFrame:
    """Without pairs: automata of the pairs of frequent words. With them: of runs of frequent pairs, 3 to LONGEST words from each place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value
        more = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        known: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def given(lang: str) -> Iterator[pa.RecordBatch]:
            own, grams = known.pop(lang), np.concatenate(held.pop(lang))
            if not len(grams):
                return
            names, new = in_order(own.names)
            hashes = np.empty(len(names), np.uint64)
            hashes[new[:-1]] = own.hashes
            grams, weight = new[grams], np.ones(len(grams), np.int64)
            if pairs is None:
                key, weight = np.unique(grams[:, 0].astype(np.int64) << 32 | grams[:, 1], return_counts=True)
                grams = np.column_stack([key >> 32, key & 0xFFFFFFFF])
            yield from cut_up(lang, names, grams, weight, range_of(pair_hash(hashes[grams[:, 0]], hashes[grams[:, 1]]), ranges))

        for batch in batches:
            for lang, found in of_langs(batch, b" " + BREAK + b" "):
                own = known.setdefault(lang, Words(lang, bits))
                ids = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
                if pairs is None:
                    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                    held[lang].append(np.column_stack([ids[at], ids[at + 1]]))
                else:
                    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
                    at, hashes = np.flatnonzero(ok), np.array(own.hashes, np.uint64)
                    ok[at] = has(more, pair_hash(hashes[ids[at]], hashes[ids[at + 1]]))
                    ok, ids = np.append(ok, [False] * LONGEST), np.append(ids, [-1] * LONGEST)
                    at = np.flatnonzero(ok[:-1] & ok[1:])
                    run, rows = np.ones(len(at), bool), [ids[at], ids[at + 1], ids[at + 2]]
                    for k in range(3, LONGEST):
                        run = run & ok[at + k - 1]
                        rows.append(np.where(run, ids[at + k], -1))
                    held[lang].append(np.column_stack(rows))
                if sum(map(len, held[lang])) > HELD_GRAMS or len(own) > HELD_WORDS:
                    yield from given(lang)
        for lang in list(known):
            yield from given(lang)

    return docs.mapInArrow(scan, AUTOMATA)


def word_automata(frequent: DataFrame, ranges: int) -> DataFrame:
    """frequent: lang, word, f."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in batch.to_pandas().groupby("lang"):
                names, new = in_order([w.encode() for w in own["word"]])
                f = np.empty(len(names), np.int64)
                f[new[:-1]] = own["f"]
                where = range_of(np.array([word_hash(lang, w) for w in names], np.uint64), ranges)
                yield from cut_up(lang, names, np.arange(len(names))[:, None], f, where)

    return frequent.select("lang", "word", "f").mapInArrow(scan, AUTOMATA)


def united(parts: DataFrame, least: int) -> DataFrame:
    """One automaton a range and language; of those that meet in it at most HELD_BYTES wait."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]]), pa.array([union(held, least)], pa.binary())], names=["range", "lang", "automaton"])

        for batch in batches:
            for r, lang, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "automaton")), strict=True):
                if at not in (None, (r, lang)):
                    yield done()
                    held = []
                at = (r, lang)
                held.append(blob)
                if sum(map(len, held[1:])) > HELD_BYTES:
                    held = [union(held)]
        if at:
            yield done()

    return parts.repartition("range", "lang").sortWithinPartitions("range", "lang").mapInArrow(scan, AUTOMATA)


def phrases_in(automata: DataFrame, shortest: int) -> DataFrame:
    """Rows (lang, phrase, m, f, bit) of the n-grams of `shortest` and more words; bit is the hash of the first two words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("automaton").to_pylist(), strict=True):
                for words, ids, f, _ in paths(blob):
                    m = ids.shape[1]
                    if m >= shortest:
                        names = np.array(words, object)[ids]
                        hashes = np.array([word_hash(lang, w) for w in words], np.uint64)
                        bit = pair_hash(hashes[ids[:, 0]], hashes[ids[:, 1]]).astype(np.int64)
                        made = [pa.array([lang] * len(f)), pa.array([b" ".join(x) for x in names.tolist()], pa.binary()).cast(pa.string()), pa.array([m] * len(f), pa.int32()), pa.array(f), pa.array(bit)]
                        yield pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "m", "f", "bit"])

    return automata.mapInArrow(scan, "lang string, phrase string, m int, f long, bit long")


def bitmap(hashes: DataFrame, column: str) -> bytes:
    """Bits at the low bits of the hashes: 16 for each, as a power of two, at most MOST_BITS."""
    size = 1 << 15
    most = 16 * hashes.count()
    while size < min(most, MOST_BITS):
        size *= 2
    at = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    pages = hashes.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = bytearray(size // 8)
    for r in pages.collect():  # at most MOST_BITS / 32768 rows
        out[(r.page - 1) * 4096 : r.page * 4096] = r.bits
    return bytes(out)


def looked_up(parts: DataFrame, automata: DataFrame, ranges: int) -> DataFrame:
    """parts: lang, part, each once. Adds f, by walking the automaton of the part's range; none of them is missing there."""

    @F.pandas_udf("int")
    def place(lang: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for x, words in zip(lang, part):
            h = [np.array([word_hash(x, w)], np.uint64) for w in words.encode().split(b" ")[:2]]
            out.append(int(range_of(h[0] if len(h) == 1 else pair_hash(*h), ranges)[0]))
        return pd.Series(out, dtype="int32")

    def walk(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros(len(asked), np.int64)
        for lang, blob in zip(own["lang"], own["automaton"]):
            names, starts, label, passed, target, root = opened(blob)
            number = {w: k for k, w in enumerate(names)}
            for k in np.flatnonzero((asked["lang"] == lang).to_numpy()).tolist():
                state, n = root, 0
                for w in asked["part"].iat[k].encode().split(b" "):
                    a, b = starts[state], starts[state + 1]
                    at = a + np.searchsorted(label[a:b], number.get(w, -1))
                    if at == b or label[at] != number.get(w, -1):
                        n = 0
                        break
                    state, n = target[at], passed[at]
                f[k] = max(f[k], n)  # the runs of pairs hold less than all occurrences of a pair
        return pd.DataFrame({"lang": asked["lang"], "part": asked["part"], "f": f})

    asked = parts.withColumn("range", place("lang", "part"))
    return asked.groupBy("range").cogroup(automata.groupBy("range")).applyInPandas(walk, "lang string, part string, f long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words = written(word_counts(rows), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranges = min(MOST_RANGES, 12 + (words.agg(F.sum("f")).first()[0] or 0) // RANGE_WORDS)
    frequent = words.where(F.col("f") >= least).withColumn("bit", F.xxhash64("lang", "word"))
    known = sc.broadcast(bitmap(frequent, "bit"))
    singles = united(word_automata(frequent, ranges), least)
    pairs = written(united(shard_automata(rows, ranges, known), least), "pair-automata")
    two = written(phrases_in(pairs, 2), "pairs")
    joined = sc.broadcast(bitmap(two, "bit"))
    longer = written(united(shard_automata(rows, ranges, known, joined), least), "automata")
    found = written(two.unionByName(phrases_in(longer, 3)).select("lang", "phrase", "m", F.col("f").alias("a")), "phrases")

    w, k = F.split("phrase", " "), F.col("k")
    cuts = found.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(w, k + 1, F.col("m") - k), " ").alias("rest"))
    parts = cuts.select("lang", F.col("first").alias("part")).unionByName(cuts.select("lang", F.col("rest").alias("part"))).distinct()
    counts = written(looked_up(parts, singles.unionByName(pairs).unionByName(longer), ranges), "parts")
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", exact(1000 * F.col("a")) * exact(F.col("n")), exact(F.col("l")) * exact(F.col("r")))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")

    # a longer phrase that is as frequent holds one that has a single word more and is as frequent
    w, m = F.split("phrase", " "), F.col("m")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), m - 1), " "), F.array_join(F.slice(w, F.lit(2), m - 1), " "))
    hidden = found.where(m > 2).select("lang", F.explode(inner).alias("phrase"), "a").distinct()
    kept = scored.join(hidden, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(docs_of(spark, sf_dir))


OP13_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) AS k(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cut AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM c, range(1, 5) AS x(k) WHERE k < m),
scored AS (SELECT cut.*, l.f AS l, r.f AS r, n.n, (1000 * a * n.n) // (l.f * r.f) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept QUALIFY rank <= 2000
"""
