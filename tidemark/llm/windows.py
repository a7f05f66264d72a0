"""Repeated fixed-length windows of a corpus, found digit by digit.

Every window of `width` symbols is a suffix of its document cut at the threshold depth. Its key
is read in digits, the most significant first, and each pass keeps only the groups of a digit
that still hold different keys:

1. The first digit is the window's anchor, its `gram`-symbol substring of least hash (the
   leftmost of equals). Windows next to each other mostly share an anchor, so a run of windows
   is one row. Anchors that occur once end here.
2. The second digit is the run's whole content. Equal runs are repeated windows, all of them;
   one run of each content goes on, and only beside another content under the same anchor.
3. With `node` set, runs are cut into nodes of that many neighbouring windows: first the
   content common to a node's windows, then the node's content.
4. The last digit is the window itself.

Groups are counted with sums made before the shuffle, and rows meet their group's count in a
join that Spark may split, so a key with a third of all rows is not gathered anywhere. Symbols
are compared by two hashes, one modulo a power of two and one modulo a prime at two bases;
single ones only choose candidates.

A text of more than a block of symbols is read in blocks that overlap by the windows' reach, each
with the place at which it starts, so that memory beside the text itself does not grow with it. A
run cut by the end of a block is found by the later digits, as one cut by the end of a segment is.

With earlier=False a window counts if it also starts elsewhere; with earlier=True only if it
also starts earlier, at a smaller id or before in the same document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, meet, written

SEGMENT = 1 << 19  # window starts handled at once
BLOCK = 2 * SEGMENT  # symbols of a long text handled at once
AT_BITS, LONG_BITS = 24, 31  # of a place beside its document's number: where all texts are short, and where some are not
_rng = np.random.default_rng(20240131)
#: Two values for each byte.
_BYTES = _rng.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_BASE = int(_rng.integers(2**62, 2**63, dtype=np.uint64)) | 1
_BASES = [int(x) for x in _rng.integers(2**29, 2**31 - 2, size=2)]
K1, K2, K3 = (np.uint64(int(x) | 1) for x in _rng.integers(2**62, 2**63, size=3, dtype=np.uint64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
PRIME, LOW = np.uint64(2**31 - 1), np.uint64(31)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _ended(x: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return mix(x + (end - start).astype(np.uint64) * K1 + np.asarray(salt).astype(np.uint64) * K2)


class Hashes:
    """Hashes of any substring of a symbol array, modulo 2**64: fast, and enough to choose candidates."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if 0 not in _powers or len(_powers[0][0]) <= n:
            full = lambda v: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n * 5 // 4 + 1, v, np.uint64)]))
            _powers[0] = full(np.uint64(_BASE)), full(np.uint64(pow(_BASE, -1, 2**64)))
        up, self.down = _powers[0]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return _ended((self.sums[end] - self.sums[start]) * self.down[start], start, end, salt)


def remainder(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & PRIME) + (x >> LOW)
    x = (x & PRIME) + (x >> LOW)
    return x - PRIME * (x >= PRIME)


def _prime_powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if lane + 1 not in _powers or len(_powers[lane + 1][0]) <= n:
        made = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, int(PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) <= n * 5 // 4:
                out = np.concatenate([out, remainder(out * np.uint64(pow(base, len(out), int(PRIME))))])
            made.append(out)
        _powers[lane + 1] = made[0], made[1]
    return _powers[lane + 1]


class PrimeHashes:
    """Hashes of any substring modulo a prime, at two bases: what is equal here is taken as equal.

    Sequences that differ and agree modulo a power of two whatever the base (as a word of Thue
    and Morse and its mirror do) differ here.
    """

    def __init__(self, values: np.ndarray):
        self.lanes = []
        for lane, v in enumerate((values & PRIME, values >> np.uint64(33))):
            up, down = _prime_powers(lane, len(values))
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(remainder(v * up[: len(v)]), out=sums[1:])
            self.lanes.append((sums, down))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        one, two = (remainder(remainder(sums[end] - sums[start]) * down[start]) for sums, down in self.lanes)
        return _ended((one << LOW) | two, start, end, salt)


FAMILIES = Hashes, PrimeHashes


def least(values: np.ndarray, w: int) -> np.ndarray:
    """For each start, the least of the next w values."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


# ---- symbols of texts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _BYTES[0][data], _BYTES[1][data], offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and the rows' offsets in words."""
    solid = np.ones(len(data) + 2, bool)
    solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    solid[0] = solid[-1] = False
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = solid[1:-1][edge]
    last[edge - 1] = solid[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of each word's 128-bit hash; a word that repeats is hashed once."""
    import xxhash

    starts, ends, at = word_bounds(data, offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
    raw = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    halves = np.frombuffer(raw, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), at


SYMBOLS: dict[str, Callable] = {"bytes": byte_symbols, "words": word_symbols}


def segments(lengths: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` symbols together."""
    at = 0
    while at < len(lengths):
        end, total = at, 0
        while end < len(lengths) and (end == at or total + lengths[end] <= most):
            total, end = total + lengths[end], end + 1
        yield at, end
        at = end


def blocks(data: np.ndarray, offsets: np.ndarray, kind: str, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(values, second values, offsets, first place, end) of rows of moderate size together, or of the blocks of one long row.

    A block has the symbols from its first place to its end and `reach` more.
    """
    if len(offsets) > 2 or len(data) <= BLOCK:
        v1, v2, at = SYMBOLS[kind](data, offsets)
        yield v1, v2, at, 0, len(v1)
        return
    v1, v2 = SYMBOLS[kind](data, offsets)[:2] if kind == "words" else (None, None)
    n = len(data) if v1 is None else len(v1)
    for at in range(0, n, BLOCK):
        part = slice(at, min(n, at + BLOCK + reach))
        own = (v1[part], v2[part]) if v1 is not None else byte_symbols(data[part], offsets)[:2]
        yield *own, np.array([0, part.stop - at]), at, min(n, at + BLOCK)


def runs(v1: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor, first and last window start of every run (places in the whole array), and its row."""
    out = []
    n, hashed = len(v1), Hashes(v1)
    if n >= width:
        for lo in range(0, n - width + 1, SEGMENT):
            hi = min(n - width + 1, lo + SEGMENT)  # window starts lo to hi - 1
            p = np.arange(lo, hi + width - gram)
            g = hashed.of(p, p + gram)
            keys = (g & ~np.uint64((1 << AT_BITS) - 1)) | (p - lo).astype(np.uint64)
            anchor = (least(keys, width - gram + 1) & np.uint64((1 << AT_BITS) - 1)).astype(np.int64) + lo
            s = np.arange(lo, hi)
            row = np.searchsorted(offsets, s, side="right") - 1
            inside = s + width <= offsets[row + 1]
            s, row, anchor = s[inside], row[inside], anchor[inside]
            if len(s):
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
                end = np.concatenate([new[1:], [len(s)]]) - 1
                out.append((g[anchor[new] - lo], anchor[new], s[new], s[end], row[new]))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], names=list(columns))


def _anchors(docs: DataFrame, kind: str, width: int, gram: int, only: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            lengths = np.diff(text_bytes(batch.column("text"))[1])
            for x, y in segments(lengths, BLOCK):
                for v1, v2, offsets, at, _ in blocks(*text_bytes(batch.column("text").slice(x, y - x)), kind, width - 1):
                    h, a, lo, hi, row = runs(v1, offsets, width, gram)
                    if only:
                        yield _batch(h=h)
                        continue
                    salt, base = a - lo, offsets[row] - at
                    c1, c2 = (family(v).of(lo, hi + width, salt) for family, v in zip(FAMILIES, (v1, v2), strict=True))
                    yield _batch(h=h, c1=c1, c2=c2, d=ids[x:y][row], a=(a - base).astype(np.int32), l1=(a - hi).astype(np.int32), l2=(a - lo).astype(np.int32))

    return docs.select("d", "text").mapInArrow(scan, "h long" if only else "h long, c1 long, c2 long, d long, a int, l1 int, l2 int")


def _with_runs(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """docs that have reps (d, a, l1, l2, m), with the list of them."""
    return docs.select("d", "text").join(reps.groupBy("d").agg(F.collect_list(F.struct("a", "l1", "l2", "m")).alias("r")), "d")


def _opened(rows: DataFrame, kind: str, width: int, emit: Callable, schema: str) -> DataFrame:
    """emit over the runs of each document: gets values, second values, place of a, l1, l2, m, ids and the rows' bases."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("d").to_numpy(zero_copy_only=False), batch.column("r")
            lengths = np.diff(text_bytes(batch.column("text"))[1])
            for x, y in segments(lengths, BLOCK):
                part = lists.slice(x, y - x)
                flat, sizes = part.flatten(), part.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(y - x), sizes)
                a, l1, l2 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                m = flat.field(3).to_numpy(zero_copy_only=False)
                if y == x + 1:
                    order = np.argsort(a - l2)
                    a, l1, l2, m = a[order], l1[order], l2[order], m[order]
                for v1, v2, offsets, at, end in blocks(*text_bytes(batch.column("text").slice(x, y - x)), kind, 2 * width):
                    first, last = np.searchsorted(a - l2, (at, end)) if y == x + 1 else (0, len(a))  # a run belongs to the block in which it starts
                    for k in range(first, last, 4000):
                        cut = slice(k, min(k + 4000, last))
                        base = offsets[row[cut]] - at
                        yield emit(v1, v2, a[cut] + base, l1[cut], l2[cut], m[cut], ids[x:y][row[cut]], base)

    return rows.select("d", "text", "r").mapInArrow(scan, schema)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the ranges low to high."""
    n = high - low + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def repeated_spans(docs: DataFrame, kind: str, width: int, gram: int, node: int = 0, earlier: bool = False, bits: int | None = None) -> DataFrame:
    """Rows (d, s, e): symbols s to e - 1 of document d lie in windows that count. docs: (d, text), and bits, see `keyed`."""
    pos = (F.shiftleft("d", bits) + F.col("a") if bits else F.struct("d", "a")).alias("p")
    n = F.count(F.lit(1)).alias("n")
    shared = written(_anchors(docs, kind, width, gram, True).groupBy("h").agg(n).where("n > 1"), "shared")
    runs_ = written(meet(_anchors(docs, kind, width, gram, False), shared, ["h"], "n", ["d", "a"]), "runs")

    kinds = runs_.withColumn("p", pos).groupBy("h", "c1", "c2").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.min("l1").alias("l1"), F.min("l2").alias("l2"), n)
    kinds = written(kinds, "run-kinds")
    met = meet(runs_.withColumn("p", pos), kinds.where("first < last").select("h", "c1", "c2", "first", "n"), ["h", "c1", "c2"], "n", ["d", "a"])
    if earlier:
        met = met.where("p > first")
    spans = [met.select("d", (F.col("a") - F.col("l2")).alias("s"), (F.col("a") - F.col("l1") + width).alias("e"))]

    many = written(kinds.groupBy("h").agg(n).where("n > 1"), "many")
    place = lambda p: (F.shiftright(p, bits).alias("d"), F.col(p).bitwiseAND((1 << bits) - 1).cast("int").alias("a")) if bits else (F.col(f"{p}.d"), F.col(f"{p}.a"))
    reps = meet(kinds.drop("n"), many, ["h"], "n", ["c1"]).select(*place("first"), "l1", "l2", (F.col("first") < F.col("last")).alias("m"))

    if node:

        def nodes(v1, v2, a, l1, l2, m, ids, base):
            row, i = _spread(l1 // node, l2 // node)
            a, m, ids = a[row], m[row], ids[row]
            low, high = np.maximum(l1[row], i * node), np.minimum(l2[row], i * node + node - 1)
            top = np.minimum(i * node + node - 1, width - gram)
            h1, h2 = Hashes(v1), PrimeHashes(v2)
            start, end = a - high, a - low + width
            salt = (i * 4096 + (low - i * node)) * 4096 + (high - i * node)
            return _batch(core=h1.of(a - i * node, a - top + width, i), f1=h1.of(start, end, salt), f2=h2.of(start, end, salt), d=ids, a=(a - base[row]).astype(np.int32), l1=low.astype(np.int32), l2=high.astype(np.int32), m=m)

        made = written(_opened(_with_runs(docs, reps), kind, width, nodes, "core long, f1 long, f2 long, d long, a int, l1 int, l2 int, m boolean"), "nodes")
        key = ["core", "f1", "f2"]
        kinds = written(made.withColumn("p", pos).groupBy(*key).agg(F.min("p").alias("first"), F.max("p").alias("last"), F.max("m").alias("m"), F.min("l1").alias("l1"), F.min("l2").alias("l2")).withColumn("m", F.col("m") | (F.col("first") < F.col("last"))), "node-kinds")
        met = made.where("NOT m").join(kinds.where("m").select(*key), key, "left_semi")
        spans.append(met.select("d", (F.col("a") - F.col("l2")).alias("s"), (F.col("a") - F.col("l1") + width).alias("e")))
        many = written(kinds.groupBy("core").agg(n, F.min("m").alias("done")).where("n > 1 AND NOT done").select("core", "n"), "many")
        reps = meet(kinds, many, ["core"], "n", ["f1"]).select(*place("first"), "l1", "l2", "m")

    def windows(v1, v2, a, l1, l2, m, ids, base):
        row, l = _spread(l1, l2)
        s = a[row] - l
        q1, q2 = Hashes(v1).of(s, s + width), PrimeHashes(v2).of(s, s + width)
        return _batch(q1=q1, q2=q2, d=ids[row], a=(s - base[row]).astype(np.int32), m=m[row])

    made = written(_opened(_with_runs(docs, reps), kind, width, windows, "q1 long, q2 long, d long, a int, m boolean"), "windows").withColumn("p", pos)
    kinds = made.groupBy("q1", "q2").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.max("m").alias("any"))
    if earlier:
        met = made.join(written(kinds.where("first < last").select("q1", "q2", "first"), "window-kinds"), ["q1", "q2"]).where("p > first")
    else:
        met = made.where("NOT m").join(written(kinds.where("first < last OR any").select("q1", "q2"), "window-kinds"), ["q1", "q2"], "left_semi")
    spans.append(met.select("d", F.col("a").alias("s"), (F.col("a") + width).alias("e")))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int | None]:
    """docs, which have no column d, with `d`, a number of each different (id, text) that follows their order, null first,
    and in how many bits a place stands beside d in one long; None where both do not fit and are kept as a struct.

    The id itself where ids are distinct, not null, and small enough to be packed with a place;
    else the place in the sorted list of all different (id, text hash). Repeated rows share it.
    """
    ident = F.col(id_col).cast("long")
    known = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("m"), F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.max(F.octet_length(text_col)).alias("len")).first()
    bits = AT_BITS if (known["len"] or 0) < 1 << AT_BITS else LONG_BITS  # a text has less than 2**31 bytes
    if known["n"] == known["m"] and (known["n"] == 0 or known["lo"] >= 0 and known["hi"] < 1 << (62 - bits)):
        return docs.withColumn("d", ident), bits
    key = [F.coalesce(ident, F.lit(NO_ID)).alias("_i"), F.xxhash64(F.col(text_col)).alias("_h")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["_i", "_h", "_part", "_k"])
            at += n

    keys = docs.select(*key).distinct().repartitionByRange("_i", "_h").sortWithinPartitions("_i", "_h")
    keys = written(keys.mapInArrow(number, "_i long, _h long, _part int, _k long"), "keys")
    parts = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    parts = parts.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = keys.join(F.broadcast(parts), "_part").select("_i", "_h", (F.col("_from") + F.col("_k")).alias("d"))
    return docs.withColumns({"_i": key[0], "_h": key[1]}).join(keys, ["_i", "_h"]).drop("_i", "_h"), bits if known["n"] < 1 << (62 - bits) else None


def spans_by_doc(spans: DataFrame, width: int) -> DataFrame:
    """The spans of each document as a list. Of spans, none shorter than `width`, those that start less than `width` apart
    are one, so that the list of a long text that repeats itself everywhere stays short."""
    joined = spans.groupBy("d", F.floor(F.col("s") / width)).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return joined.groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans, n: int) -> tuple[np.ndarray, int]:
    """Which of n symbols the spans cover, and in how many runs."""
    gone = np.zeros(n + 2, np.int32)
    if spans is not None and len(spans):
        s, e = (np.fromiter((x[k] for x in spans), np.int64, len(spans)) for k in ("s", "e"))
        np.add.at(gone, s + 1, 1)
        np.add.at(gone, e + 1, -1)
    covered = np.cumsum(gone)[1 : n + 1] > 0
    return covered, int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
