"""SentencePiece encoding and decoding by a relational lattice.

A model's text form (a leading and, for each space, a word-start mark) is cut into words that
no piece crosses: before a mark that follows another character, and around new lines. Every
different word is encoded by columnar steps over all new words of a stretch of texts:

* explode: the substrings of bounded length, those of the longest piece at most;
* equi-join to the piece table, on a 64-bit hash of the substring (the table is the
  vocabulary's size, whatever the input);
* group the edges by word, sorted by rank, length and place;
* fold: step k takes the k-th edge of every word at once.

The public model is a byte-pair one, whose encoding is not the path of greatest score but that
of successive merges: an edge is taken if exactly one boundary is left inside it. The state of
a word is a bit mask of boundaries. One pass is enough unless a merge makes room for an edge of
an earlier rank; the fold marks such words, and an agenda merges them anew. Words of more than
`MOST` characters go to the agenda too, and so do words with characters that have no piece and
become byte pieces. For unigram models a word is folded by Viterbi's rule.

Encoded words are kept per Python worker in a bounded table; nothing is shuffled.

Defined results: null or empty text has no ids; repeated rows are encoded each; null ids are
passed on; an empty table gives an empty result. Extra columns are passed on; input columns
named ids are replaced. The text is whole; only control characters of the model itself have no
form as text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import docs_of
from tidemark.llm.windows import Hashes, mix

MARK, MOST, TOP, STRETCH, CACHE = "▁", 60, 62, 2_000_000, 800_000
CHUNK = f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, type(model.pieces[0])
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are")
        self.unigram, self.prefix = model.trainer_spec.model_type == 1, norm.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.normal = [(p.piece, k, p.score) for k, p in enumerate(model.pieces) if p.type == kind.NORMAL]
        self.byte = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.value = {k: b for b, k in self.byte.items()}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.control = {k for k, p in enumerate(model.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.raw = [bytes([self.value[k]]) if k in self.value else b"" if k in self.control else t.replace(MARK, " ").encode() for k, t in enumerate(self.texts)]
        self.longest = max(len(p) for p, _, _ in self.normal)
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, _ in self.normal):
            raise ValueError("pieces cross words")
        order = sorted({-s for _, _, s in self.normal})
        self.rank = {-s: r for r, s in enumerate(order)}

    def form(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def fold(self, word: str, table: dict[str, tuple[int, float]]) -> list[int]:
        """The ids of one word of any length."""
        n = len(word)
        if self.unigram:
            worst = min(s for _, _, s in self.normal) - 10
            best: list = [(0.0, 0, [])] + [None] * n
            into: list[list] = [[] for _ in range(n + 1)]
            for s in range(n):
                for l in range(1, min(self.longest, n - s) + 1):
                    if found := table.get(word[s : s + l]):
                        into[s + l].append((s, l, *found))
            for e in range(1, n + 1):
                options = [(best[s][0] + score, -s, s, [k]) for s, l, k, score in into[e]]
                if not any(l == 1 for _, l, _, _ in into[e]):
                    options.append((best[e - 1][0] + worst, 1 - e, e - 1, self.unknown_ids(word[e - 1])))
                top = max(options, key=lambda o: o[:2])
                best[e] = (top[0], top[2], top[3])
            out: list[list[int]] = []
            while n:
                out.append(best[n][2])
                n = best[n][1]
            return [k for ids in reversed(out) for k in ids]
        after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(s: int, t: int) -> None:
            if t < n and (found := table.get(word[s : end[t]])):
                heapq.heappush(heap, (self.rank[found[1]], s, t, end[t]))

        for s in range(n - 1):
            offer(s, s + 1)
        while heap:
            _, s, t, e = heapq.heappop(heap)
            if end[s] == t and end[t] == e and after[s] == t:
                end[s], after[s], end[t] = e, after[t], -1
                if after[s] < n:
                    before[after[s]] = s
                    offer(s, after[s])
                if before[s] >= 0:
                    offer(before[s], s)
        out2, s = [], 0
        while s < n:
            found = table.get(word[s : end[s]])
            out2 += self.unknown_ids(word[s]) if found is None else [found[0]]
            s = after[s]
        return out2

    def late(self) -> set[str]:
        """Pieces of which some two parts are no earlier merges than they are themselves."""
        rank = {t: self.rank[s] if len(t) > 1 else -1 for t, _, s in self.normal}
        return {t for t, r in rank.items() if any(a in rank and b in rank and max(rank[a], rank[b]) >= r for a, b in ((t[:k], t[k:]) for k in range(1, len(t))))}


class Lattice:
    """Encodes words with a model; keeps what it has encoded."""

    def __init__(self, path: str):
        self.pieces = p = Pieces(path)
        self.table = {t: (k, s) for t, k, s in p.normal}
        self.known: dict[str, bytes] = {}
        self.chunk = re.compile(CHUNK)
        late = set() if p.unigram else p.late()
        h = np.concatenate([self.hashes(t)[0].of(np.array([0]), np.array([len(t)])) for t, _, _ in p.normal])
        order = np.argsort(h)
        self.hash = h[order]
        self.id, self.rank, self.late = (np.array(x)[order] for x in ([k for _, k, _ in p.normal], [p.rank[s] for _, _, s in p.normal], [t in late for t, _, _ in p.normal]))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    @staticmethod
    def hashes(text: str) -> tuple[Hashes, int]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return Hashes(mix(points + np.uint64(1))), len(points)

    def joined(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equi-join of hashes to the piece table: which match, and their rows in it."""
        some = np.flatnonzero(self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        hit = self.hash[at] == h[some]
        return some[hit], at[hit]

    def masks(self, hashes: Hashes, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The boundaries of each word as bits; bit TOP where one pass was not enough."""
        word = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(word)) - start[word]
        left = n[word] - place
        found = []
        for l in range(2, self.pieces.longest + 1):
            p = np.flatnonzero(left >= l)
            if not len(p):
                break
            hit, row = self.joined(hashes.of(p, p + l))
            found.append((word[p[hit]], np.full(len(hit), l), place[p[hit]], row))
        mask = (np.int64(1) << (n + 1)) - 1
        if not found:
            return mask
        w, l, s, row = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((w << 40) | (self.rank[row] << 20) | (l << 10) | s, kind="stable")
        w, l, s, row = w[order], l[order], s[order], row[order]
        rank, one = self.rank[row], np.int64(1)
        ends, mid = (one << s) | (one << (s + l)), (one << (s + l)) - (one << (s + 1))
        fits = lambda m, e: ((m & ends[e]) == ends[e]) & (np.bitwise_count(m & mid[e]) == 1)
        count = np.bincount(w, minlength=len(n))
        first = np.cumsum(count) - count
        is_late = np.flatnonzero(self.late[row])
        late_count = np.bincount(w[is_late], minlength=len(n))
        late_first = np.cumsum(late_count) - late_count
        for k in range(int(count.max())):
            live = np.flatnonzero(count > k)
            e = first[live] + k
            ok = fits(mask[live], e)
            live, e = live[ok], e[ok]
            mask[live] &= ~mid[e]
            for j in range(int(late_count[live].max(initial=0))):
                some = np.flatnonzero(late_count[live] > j)
                y = is_late[late_first[live[some]] + j]
                again = (rank[y] <= rank[e[some]]) & fits(mask[live[some]], y)
                mask[live[some[again]]] |= one << TOP
        return mask

    def learn(self, words: list[str]) -> None:
        """Encodes words and keeps them."""
        p = self.pieces
        short = [] if p.unigram else [w for w in words if len(w) <= MOST]
        for w in words if p.unigram else (w for w in words if len(w) > MOST):
            self.known[w] = np.array(p.fold(w, self.table), "<u4").tobytes()
        if not short:
            return
        n = np.fromiter(map(len, short), np.int64, len(short))
        start = np.cumsum(n) - n
        hashes, _ = self.hashes("".join(short))
        mask = self.masks(hashes, start, n)
        word = np.repeat(np.arange(len(n)), n)
        begin = np.flatnonzero((mask[word] >> (np.arange(len(word)) - start[word])) & 1)
        owner = word[begin]
        end = np.append(begin[1:], len(word))
        hit, row = self.joined(hashes.of(begin, end))
        ids = np.full(len(begin), -1, np.int64)
        ids[hit] = self.id[row]
        whole = np.ones(len(n), bool)
        whole[owner[ids < 0]] = False
        whole[mask >= np.int64(1) << TOP] = False
        size = np.bincount(owner, minlength=len(n))
        at = 4 * (np.cumsum(size) - size)
        raw = ids.astype("<u4").tobytes()
        for k, w in enumerate(short):
            self.known[w] = raw[at[k] : at[k] + 4 * size[k]] if whole[k] else np.array(p.fold(w, self.table), "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of whole texts."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (size < STRETCH or not split):
                size += len(texts[at] or "")
                split.append(self.chunk.findall(self.pieces.form(texts[at] or "")))
                at += 1
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set().union(*split)
            self.learn(list(new))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out


_loaded: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The worker's lattice, kept over its tasks."""
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", digests_only: bool = False, verified: bool = False) -> DataFrame:
    """docs with ids. With digests_only, n_tokens, ids_crc32 and round_trip (decoding gives the text back) take the place of text and ids;
    with verified, ids, n_tokens and round_trip that of the text: both decode in the task that encodes. Columns of docs by these names are replaced."""
    new = {"n_tokens": T.LongType(), "ids_crc32": T.LongType(), "round_trip": T.BooleanType()} if digests_only else {"ids": T.ArrayType(T.IntegerType())} | ({"n_tokens": T.LongType(), "round_trip": T.BooleanType()} if verified else {})
    checked = digests_only or verified
    kept = [f for f in docs.schema.fields if f.name not in new and not (checked and f.name == text_col)]
    more = [T.StructField(k, v) for k, v in new.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column(text_col).to_pylist()
                raw = coder.encode(texts)
                own = [part.column(f.name) for f in kept]
                if not digests_only:
                    offsets = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
                    own.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32))))
                if checked:
                    same = [coder.pieces.decode(np.frombuffer(r, "<u4").tolist()) == (t or "") for r, t in zip(raw, texts, strict=True)]
                    crc = [pa.array(map(zlib.crc32, raw), pa.int64())] if digests_only else []
                    own += [pa.array([len(r) // 4 for r in raw], pa.int64()), *crc, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(own, names=[f.name for f in kept + more])

    return docs.mapInArrow(scan, T.StructType(kept + more))


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of an array of ids; null for null."""

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        p = lattice(model).pieces
        return ids.map(lambda x: None if x is None else p.decode(list(x)))

    return rows.withColumn("decoded", text(ids_col))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(docs_of(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)
