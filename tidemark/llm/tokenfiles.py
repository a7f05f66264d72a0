"""Token-ID output: bit-plane shuffled shards with a chunk index.

Documents are range-partitioned and sorted by id, encoded where they land, and written a shard
a task. A shard's ids are cut into blocks of `block` ids; a block's 32-bit ids are transposed
into four byte planes (or 32 bit planes), each compressed with zstandard. The footer holds the
chunk index (offset, ids, sizes of planes), the document index (id, number of ids) and a
checksum. Files have names of their own for every attempt of a task, and only those that the
manifest names count, so lost executors and repeated tasks leave no trace in the result.

Defined results: null or empty text is only the end id; null ids come first; rows of one id
are ordered by their text, null first, and repeated rows are all written; an empty table gives
no document. Other columns play no part. A document may span many chunks, and memory holds
a block, a batch of texts and the document index of one shard.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import docs_of, new_path, qualified, written

END_ID, BLOCK, LEVEL, MAGIC = 2, 1 << 16, 3, b"TIDEIDS1"
CACHE = 800_000
#: White space that has no fast path: all but the single space and the single new line.
RARE_SPACE = "".join(map(chr, (9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies use for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class Units(dict):
    """Ids, as little-endian bytes, of text units that the tokenizer never merges across; bounded.

    A unit of Latin letters is one piece of the pattern and goes to the merges directly; a full
    stop or comma after a letter is a piece of its own.
    """

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.lead, self.merge = tokenizer, lead, tokenizer.model.tokenize
        self.table = byte_characters()
        self.marks = {m: self.packed(tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        letters = unit.isalpha() and max(unit) < "\u0250"
        if letters:
            pieces = self.merge((self.lead + unit).encode().decode("latin-1").translate(self.table))
            out = self.packed([x.id for x in pieces])
        elif len(unit) > 1 and unit[-1] in self.marks and unit[:-1].isalpha() and max(unit) < "\u0250":
            out = self[unit[:-1]] + self.marks[unit[-1]]
        else:
            out = self.packed(self.tokenizer.encode(self.lead + unit, add_special_tokens=False).ids)
        self[unit] = out
        return out


class Encoder:
    """A tokenizer file's ids of whole texts.

    The byte-level pattern always breaks before a single space that stands between two other
    characters, and on both sides of such a new line; what lies between these breaks is encoded
    once and kept. Texts with any other white space are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.first, self.spaced = Units(self.whole, ""), Units(self.whole, " ")
        self.line = self.first["\n"]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        plain = not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text)
        if not plain or any(c in text for c in RARE_SPACE):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line)
            parts = line.split(" ")
            out.append(self.first[parts[0]])
            if len(parts) > 1:
                out.extend(map(self.spaced.__getitem__, parts[1:]))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    every = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(every[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    every = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(every, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, bits: bool, block: int):
        import zstandard

        self.out, self.bits, self.block, self.zip = out, bits, block, zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.chunks, self.ids, self.counts = len(MAGIC), [], [], []
        self.held, self.n = [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= 4 * self.block:
            data = b"".join(self.held)
            whole = len(data) - len(data) % (4 * self.block)
            for k in range(0, whole, 4 * self.block):
                self.flush(data[k : k + 4 * self.block])
            self.held, self.n = [data[whole:]], len(data) - whole

    def flush(self, data: bytes) -> None:
        packed = [self.zip.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), self.bits)]
        for p in packed:
            self.out.write(p)
        self.chunks.append([self.at, len(data) // 4, [len(p) for p in packed]])
        self.at += sum(map(len, packed))

    def close(self) -> None:
        if self.n:
            self.flush(b"".join(self.held))
        foot = self.zip.compress(json.dumps({"chunks": self.chunks, "ids": self.ids, "counts": self.counts}).encode())
        self.out.write(foot)
        self.out.write(struct.pack("<QI", len(foot), zlib.crc32(foot)) + MAGIC)


class ShardReader:
    """Random access to a shard: index first, then any document through its chunks."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        tail = 12 + len(MAGIC)
        source.seek(size - tail)
        end = source.read(tail)
        n, crc = struct.unpack("<QI", end[:12])
        source.seek(size - tail - n)
        foot = source.read(n)
        if end[12:] != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError("not a whole shard")
        self.index = json.loads(self.zip.decompress(foot))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.source.seek(at)
        return from_planes([self.zip.decompress(self.source.read(s)) for s in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of every document in order; one chunk and one document are held."""
        rest, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.index["ids"], self.index["counts"], strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have, k = have + len(parts[-1]), k + 1
            data = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, data[:n]
            rest = data[n:]

    def document(self, at: int) -> np.ndarray:
        """Ids of the document at a place of the index, from the chunks that hold it."""
        start, n = sum(self.index["counts"][:at]), self.index["counts"][at]
        out, base = [], 0
        for k, (_, size, _) in enumerate(self.index["chunks"]):
            if base < start + n and base + size > start:
                out.append(self.chunk(k)[max(0, start - base) : start + n - base])
            base += size
        return np.concatenate(out) if out else np.empty(0, "<u4")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Writes shards under path; returns the manifest, rows (shard, file, bytes, docs, tokens) in id order of shards."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(name, compression=None) as out:
            shards = ShardWriter(out, bits, block)
            for batch in batches:
                empty = batch["id"].isna()
                for doc_id, none, text in zip(batch["id"], empty, batch["text"], strict=True):
                    shards.add(None if none else int(doc_id), encode(text or "") + end)
            shards.close()
        size = store.get_file_info(name).size
        yield pd.DataFrame({"shard": [shard], "file": [name], "bytes": [size], "docs": [len(shards.ids)], "tokens": [sum(shards.counts)]})

    path = qualified(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(dealt.mapInPandas(write, "shard int, file string, bytes long, docs long, tokens long"), "ids-manifest")


def read_tokens(manifest: DataFrame, path: str, digests_only: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of the shards that a manifest names; ids null with digests_only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(path)
        for batch in batches:
            for name, size, start in zip(batch["file"], batch["bytes"], batch["start"], strict=True):
                with store.open_input_file(name) as raw:
                    out = []
                    for doc_id, ids in ShardReader(raw, int(size)).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), None if digests_only else ids.astype("int64")))
                        start += len(ids)
                        if len(out) == 2000:
                            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})
                            out = []
                    yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    path = qualified(manifest.sparkSession, path)
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "bytes", "start")
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "ids")
    manifest = write_tokens(docs_of(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, path, digests_only=True).select("doc_id", "start", "n_tokens", "ids_crc32")
