"""Suffix dedup by a depth-limited most-significant-digit radix sort.

Suffixes of the texts' UTF-8 bytes are ordered only through the threshold depth, `width` bytes,
in passes over digits of their keys (see `windows`): suffixes that share an anchor, then runs of
them with equal content, then nodes, then single suffixes. Only groups that still differ go on;
groups that stay equal to the full depth are exactly the repeated windows. All bytes that
repeated windows cover are removed, first occurrences included.

Defined results: null or empty text has no bytes; repeated rows (same id and text) are one
document, each row with its result, and do not repeat each other; rows of one id and different
texts, and rows with a null id, are documents of their own; a document shorter than `width`
bytes loses nothing; an empty table gives an empty result. Other columns play no part in
`remove_repeats` and are kept by `without_repeats`. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import docs_of
from tidemark.llm.windows import keyed, merged, repeated_spans, spans_by_doc

WIDTH, GRAM, NODE = 400, 64, 32


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, node: int = NODE) -> DataFrame:
    """docs with `spans`, structs (s, e) of byte numbers, possibly overlapping; null where there are none."""
    rows, bits = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows.select("d", F.col(text_col).alias("text")), "bytes", width, gram, node, bits=bits)
    return rows.join(spans_by_doc(spans, width), "d", "left").drop("d")


def _cut(text: str | None, spans) -> tuple[bytes, int, int, bytes]:
    raw = (text or "").encode()
    gone, n = merged(spans, len(raw))
    return raw, int(gone.sum()), n, np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, node: int = NODE) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch[id_col], batch[text_col], batch["spans"], strict=True):
                raw, gone, n, kept = _cut(text, spans)
                out.append((doc_id, len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({id_col: "Int64"})

    found = repeat_spans(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col, width, gram, node)
    return found.mapInPandas(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, node: int = NODE) -> DataFrame:
    """docs with the repeated bytes taken from their texts; of a character cut in two, the rest is dropped. Null stays null."""

    @F.pandas_udf(T.StringType())
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t if s is None else _cut(t, s)[3].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # names of our own: no column of docs can clash
    found = repeat_spans(docs.toDF(*own.values()), own[id_col], own[text_col], width, gram, node)
    return found.select(*[(rest(c, "spans") if name == text_col else F.col(c)).alias(name) for name, c in own.items()])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(docs_of(spark, sf_dir))
