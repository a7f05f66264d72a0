"""Substring dedup against all earlier text, by windows grouped at content-chosen anchors.

No relative Lempel-Ziv parse is done: there are no greedy factors, and no step from the end of
one to the next. A parse needs the whole reference indexed in each task, which does not grow
with a corpus. Instead every window of `width` words that also starts earlier is found, by the
passes of `windows`, and overlapping finds are merged: the words that some earlier text repeats
over `width` words or more, which is all that factors of that length would cover.

Defined results: null or empty text has no words; rows of one id are ordered by their text's
hash; repeated rows (same id and text) are one document, each row with its result; a null id
comes before all others; a document shorter than `width` words loses nothing; an empty table
gives an empty result. Other columns play no part. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import docs_of
from tidemark.llm.windows import keyed, merged, repeated_spans, spans_by_doc

WIDTH, GRAM = 20, 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with `spans`, structs (s, e) of word numbers, possibly overlapping; null where there are none."""
    rows, bits = keyed(docs.select(id_col, text_col), id_col, text_col)
    spans = repeated_spans(rows.withColumnRenamed(text_col, "text") if text_col != "text" else rows, "words", width, gram, earlier=True, bits=bits)
    return rows.join(spans_by_doc(spans, width), "d", "left").drop("d")


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, digests_only: bool = False) -> DataFrame:
    """Rows (id, n_words, n_removed, n_spans, kept, kept_sha256); kept, the kept words joined by a space, is null with digests_only."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch[id_col], batch[text_col], batch["spans"], strict=True):
                words = WORD.findall(text) if text else []
                gone, n = merged(spans, len(words))
                kept = " ".join(words if not n else [words[k] for k in np.flatnonzero(~gone)])
                out.append((doc_id, len(words), int(gone.sum()), n, None if digests_only else kept, hashlib.sha256(kept.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[id_col, "n_words", "n_removed", "n_spans", "kept", "kept_sha256"]).astype({id_col: "Int64"})

    return duplicate_spans(docs, id_col, text_col, width, gram).mapInPandas(cut, f"`{id_col}` long, n_words long, n_removed long, n_spans long, kept string, kept_sha256 string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(docs_of(spark, sf_dir), digests_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
