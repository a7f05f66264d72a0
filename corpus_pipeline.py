"""A corpus pipeline of five stages; each reads what its predecessor kept, as a Parquet table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, pieces, quality, suffixes
from tidemark.llm.common import docs_of, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go; without words a document fails."""
    return quality.kept_rows(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join, the one of least id stays (null first). The similarity is 0.8. Documents without words all stay, of repeated rows one."""
    return jaccard.one_of_each(docs, percent=80, n=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated windows cover go; n_chars follows. Null stays null."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy of a document that the mix takes; documents without words are taken where their source is not full, and null is a source."""
    mix = mixing.mixed(docs).where("mix_copies > 0")
    return mix.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids of every text, and whether decoding gives the text back; null counts as an empty text. Other columns stay."""
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verified=True)
    return coded.select(*[c for c in docs.columns if c != "text"], *[c for c in ("n_tokens", "round_trip", "ids") if c not in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: Several stages cannot be said in SQL over whole tables; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
