"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import audit, belief, bulletins, cards, catalogue, composites, copying, corridors, deltas, learn, measures, monitor, news, places, polygons, reads, reports, series, sketches, summaries, temporal, textops, voices  # noqa: F401
from tidemark.plans import categories, loads, registers, spec  # noqa: F401
from tidemark.plans.register import ORACLE, QUERIES
from tidemark.sources import feeds, files, workbooks  # noqa: F401
from tidemark.streaming import events, readers, sessions  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["served_state"](spark, sf_dir)
