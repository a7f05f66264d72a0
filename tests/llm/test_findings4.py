"""Findings of round 4 on corpus operators."""

import numpy as np
import pandas as pd

from tidemark.llm import mtree


def test_search_holds_few_distances_at_once(spark, monkeypatch):
    """a batch of queries is planned in slices and handed on in pieces, however many routes, rings and pages there are; results are brute force's."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5))
    x[300:600] = x[0]  # a ring of many pages
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "ROUTE_ROWS", 16)
    monkeypatch.setattr(mtree, "CELLS", 2000)
    monkeypatch.setattr(mtree, "VISITS", 50)
    parts = list(mtree.slices([pd.DataFrame({"v": range(103)})], 100))
    assert [len(p) for p in parts] == [20, 20, 20, 20, 20, 3] and sum(p["v"].sum() for p in parts) == 103 * 51
    whole = np.floor(256 * x).astype(int)
    got = {}
    for r in mtree.search(vectors, step=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    for q in range(0, 900, 10):
        score = whole @ whole[q]
        best = sorted((-s, k) for k, s in enumerate(score.tolist()) if k != q)[:5]
        assert got[q] == {n + 1: (k, -s) for n, (s, k) in enumerate(best)}
