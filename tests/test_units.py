"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decay, stats, text
from tidemark.operators import belief, learn, temporal
from tidemark.plans import spec
from tidemark.sources.analogues import AS_OF, MINUTE


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("lives,conf,band", [(-1, 0.9, "live"), (0, 0.9, "live"), (1, 0.45, "recent"), (8, 0.9 / 256, "expired"), (60, 0.9 * 0.5**60, "expired"), (61, 0.0, "expired")])
def test_decay(spark, lives, conf, band):
    age, hl = F.lit(lives * 100 * 1_000_000), F.lit(100.0)
    r = one(spark, c=decay.state_confidence(F.lit(0.9), age, hl), b=decay.staleness_band(age, hl))
    assert r.c == pytest.approx(conf) and r.b == band


def obs(spark, rows):
    return spark.createDataFrame([(k, 1, "flow", d, v, AS_OF - m * MINUTE, s, "assertion") for k, (d, v, m, s) in enumerate(rows)], "obs_id long, place_id long, kind string, direction string, value string, t long, source_id long, modality string")


def src(spark, rows):
    return spark.createDataFrame(rows, "source_id long, source_kind string, unit string, trust double")


def test_noisy_or_is_capped_and_weak_units_only_raise(spark):
    s = src(spark, [(1, "telegram", "a", None), (2, "telegram", "b", None), (3, "crowd", "c", None)])
    two = belief.belief(obs(spark, [("both", "open", 5, 1), ("both", "open", 1, 2)]), s).first()
    assert two.base_confidence == pytest.approx(0.97) and two.agree == 2
    weak = belief.belief(obs(spark, [("both", "open", 5, 1), ("both", "open", 1, 3)]), s).first()
    assert weak.base_confidence == pytest.approx(1 - 0.15 * 0.83)


def test_a_weak_crowd_report_does_not_displace_a_reading(spark):
    s = src(spark, [(1, "telegram", "a", None), (3, "crowd", "c", None)])
    r = belief.belief(obs(spark, [("both", "open", 5, 1), ("both", "closed", 1, 3)]), s).first()
    assert (r.value, r.disagree) == ("open", 1)
    alone = belief.belief(obs(spark, [("both", "open", 1, 3)]), s).first()
    assert alone.withheld


def test_directions(spark):
    s = src(spark, [(1, "telegram", "a", None)])
    served = belief.serve(belief.belief(obs(spark, [("inbound", "closed", 1, 1), ("outbound", "open", 2, 1)]), s))
    assert {r.way: r.value for r in belief.by_direction(served).collect()} == {"inbound": "closed", "outbound": "open", "both": "closed"}
    lone = belief.serve(belief.belief(obs(spark, [("inbound", "open", 1, 1)]), s))
    assert {r.way: r.value for r in belief.by_direction(lone).collect()} == {"inbound": "open", "both": "unknown"}


def test_supersede(spark):
    held = spark.createDataFrame([(1, "a", 0, None), (2, "b", 0, None), (3, "c", 0, None), (4, "d", 0, 5)], "k long, v string, sys_from long, sys_to long")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (5, "e")], "k long, v string")
    got = {tuple(r) for r in temporal.supersede(held, new, ["k"], ["v"], 9, complete=True, max_absent=0.5).collect()}
    assert got == {(1, "a", 0, None), (2, "b", 0, 9), (2, "x", 9, None), (3, "c", 0, 9), (4, "d", 0, 5), (5, "e", 9, None)}
    with pytest.raises(ValueError):
        temporal.supersede(held, new, ["k"], ["v"], 9, complete=True)


def test_as_of_is_half_open(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 5, None), (3, 6, None), (4, 5, 5)], "k long, sys_from long, sys_to long")
    assert sorted(r.k for r in df.where(temporal.valid_at(5)).collect()) == [2]


def test_last_other_unit(spark):
    s = src(spark, [(1, "telegram", "a", None), (2, "telegram", "b", None)])
    rows = [("both", "open", 50, 1), ("both", "closed", 40, 2), ("both", "open", 30, 2), ("both", "slow", 20, 2), ("both", "open", 10, 1)]
    got = {r.obs_id: (r.pv, r.pu) for r in learn.last_other_unit(obs(spark, rows), s).collect()}
    assert got == {0: (None, None), 1: ("open", "a"), 2: ("open", "a"), 3: ("open", "a"), 4: ("slow", "b")}


def test_others_tie_scores_nobody(spark):
    v = spark.createDataFrame([(1, "in", 0, "a", "x"), (1, "in", 0, "b", "y"), (1, "in", 0, "c", "x")], "place_id long, way string, bucket long, unit string, value string")
    assert {r.unit: r.others for r in learn.consensus_of_others(v).collect()} == {"a": None, "b": "x", "c": None}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (9, 8), (8, 7), (7, 6)], "a long, b long")
    assert {r.node: r.root for r in learn.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}


def test_wilson_and_fisher(spark):
    low, high = stats.wilson(F.lit(1), F.lit(1))
    a, b = stats.fisher_interval(F.lit(0.5), F.lit(28))
    r = one(spark, low=low, high=high, a=a, b=b)
    assert r.low == pytest.approx(0.2065, abs=1e-3) and r.high == 1 and (round(r.a, 3), round(r.b, 3)) == (0.156, 0.736)


def test_spec(spark):
    df = spark.createDataFrame([("a", "2020-05-06"), (None, "2024-01-31"), ("", None)], "x string, d string")
    got = df.select(spec.condition({"field": "x", "ne": "b"}).alias("n"), spec.condition({"field": "x", "absent": True}).alias("a"), spec.template("p.{x}.q").alias("t"), spec.resolve_date([{"field": "d", "precision": "month"}], "2024-01-01")["precision"].alias("p")).collect()
    assert [tuple(r) for r in got] == [(True, False, "p.a.q", "month"), (False, True, "p.q", "unknown"), (True, True, "p.q", None)]
    s = spec.Spec("i", "v", [{"field": "d", "precision": "day"}], identity=("k",), min_records=3)
    rows = spec.transform(spark.createDataFrame([(1, 2.0, "2020-01-01"), (1, 3.0, "2020-01-01")], "k int, v double, d string"), s, "2024-01-01")
    with pytest.raises(spec.Refused, match="records.*identities"):
        spec.enforce(rows, s)


def test_text(spark):
    r = one(spark, n=text.normalize(F.lit("  Ab--C!  ")), t=text.jaccard(text.trigrams(F.lit("word")), text.trigrams(F.lit("words"))), d=text.dice(text.grams(F.lit("night"), 2), text.grams(F.lit("nacht"), 2)), m=text.repair_mojibake(F.lit("cafÃ©")), k=text.has_token(F.lit("a bc d"), F.lit("bc")))
    assert (r.n, round(r.d, 2), r.m, r.k) == ("ab c", 0.25, "café", True) and r.t == pytest.approx(4 / 7)


def test_throttle_and_changes_hold_no_history(spark):
    """A place with most rows arrives in many batches, and none of them is given to Python as a whole."""
    from tidemark.streaming import events

    n, before = 30_000, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(n).selectExpr("if(id % 10 = 0, id % 3 + 2, 1) AS place_id", "id AS obs_id", "id * 7919 % 30011 * 60000000 AS t", "if(id % 50 < 48, 'a', 'b') AS value")
    want, changed, state, last = set(), set(), {}, {}
    for p, i, t, v in sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[2], r[1])):
        if p not in state or state[p][1] != v or t - state[p][0] >= 1_800_000_000:
            state[p] = (t, v)
            want.add(i)
        if last.get(p) != v:
            changed.add((p, t, v))
            last[p] = v
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        out = events.throttled(rows)
        assert {r.obs_id for r in out.collect()} == want and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    path = events.new_path(spark, "feed")
    rows.orderBy("t").coalesce(1).write.parquet(path)
    got = events.changes(spark.readStream.schema(rows.schema).parquet(path))
    assert not got.isStreaming and {tuple(r) for r in got.collect()} == changed


def test_backup_reports_lost_rows(spark):
    import pathlib

    from tidemark.operators import composites

    tables, path = {n: spark.range(0, 100, 1, 4).toDF("k") for n in ("orders", "events")}, composites.new_path(spark, "backup")
    composites.backup(tables, path)
    check = lambda: {r.name: (r.n, r.ok) for r in composites.restore_check(tables, path).collect()}
    assert check() == {"orders": (100, True), "events": (100, True)}
    next(pathlib.Path(path.removeprefix("file://"), "orders").glob("part-*.parquet")).unlink()
    assert check() == {"orders": (75, False), "events": (100, True)}
