"""Copying sources, loads, sessions with state, deltas, corridors, polygons, daily sketches."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import copying, corridors, deltas, polygons, sketches
from tidemark.plans.load import Contract, Rule, Table, load
from tidemark.plans.spec import Refused
from tidemark.plans.steps import new_path
from tidemark.sources.analogues import DAY, MINUTE
from tidemark.streaming import sessions

# ---- who repeats whom


def text(k, changed=0):
    words = [f"w{k}x{i}" for i in range(20)]
    return " ".join(words[: 20 - changed] + [f"new{k}{i}" for i in range(changed)])


def test_copier_copied_and_two_independent_sources(spark):
    rows = []
    for k in range(40):
        at = k * 500 * MINUTE
        rows += [(4 * k, "first", at, text(k)), (4 * k + 1, "second", at + 30 * MINUTE, text(k, k % 4)), (4 * k + 2, "alone", at + 10 * MINUTE, text(1000 + k)), (4 * k + 3, "later", at + 61 * MINUTE, text(k) if k < 10 else text(2000 + k))]
    rows += [(9001, "alone", None, text(1)), (9002, None, 5, text(1)), (9003, "alone", 7, "one two"), (9004, "second", 8, None)]
    rates = {(r.b, r.a): (r.matches, r.total) for r in copying.copy_rates(spark.createDataFrame(rows, "id long, source string, t long, text string")).collect()}
    # the later source is over an hour behind the first, but within an hour of the second
    assert rates == {("second", "first"): (40, 40), ("later", "second"): (sum(k % 4 < 4 for k in range(10)), 40)}
    frame = spark.createDataFrame([(*k, *v, v[0] / v[1]) for k, v in rates.items()], "b string, a string, matches long, total long, rate double")
    assert {(r.node, r.root) for r in copying.independence_groups(frame).collect()} == {("first", "first"), ("second", "first")}


def test_copies_at_the_interval_ends_and_among_many(spark):
    hour = 60 * MINUTE
    rows = [(1, "a", 10 * hour, text(1)), (2, "b", 11 * hour, text(1)), (3, "c", 11 * hour + 1, text(1)), (4, "d", 10 * hour - 5 * MINUTE, text(1)), (5, "e", 10 * hour - 5 * MINUTE + 1, text(1))] + [(100 + k, f"s{k % 3}", 10**15 + k, text(7)) for k in range(300)]
    got = {(r.b, r.a): r.matches for r in copying.copy_rates(spark.createDataFrame(rows, "id long, source string, t long, text string")).collect()}
    assert ("b", "a") in got and ("c", "a") not in got and ("d", "a") not in got and ("e", "a") in got
    assert all(got[f"s{i}", f"s{j}"] == 100 for i in range(3) for j in range(3) if i != j)


# ---- loads

ROW = "dataset string, stable_id string, identity string, content string, seq long, located boolean, drop string"
RULES = Contract({"d": Rule(complete=True, max_absent=1, collisions=2), "k": Rule(indistinguishable=True)}, min_records=1, drops=("known",))


def rows_of(spark, *rows):
    return spark.createDataFrame([(d, s, i, c, n, True, x) for n, (d, s, i, c, x) in enumerate(rows)], ROW)


@pytest.fixture
def loaded(spark):
    first = rows_of(spark, ("d", "1", "a", "x", None), ("d", "2", "b", "x", None), ("d", "3", "c", "x", None), ("k", "9", None, "lorry", None), ("k", "10", None, "lorry", None), ("d", "4", "e", "x", "known"))
    t = Table(spark, new_path(spark, "load"), first.schema)
    load(t, first, RULES, 100)
    return t


def test_classes_of_a_load(spark, loaded):
    second = rows_of(
        spark, ("d", "1", "a", "x", None), ("d", "2b", "b", "y", None), ("d", "5", "f", "x", None), ("d", "6", "f", "x", None), ("d", "7", "f", "z", None),
        ("k", "9", None, "lorry", None), ("k", "11", None, "lorry", None), ("d", "5", "f", "x", None),
    )
    report = {(r.dataset, r["class"]): r.n for r in load(loaded, second, RULES, 200).collect()}
    assert report == {("d", "held_same"): 1, ("d", "correction"): 1, ("d", "new"): 1, ("d", "duplicate_in_run"): 1, ("d", "conflict_in_run"): 1, ("k", "refetched"): 1, ("k", "kept_copy"): 1, ("d", "absent_closed"): 1, ("d", "stable_id_repeated"): 1}
    assert sorted((r.stable_id, r.content) for r in loaded.rows("open").collect()) == [("1", "x"), ("10", "lorry"), ("11", "lorry"), ("2b", "y"), ("5", "x"), ("9", "lorry")]
    assert sorted((r.stable_id, r.sys_from, r.sys_to) for r in loaded.rows("closed").collect()) == [("2", 100, 200), ("3", 100, 200)]
    assert sorted(r.stable_id for r in loaded.as_of(150).collect()) == ["1", "10", "2", "3", "9"]
    assert sorted(r.stable_id for r in loaded.rows("open", 1).collect()) == ["1", "10", "2", "3", "9"]  # an older version stays readable


@pytest.mark.parametrize("rows, fallback, says", [
    ([("d", "1", "a", "x", None)], False, "absent"), ([], False, "records"), ([("q", "1", "a", "x", None)], True, "no such dataset"), ([("d", "1", "zz", "x", None)], True, "another identity"),
    ([("d", "1", "a", "x", "odd")], True, "not declared"), ([("d", str(k), "a", str(k), None) for k in range(20, 24)], True, "share an identity"), ([("d", None, "a", "x", None)], True, "without stable id"),
])
def test_refused_loads_change_nothing(spark, loaded, rows, fallback, says):
    df = rows_of(spark, *rows) if rows else spark.createDataFrame([], ROW)
    before = sorted(map(str, loaded.rows("open").collect()))
    with pytest.raises(Refused, match=says):
        load(loaded, df, RULES, 300, fallback)
    assert loaded.version() == 1 and sorted(map(str, loaded.rows("open").collect())) == before


def test_a_fallback_fills_holes_only(spark, loaded):
    report = {r["class"]: r.n for r in load(loaded, rows_of(spark, ("d", "1", "a", "other", None), ("d", "8", "h", "x", None)), RULES, 300, fallback=True).collect()}
    assert report == {"fallback_refused": 1, "new": 1} and loaded.rows("closed").count() == 0


def test_one_writer_at_a_time(spark, loaded):
    with loaded.locked(), pytest.raises(Refused, match="another load"):
        load(loaded, rows_of(spark, ("d", "1", "a", "x", None)), RULES, 300)
    with pytest.raises(Refused, match="there already"):
        loaded.commit({}, 1)


# ---- sessions as state


def reports(seed=0):
    rnd = random.Random(seed)
    return [(f"k{rnd.randint(0, 3)}", n, rnd.randint(1, 400) * MINUTE) for n in range(60)]


def batch_sessions(rows, gap):
    out = set()
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        out |= {(key, *x[:3]) for x in sessions.chained(np.array([r[2] for r in own]), np.array([r[1] for r in own]), gap)}
    return out


def test_two_runs_from_one_checkpoint_equal_one_batch(spark, tmp_path):
    rows = reports()
    got = {}
    for name, parts in (("one", [rows]), ("two", [rows[:25], rows[25:]])):
        source, path = tmp_path / name, new_path(spark, name)
        for part in parts:
            pd.DataFrame(part, columns=["key", "id", "t"]).pipe(spark.createDataFrame).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema("key string, id long, t long").parquet(str(source))
            out = sessions.event_sessions(stream, path, 10 * MINUTE, "2 days")
        got[name] = {(r.key, r.first, r.last, r.n) for r in out.collect()}
        names = [r.event for r in out.collect()]
        assert len(set(names)) == len(names)
    assert got["one"] == got["two"] == batch_sessions(rows, 10 * MINUTE)


def test_a_late_report_bridges_and_time_closes(spark, tmp_path):
    source, path = tmp_path / "in", new_path(spark, "bridge")
    at = DAY
    steps = [[("k", 1, at), ("k", 2, at + 100 * MINUTE)], [("k", 3, at + 50 * MINUTE)], [("other", 4, 10 * at)], [("other", 5, 10 * at)]]
    seen = []
    for part in steps:
        pd.DataFrame(part, columns=["key", "id", "t"]).pipe(spark.createDataFrame).coalesce(1).write.mode("append").parquet(str(source))
        out = sessions.event_sessions(spark.readStream.schema("key string, id long, t long").parquet(str(source)), path, 60 * MINUTE, "1 hour")
        seen.append({r.event: (r.first, r.last, r.n, r.status) for r in out.where("key = 'k'").collect()})
    first = sessions.event_name("k", at, 1)
    assert len(seen[0]) == 2 and seen[1] == {first: (at, at + 100 * MINUTE, 3, "open")}
    assert seen[-1] == {first: (at, at + 100 * MINUTE, 3, "closed")}


# ---- deltas


def test_retract_and_reassert(spark):
    claims = spark.createDataFrame([(1, "u", "a", "a", "a"), (2, "v", "a", "b", "a"), (3, "u", "c", None, "c"), (4, "w", None, "b", None)], "claim long, unit string, one string, two string, three string")
    verdicts = claims.select("claim", F.lit(1).alias("version"), F.col("one").alias("event"))
    given = claims.where("one IS NOT NULL").groupBy(F.col("one").alias("event"), "unit").agg(F.count(F.lit(1)).alias("n"))
    state = deltas.apply(spark.createDataFrame([], "event string, unit string, n long"), spark.createDataFrame([], "event string, status string, reports long, units long"), given)
    view = lambda df: {r.event: (r.status, r.reports, r.units) for r in df.collect()}
    assert view(state[1]) == {"a": ("live", 2, 2), "c": ("live", 1, 1)}
    verdicts, *state = deltas.rebuild(claims, verdicts, *state, 2, F.col("two"))
    assert view(state[1]) == {"a": ("live", 1, 1), "b": ("live", 2, 2), "c": ("retracted", 0, 0)}
    assert deltas.stale(claims, verdicts, 2).count() == 0
    verdicts, *state = deltas.rebuild(claims, verdicts, *state, 3, F.col("three"))
    assert view(state[1]) == {"a": ("live", 2, 2), "b": ("retracted", 0, 0), "c": ("live", 1, 1)}


# ---- corridors and polygons


def test_lines_of_odd_shapes(spark):
    lines = spark.createDataFrame([(1, [(31.0, 35.0), (31.1, 35.0), (31.1, 35.1)]), (2, [(31.0, 35.0)]), (3, []), (4, None), (5, [(31.0, 35.0), (31.0, 35.0)])], "route int, points array<struct<lat: double, lon: double>>")
    s = {r.route: r for r in corridors.segments(lines).collect()}
    assert set(s) == {1, 2, 5} and s[2].total == s[5].total == 0
    p = spark.createDataFrame([(1, 31.0, 35.0), (2, 31.1, 35.001), (3, 31.05, 35.05)], "id int, lat double, lon double")
    got = {(r.route, r.id): (round(r.m), round(r.along, 3)) for r in corridors.located(corridors.segments(lines), p, 300.0).collect()}
    assert got[1, 1] == (0, 0.0) and got[2, 1] == got[5, 1] == (0, 0.0) and (1, 3) not in got and 0.5 < got[1, 2][1] < 0.56


def test_directions(spark):
    rows = [(1, "both", "open", 10), (1, "inbound", "closed", 5), (2, "both", "open", 10), (2, "inbound", "closed", 10), (3, "outbound", "slow", 1), (4, "inbound", "open", 2), (4, "outbound", "congested", 1)]
    got = {r.id: r.value for r in corridors.reconciled(spark.createDataFrame(rows, "id int, direction string, value string, t long")).collect()}
    assert got == {1: "open", 2: "closed", 3: "slow", 4: "congested"}


@pytest.mark.parametrize("cell", [0.5, 0.05, 0.013])
def test_polygon_cells_by_brute_force(spark, cell):
    rnd = random.Random(8)
    rings = []
    for k in range(25):
        y, x, n = rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.randint(3, 9)
        rings.append((k, [(y + rnd.uniform(0.02, 0.5) * math.sin(2 * math.pi * i / n), x + rnd.uniform(0.02, 0.5) * math.cos(2 * math.pi * i / n)) for i in range(n)]))
    rings += [(100, [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 0.0)]), (101, [(0.2, 0.2), (0.2, 0.2)]), (102, [])]
    points = [(k, rnd.uniform(-1.2, 1.2), rnd.uniform(-1.2, 1.2)) for k in range(600)]

    def inside(lat, lon, ring):
        hit = False
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    got = polygons.containing(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(rings, "poly int, ring array<struct<lat: double, lon: double>>"), cell)
    assert {(r.id, r.poly) for r in got.collect()} == {(p, k) for p, lat, lon in points for k, ring in rings if inside(lat, lon, ring)}


# ---- sketches


def test_sketches_err_by_no_more_than_stated(spark):
    rnd = random.Random(2)
    gaps = [int(rnd.lognormvariate(20, 2)) + 1 for _ in range(3000)]
    at = np.cumsum([0, *gaps])
    counts, last = sketches.daily(spark.createDataFrame([(1, int(t)) for t in at], "feed int, t long"))
    got = sketches.quantiles(counts.groupBy("feed", "bucket").agg(F.sum("n").alias("n")), {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    for share, name in ((0.01, "p1"), (0.5, "p50"), (0.95, "p95"), (1.0, "p100")):
        exact = sorted(gaps)[math.floor(share * (len(gaps) - 1))]
        assert abs(got[name] - exact) <= sketches.ERROR * exact * 1.0001
    assert last.first().t == int(at[-1]) and got.gaps == 3000


def test_refresh_reads_new_days_only_and_once(spark):
    path = new_path(spark, "days")
    rows = spark.createDataFrame([(f, d * DAY + f * 1000 + 7) for f in (1, 2) for d in (1, 2, 4, 5)], "feed int, t long")
    sketches.refresh(path, rows, 2)
    before = sketches.window(path, spark, 0, 9).agg(F.sum("n")).first()[0]
    sketches.refresh(path, rows.where(F.col("t") >= 3 * DAY), 4)  # older days are not needed
    sketches.refresh(path, rows.limit(0), 4)  # done already
    got = {(r.feed, r.bucket): r.n for r in sketches.window(path, spark, 0, 4).collect()}
    assert before == 2 and sum(got.values()) == 4 and len(got) == 4
    assert sketches.window(path, spark, 4, 4).agg(F.sum("n")).first()[0] == 2
