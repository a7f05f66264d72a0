"""The report grammar, bulletins, resolution, route verdicts and voices on small cases with known answers."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import bulletins, places, reads, reports, voices
from tidemark.registry import QUERIES

CASES = [
    ("حوارة سالك ولا زحمه", "assertion", {("both", "flow", "open")}), ("حوارة ومش سالك", "assertion", {("both", "flow", "closed")}), ("لا مسكر حوارة", "assertion", {("both", "flow", "closed")}),
    ("بعد ما سكروا حوارة", "assertion", {("both", "flow", "closed")}), ("زي ما هو مسكر", "assertion", {("both", "flow", "closed")}), ("ما فيه جيش على الحاجز", "assertion", {("both", "absence", "idf")}),
    ("مافي ازمه عورتا", "assertion", {("both", "flow", "open")}), ("الجيش واقف على المدخل", "assertion", {("both", "presence", "idf")}), ("فتحوا النار عند حوارة", "assertion", {("both", "presence", "idf")}),
    ("عنبتا 🔴 تفتيش للخارج، سالك للداخل", "assertion", {("outbound", "presence", "inspection"), ("inbound", "flow", "open")}), ("العبيدية للداخل سالك للخارج ازمة", "assertion", {("inbound", "flow", "open"), ("outbound", "flow", "congested")}),
    ("سالكه للداخل والخارج", "assertion", {("both", "flow", "open")}), ("عورتا ازمه وسالك", "assertion", {("both", "flow", "congested")}), ("رفعوا الاغلاق عن حوارة", "assertion", {("both", "flow", "open")}),
    ("شرطه وجيش على حوارة", "assertion", {("both", "presence", "police"), ("both", "presence", "idf")}), ("لو سكروا حوارة بنرجع", "unparsed", set()), ("كيف حوارة", "question", set()), ("حدا بيعرف وضع عورتا الان يا شباب", "question", set()),
    ("حوارة؟", "question", set()), ("", "unparsed", set()), ("🟢", "assertion", {("both", "flow", "open")}), ("عورتا ✅❌", "assertion", {("both", "flow", "closed")}), ("حومش سالك", "assertion", {("both", "flow", "open")}), ("المربعه في حاجز", "assertion", {("both", "presence", "idf")}),
]


#: Lines with the words of roads in their setting.
CASES += [
    ("الحاجزين مغلقان", "assertion", {("both", "flow", "closed")}), ("حوارة ممنوع الدخول", "assertion", {("inbound", "flow", "closed")}), ("زعترة منعوا الخروج", "assertion", {("outbound", "flow", "closed")}),
    ("اللبن في محسوم", "assertion", {("both", "presence", "idf")}), ("صرة حطوا حاجز", "assertion", {("both", "presence", "idf")}), ("المدخل مزطوم", "assertion", {("both", "flow", "congested")}),
    ("البوابات مسكرات", "assertion", {("both", "flow", "closed")}), ("ماكو جيش", "assertion", {("both", "absence", "idf")}), ("الجيش تحت الجسر ومنعو المرور بالاتجاهين", "assertion", {("both", "presence", "idf"), ("both", "flow", "closed")}),
    ("وفتحوا النار عند حوارة", "assertion", {("both", "presence", "idf")}), ("مين متاكد من عورتا", "question", set()), ("مش عارف وضع حوارة", "question", set()), ("حوارة 🟩", "assertion", {("both", "flow", "open")}), ("حوارة 🚫", "assertion", {("both", "flow", "closed")}),
    ("شالوا المكعبات عن صرة", "assertion", {("both", "flow", "open")}), ("انفكت الازمه", "assertion", {("both", "flow", "open")}), ("عين شبلي بطيء عالاتجاهين", "assertion", {("both", "flow", "slow")}), ("بدها تسكر حوارة", "unparsed", set()),
]
WORDS = [(f"حوارة {w}", ("both", axis, v)) for axis, words in (("flow", reports.FLOW), ("presence", reports.PRESENCE)) for v, ws in words.items() for w in ws]
WORDS += [(f"حوارة {w} {d}", (way, "flow", v)) for v, ws in reports.FLOW.items() for w in ws[:3] for way, ds in reports.DIRECTION.items() for d in ds]
WORDS += [(f"حوارة {p}", (reports.PHRASE_DIRECTION.get(p.split()[-1], "both"), axis, v)) for p, axis, v in reports.PHRASES]


def test_every_word_in_a_line(spark):
    assert len({x for x, _ in WORDS}) > 400
    got = {}
    for r in reports.readings(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WORDS)], "id long, text string")).collect():
        got.setdefault(r.id, set()).add((r.direction, r.axis, r.value))
    wrong = {WORDS[k][0]: (v, WORDS[k][1]) for k, v in got.items() if v != {WORDS[k][1]}}
    assert not wrong, sorted(wrong.items())


@pytest.fixture(scope="module")
def read(spark):
    lines = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(CASES)] + [(900, None)], "id long, text string")
    got = {}
    for r in reports.readings(lines.where("text IS NOT NULL")).collect():
        got.setdefault(r.id, (r.modality, set()))[1].add((r.direction, r.axis, r.value))
    return {k: (m, f - {(None, None, None)}) for k, (m, f) in got.items()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_report_line(read, k):
    assert read[k] == CASES[k][1:]


def test_verdicts(spark):
    routes = spark.createDataFrame([(k, 31.0, 35.0 + k, 31.2, 35.0 + k) for k in range(5)], "route long, y1 double, x1 double, y2 double, x2 double")  # 22 km each
    gates = [(100 * k + j, 31.0 + 0.04 * j, 35.0 + k + 0.0005) for k in range(5) for j in range(6)] + [(999, 31.0, 39.02)]  # 999: off the fifth route's end
    values = {0: "open", 1: "slow", 2: "unknown", 3: "open", 4: "open"}
    states = [(100 * k + j, values[k]) for k in range(5) for j in range(6) if k != 2] + [(999, "closed")]
    states = [(i, "closed" if i == 302 else v) for i, v in states]
    got = places.verdicts(routes, spark.createDataFrame(gates, "id long, lat double, lon double"), spark.createDataFrame(states, "id long, value string"))
    assert {r.route: (r.verdict, r.checkpoints) for r in got.collect()} == {0: ("likely_open", 6), 1: ("slow", 6), 2: ("unknown", 6), 3: ("blocked", 6), 4: ("unverified", 6)}
    alone = places.verdicts(routes, spark.createDataFrame([(0, 31.0, 35.0)], "id long, lat double, lon double"), spark.createDataFrame([(0, "open")], "id long, value string"))
    assert {r.route: r.verdict for r in alone.collect()} == {0: "unverified", 1: "unknown", 2: "unknown", 3: "unknown", 4: "unknown"}


def test_similar_is_complete(spark):
    import itertools

    names = [f"{a} {b}" for a in ("beit salim", "beit salem", "deir awad", "dair awad") for b in ("north", "nort", "gate")]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.trigrams(F.col("n")).alias("g"))
    sets = {r.n: set(r.g) for r in df.collect()}
    for least in (0.4, 0.55, 0.8):
        got = {(r.a, r.b) for r in X.similar(df.select(F.col("n").alias("a"), F.col("g").alias("ga")), df.select(F.col("n").alias("b"), F.col("g").alias("gb")), least).collect()}
        assert got == {(a, b) for a, b in itertools.product(names, names) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_polyline(spark):
    r = spark.range(1).select(places.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), 1e5).alias("p")).first()  # the format's published example
    assert [(round(p.lat, 5), round(p.lon, 5)) for p in r.p] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_accepted_totals(spark):
    rows = [(1, d, t, None) for d, t in enumerate([1000, 1005, 1730, 1009, None, 1004, 900, 1010])]
    got = {r.day: r.verdict for r in bulletins.accepted(spark.createDataFrame(rows, "series long, day long, total long, line long")).collect()}
    assert got == {0: "accepted", 1: "accepted", 2: "refused: implausible jump", 3: "accepted", 4: "refused: schema", 5: "accepted: revised down", 6: "refused: not monotonic", 7: "accepted"}


def test_advisory_and_occurrence(spark):
    case = lambda *v: spark.range(1).select(reads.advisory(*[F.lit(x).cast("double") for x in v]).alias("a")).first().a
    assert [case(43, 20, 0, 0), case(30, 0, 0, 0), case(30, 10, 5, 70), case(38, 10, 0, 0), case(20, 4, 0, 0), case(20, 10, 10, 0), case(20, 10, 0, 70), case(None, None, None, None)] == ["extreme_heat", "frost", "storm", "heat_wave", "cold", "rain", "high_wind", "normal"]


def test_mirrors_and_ratio(spark):
    base = "the army entered the town this morning and left before noon"
    rows = [(1, 0, "a", base), (1, 1, "b", base + "."), (1, 2, "c", "two shops opened in the market"), (2, 0, "a", base), (2, 1, "a", base), (3, 0, "a", None), (3, 1, "b", "")]
    got = {r.cluster: (r.units, r.voices) for r in voices.collapsed(spark.createDataFrame(rows, "cluster long, at long, unit string, text string")).collect()}
    assert got == {1: (3, 2), 2: (1, 1), 3: (2, 2)}
    r = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(voices.ratio("a", "b").alias("r")).collect()
    assert r[0].r == pytest.approx(SequenceMatcher(None, "abcd", "bcde").ratio()) and r[1].r is None


def test_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{d}/conversations.parquet").collect()}
    before = {}
    for c, t in sorted(turns):
        before[c, t] = max(((x, y) for x, y in turns if x == c and y < t), default=None)
    for r in QUERIES["fn_seqmatch"](spark, d).collect():
        assert r.ratio == pytest.approx(SequenceMatcher(None, turns[before[r.conv_id, r.turn]][:300], turns[r.conv_id, r.turn][:300]).ratio(), abs=1e-6)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from tidemark.sources.analogues import HOUR
    from tidemark.streaming import events

    schema = "place_id long, direction string, value string, t long, obs_id long"
    source, out = str(tmp_path / "in"), {k: str(tmp_path / k) for k in ("changes", "belief")}
    runs = [[(1, "both", "open", 0, 1), (2, "both", "closed", 0, 2)], [(1, "both", "open", HOUR, 3), (2, "both", "open", 2 * HOUR, 4), (1, "both", "closed", 0, 0)], [(1, "both", "slow", 9 * HOUR, 5)]]
    for rows in runs:  # the last row of the second run is late
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed = lambda: spark.readStream.schema(schema).parquet(source)
        changed = events.changes(feed(), out["changes"], expire=4 * HOUR)
        now = events.refresh(feed(), out["belief"])
    got = sorted((r.place_id, r.t // HOUR, r.value) for r in changed.collect())
    assert got == [(1, 0, "open"), (1, 5, "unknown"), (1, 9, "slow"), (2, 0, "closed"), (2, 2, "open"), (2, 6, "unknown")]
    assert {(r.place_id, r.value, r.t // HOUR) for r in now.collect()} == {(1, "slow", 9), (2, "open", 2)}


def test_names_of_any_length_inside_a_text(spark):
    g = spark.createDataFrame([(1, "beit al salim of the six long words", "road"), (2, "salim", "locality")], "id long, name string, kind string")
    m = spark.createDataFrame([(1, "they say beit al salim of the six long words is shut today"), (2, "near salim today")], "id long, text string")
    assert {r.id: (r.place, r.rung) for r in places.resolve(m, g).collect()} == {1: (1, "contains"), 2: (2, "contains")}
