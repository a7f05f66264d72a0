"""One-to-one matching of card readings against its definition."""

import random

from tidemark.operators import cards


def pieces(x):
    return {x[k : k + 2] for k in range(max(1, len(x) - 1))}


def test_matching_is_the_greedy_one(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 7)))
    stations = [(f"s{r}{k}", r, word()) for r in range(3) for k in range(8)]
    readings = []
    for card in range(6):
        region = card % 3
        for turn in range(2):
            for name in {(n[: (i := rnd.randrange(len(n)))] + rnd.choice("abcde") + n[i + 1 :]) for _, r, n in stations if r == region}:
                readings.append((card, region, turn, name, ["diesel"] if turn else ["gasoline"], "queue" if turn else None))
    got = cards.merged(spark.createDataFrame(readings, "card int, region int, pass int, name string, fuels array<string>, crisis string"), spark.createDataFrame(stations, "station string, region int, name string"), 0.5).collect()
    want = {}
    for card in range(6):
        for turn in range(2):
            mine = [r for r in readings if r[0] == card and r[2] == turn]
            pairs = sorted((-round(2 * len(pieces(r[3]) & pieces(n)) / (len(pieces(r[3])) + len(pieces(n))), 9), r[3], s) for r in mine for s, region, n in stations if region == r[1])
            names, taken = {}, set()
            for score, name, s in pairs:
                if -score >= 0.5 and name not in names and s not in taken:
                    names[name] = s
                    taken.add(s)
            for r in mine:
                key = (card, names.get(r[3]), None if r[3] in names else r[3])
                want.setdefault(key, set()).add(turn)
    assert {(r.card, r.station, None if r.station else r.name): r.passes for r in got} == {k: len(v) for k, v in want.items()}
    assert any(r.station is None for r in got) and any(r.passes == 2 for r in got)
    assert all(r.fuels == ["diesel", "gasoline"] and r.crisis == "queue" for r in got if r.passes == 2)
