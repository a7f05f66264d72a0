"""Readings of cards: several passes over one card, each with misread names, become one line a station.

Within a pass a reading is one line of the card, so that readings and stations are matched one to
one: a pair is fixed if neither side has a better one left, round after round, until none is. Better
is: more alike by Dice's share of common two-letter pieces, then the name, then the station that
sorts first; the result is the one that taking pairs in that order gives. Passes are merged by
station: what any pass saw of it is seen, and the number of passes is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.places import fold_for_match
from tidemark.plans.register import query
from tidemark.plans.steps import dropped, written
from tidemark.sources.analogues import table

FLOOR = 0.6


def candidates(readings: DataFrame, stations: DataFrame, floor: float = FLOOR) -> DataFrame:
    """readings: (card, pass, region, name, ...), stations: (station, region, name). Rows (card, pass, name, station, score) of pairs of a region that are alike by floor or more. Different names are compared once a region, and only those of one region that share a rare piece."""
    a = readings.select("card", "pass", "region", "name", fold_for_match(F.col("name")).alias("a"))
    a = written(a.where("a != '' AND region IS NOT NULL").distinct(), "readings")  # names are folded once
    b = written(stations.select("station", "region", fold_for_match(F.col("name")).alias("b")).where("b != '' AND region IS NOT NULL"), "stations")
    names = lambda df, c: written(df.select("region", c).distinct().withColumn(f"g{c}", X.grams(F.col(c), 2)), "names")
    near = X.similar(names(a, "a"), names(b, "b"), floor / (2 - floor), ["region"])
    dice = F.round(2 * F.col("similarity") / (1 + F.col("similarity")), 9)
    return a.join(near.withColumn("score", dice).hint("merge"), ["region", "a"]).join(b.hint("merge"), ["region", "b"]).select("card", "pass", "name", "station", "score")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """pairs: (card, pass, name, station, score). The rows that are matched; a card's longest chain of second choices bounds the rounds."""
    live, fixed = written(pairs, "pairs"), None
    order = F.struct((-F.col("score")).alias("s"), "name", "station")
    while not live.isEmpty():
        done = live
        reading = live.groupBy("card", "pass", "name").agg(F.min(order).alias("r"))
        station = live.groupBy("card", "pass", "station").agg(F.min(order).alias("t"))
        mutual = live.withColumn("o", order).join(reading, ["card", "pass", "name"]).join(station, ["card", "pass", "station"]).where("o = r AND o = t").select(pairs.columns)
        mutual = written(mutual, "matched")
        fixed = mutual if fixed is None else fixed.unionByName(mutual)
        live = live.join(mutual.select("card", "pass", "name"), ["card", "pass", "name"], "left_anti").join(mutual.select("card", "pass", "station"), ["card", "pass", "station"], "left_anti")
        live = written(live.select(pairs.columns), "pairs")
        dropped(done)
    return live if fixed is None else fixed


def merged(readings: DataFrame, stations: DataFrame, floor: float = FLOOR) -> DataFrame:
    """readings also have fuels (array of strings) and crisis (or null). Rows (card, station, name, score, passes, fuels, crisis): matched stations, and readings without one by their name, station null."""
    found = one_to_one(candidates(readings, stations, floor))
    rows = readings.select("card", "pass", "name", "fuels", "crisis").join(found, ["card", "pass", "name"], "left")
    line = F.when(F.col("station").isNull(), F.col("name"))
    best = F.max_by(F.struct("name", "score"), F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("pass")).alias("p"), "name"))
    fuels = F.array_sort(F.array_distinct(F.flatten(F.collect_list("fuels"))))  # as many lists as passes
    g = rows.groupBy("card", "station", line.alias("_line")).agg(best.alias("b"), F.count_distinct("pass").alias("passes"), fuels.alias("fuels"), F.min_by("crisis", F.when(F.col("crisis").isNotNull(), F.col("pass"))).alias("crisis"))
    return g.select("card", "station", "b.name", "b.score", "passes", "fuels", "crisis")


@query("src_fuel_image")
def src_fuel_image(spark, sf_dir):
    """Cards of twenty parts, read three times: as printed, without a letter, with another letter. No SQL: matching in rounds is compared with its definition in the tests."""
    k = F.col("p_partkey")
    stations = table(spark, sf_dir, "part").select(k.alias("station"), F.expr("p_partkey div 20").alias("region"), F.concat_ws(" ", "p_name", F.lower("p_brand"), F.conv(k.cast("string"), 10, 26)).alias("name"))
    read = F.array(F.col("name"), F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")), F.concat(F.substring("name", 1, 5), F.lit("x"), F.expr("substring(name, 7)")))
    rows = stations.select(F.col("region").alias("card"), "region", "station", F.posexplode(read).alias("pass", "name"))
    fuels = F.array_compact(F.array(F.when(F.col("station") % 2 == 0, "diesel"), F.when((F.col("station") + F.col("pass")) % 3 == 0, "gasoline")))
    return merged(rows.select("card", "region", "pass", "name", fuels.alias("fuels"), F.when((F.col("station") % 5 == 0) & (F.col("pass") > 0), "queue").alias("crisis")), stations).withColumn("fuels", F.array_join("fuels", ","))
