"""Cursors of readers: settled rows only, each once, over restarts and runs that were cut short."""

from pyspark.sql import functions as F

from tidemark.plans.steps import new_path
from tidemark.streaming.readers import Organ


def test_cursor_settles_and_survives(spark, monkeypatch):
    claims = lambda *rows: spark.createDataFrame(rows, "t long, id long, v string")
    path = new_path(spark, "organ")
    organ = lambda: Organ(spark, path, "o", F.col("v") == "x", 10)  # noqa: E731  as after a restart
    first = [(1, 1, "x"), (5, 2, "y"), (5, 3, "x"), (95, 4, "x")]
    assert organ().cursor() == (0, None, None) and organ().advance(claims(*first), 100)
    assert organ().cursor() == (1, 5, 3) and not organ().advance(claims(*first), 100)
    more = [*first, (5, 9, "x"), (4, 8, "x"), (150, 10, "y"), (150, 11, None)]  # id 8 came too late: it had not settled in time
    assert organ().advance(claims(*more), 200)
    assert organ().cursor() == (2, 150, 11)
    assert sorted(r.id for r in organ().rows().collect()) == [1, 3, 4, 9]
    assert [(r.run, r.seen, r.matched) for r in organ().history().orderBy("run").collect()] == [(1, 3, 2), (2, 4, 2)]
    # rows were written, the cursor was not: the run is run again
    late = [*more, (300, 12, "x")]
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: 1 / 0)
    df = spark.range(1).select(F.lit(300).cast("long").alias("t"), F.lit(12).cast("long").alias("id"), F.lit("x").alias("v"))
    try:
        organ().advance(df, 400)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert organ().cursor()[0] == 2 and organ().advance(claims(*late), 400) and sorted(r.id for r in organ().rows().collect()) == [1, 3, 4, 9, 12]
