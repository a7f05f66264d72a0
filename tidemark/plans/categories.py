"""Category transforms: how a category's records become rows, one to many, with what each drop was for.

Every transform takes records and returns rows (dataset, indicator, at, precision, key, value, unit,
attrs, drop); a dropped record is one row with its reason, so that a run's report counts all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.analogues import table


def row(dataset, indicator, at, precision, key, value, unit=None, attrs: dict[str, Column] | None = None, drop=None) -> Column:
    """One emitted row; attributes that are null are left out."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [y for k, v in (attrs or {}).items() for y in (F.lit(k), v.cast("string"))]
    some = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    text = lambda x, n: lit(x).cast("string").alias(n)
    return F.struct(text(dataset, "dataset"), text(indicator, "indicator"), text(at, "at"), text(precision, "precision"), text(key, "key"), lit(value).cast("double").alias("value"), text(unit, "unit"), some.alias("attrs"), text(drop, "drop"))


def dropped(key: Column, reason: Column) -> Column:
    return row(None, None, None, None, key, None, drop=reason)


def emit(records: DataFrame, drop: Column, *rows: tuple[Column, Column]) -> DataFrame:
    """Fans records out: of rows (when, row) those whose condition holds; where drop is not null, or nothing is left, one dropped row."""
    key = F.col("key")
    made = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), r) for when, r in rows]))
    made = F.when(drop.isNotNull(), F.array(dropped(key, drop))).when(F.size(made) == 0, F.array(dropped(key, F.lit("no_metrics")))).otherwise(made)
    return records.select(F.explode(made).alias("r")).select("r.*")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


# ---- the categories' own rules


def demolitions(r: DataFrame) -> DataFrame:
    """(key, dimension, date, demolished, displaced, affected, locality, governorate): up to three rows a record; only yearly totals have a date."""
    annual = F.col("dimension") == "annual_total"
    at, precision = F.when(annual, F.concat(F.substring("date", 1, 4), F.lit("-01-01"))).otherwise("2009-01-01"), F.when(annual, "year").otherwise("unknown")
    attrs = {"coverage_start": F.when(~annual, F.lit("2009-01-01")), "locality_name": F.when(F.col("dimension") == "locality", F.col("locality")), "governorate": F.when(F.col("dimension") == "locality", F.col("governorate"))}
    one = lambda name, unit: row("demolitions", F.concat(F.lit("demolitions."), slug(F.col("dimension")), F.lit("." + name)), at, precision, F.concat("key", F.lit(":" + name)), F.col("demolished" if name == "structures" else name), unit, attrs)
    return emit(r, F.when(F.col("dimension").isNull(), "unroutable"), (F.col("demolished").isNotNull(), one("structures", "structures")), (F.col("displaced") > 0, one("displaced", "persons")), (F.col("affected") > 0, one("affected", "persons")))


def connectivity(r: DataFrame) -> DataFrame:
    """(key, date, outage_source, seconds, measurements, rate): told apart by shape, an outage or a day's measurements; anything else is a drop."""
    outage, day = F.col("outage_source").isNotNull(), F.col("measurements") > 0
    return emit(
        r, F.when(~F.coalesce(outage | day, F.lit(False)), "unrecognised_shape"), (outage, row("outages", "connectivity.internet_outage", F.col("date"), "hour", F.col("key"), F.col("seconds"), "seconds", {"source": F.col("outage_source")})),
        (~outage & day, row("measurements", "connectivity.censorship_measurement", F.substring("date", 1, 10), "day", F.col("key"), F.col("rate"), "measurements", {"count": F.col("measurements")})),
    )


def economic(r: DataFrame) -> DataFrame:
    """(key, publisher, code, date, region, value, unit): a pass over the whole category finds keys that a publisher states twice; none of them is kept."""
    w = Window.partitionBy("publisher", "code", F.substring("date", 1, 10), "region")
    r = r.withColumn("same", F.count(F.lit(1)).over(w))
    drop = F.when((F.col("publisher") == "direct") & (F.col("same") > 1), "contradictory_duplicate")
    return emit(r, drop, (F.lit(True), row(F.concat(F.lit("economic_"), "publisher"), F.concat(F.lit("economic."), slug(F.col("code"))), F.concat(F.substring("date", 1, 4), F.lit("-01-01")), "year", F.col("key"), F.col("value"), F.when(F.col("publisher") != "imf", F.col("unit")), {"region": F.col("region")})))


#: Units as sources write them, and as they are kept.
UNITS = {"truck": "trucks", "truckload": "trucks", "mt": "tonnes", "ton": "tonnes", "pallet": "pallets"}


def aid_access(r: DataFrame) -> DataFrame:
    """(key, date, cargo, quantity, unit, crossing): units made canonical, the raw one kept beside; later days are marked as partial upstream."""
    canon = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower("unit")), F.col("unit"))
    attrs = {"unit_raw": F.when(canon != F.col("unit"), F.col("unit")), "upstream_partial": F.when(F.col("date") > "1999-05-05", F.lit("true")), "crossing": F.col("crossing")}
    return emit(r, F.lit(None).cast("string"), (F.lit(True), row("aid", F.concat(F.lit("aid_access.consignment."), slug(F.col("cargo"))), F.col("date"), "day", F.col("key"), F.col("quantity"), canon, attrs)))


def historical(r: DataFrame, censuses: list[str]) -> DataFrame:
    """(key, date, status, population_<year> ...): a row a census with people in it, and one for what became of the place."""
    one = lambda y: (F.col(f"population_{y}") > 0, row("localities", "historical.population", f"{y}-01-01", "year", F.concat("key", F.lit(f":c{y}")), F.col(f"population_{y}"), "persons", {"census": F.lit(y)}))
    reference = F.col("date") == "1945-04-01"
    last = row("localities", "historical.locality_status", F.when(reference, "1945-01-01").otherwise(F.col("date")), F.when(reference, "year").otherwise("day"), F.concat("key", F.lit(":status")), None, None, {"status": F.col("status")})
    return emit(r, F.lit(None).cast("string"), *[one(y) for y in censuses], (F.lit(True), last))


def running_totals(r: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(key, series, date, source, fields ...): days that only carry the last values on are padding; a day that a bulletin gives, or on which a value moves, is kept."""
    w = Window.partitionBy("series").orderBy("date", "key")
    now = F.to_json(F.struct(*fields))
    r = r.withColumn("now", now).withColumn("before", F.lag("now").over(w))
    padding = (F.col("source") != "un") & F.col("before").isNotNull() & (F.col("now") == F.col("before"))
    drop = F.when(F.col("date").isNull(), "missing_date").when(padding, "fill_padding")
    return emit(r, drop, *[(F.col(f).isNotNull(), row("totals", ind, F.col("date"), "day", F.concat("key", F.lit(":" + f)), F.col(f), "persons", {"cumulative": F.lit("true"), "source": F.col("source")})) for f, ind in fields.items()])


def cut_over(r: DataFrame, since: str, known: list[str]) -> DataFrame:
    """(key, date, source, killed, injured): rows from a day on; what the publisher inferred, and sources nobody has declared, are drops."""
    drop = F.when(F.col("date").isNull(), "missing_date").when(F.col("date") < since, "before_cutover").when(F.col("killed").isNull() & F.col("injured").isNull(), "no_cumulative").when(F.col("source") == "missing", "inferred").when(~F.col("source").isin(known), "unknown_source")
    return emit(r, drop, *[(F.col(f).isNotNull(), row("daily", f"conflict.cumulative_{f}", F.col("date"), "day", F.concat("key", F.lit(":" + f)), F.col(f), "persons", {"source": F.col("source")})) for f in ("killed", "injured")])


def run_report(rows: DataFrame) -> DataFrame:
    """A line of a run's report for every dataset, indicator and reason: rows, different keys, share with a decided date."""
    decided = F.avg((F.col("precision") != "unknown").cast("double"))
    return rows.groupBy("dataset", "indicator", "drop").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"), F.round(decided, 6).alias("decided"), F.round(F.sum("value"), 2).alias("total"))


# ---- their queries: records derived from orders; the SQL says what the report must be


def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("cust"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def _sql(*rows: str, extra: str = "") -> str:
    o = "o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS cust, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS price, o_orderpriority AS priority FROM orders)"
    return f"WITH {o}{extra}, r AS (" + " UNION ALL ".join(rows) + ") SELECT dataset, indicator, drop, count(*) AS rows, count(DISTINCT key) AS keys, round(avg(CASE WHEN precision IS NULL THEN NULL WHEN precision <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS decided, round(sum(value), 2) AS total FROM r GROUP BY ALL"


_S = "SELECT {} AS dataset, {} AS indicator, {} AS drop, {} AS key, {} AS precision, CAST({} AS DOUBLE) AS value FROM {} WHERE {}"
_DIM = "CASE k % 4 WHEN 0 THEN 'annual_total' WHEN 1 THEN 'locality' WHEN 2 THEN 'By Region' END"
_DSL = "CASE k % 4 WHEN 0 THEN 'annual_total' WHEN 1 THEN 'locality' WHEN 2 THEN 'by_region' END"
_PREC = "CASE WHEN k % 4 = 0 THEN 'year' ELSE 'unknown' END"


@query("etl_demolitions", _sql(
    _S.format("'demolitions'", f"'demolitions.' || {_DSL} || '.structures'", "NULL", "key || ':structures'", _PREC, "k % 9", "o", "k % 4 < 3 AND k % 5 <> 0"), _S.format("'demolitions'", f"'demolitions.' || {_DSL} || '.displaced'", "NULL", "key || ':displaced'", _PREC, "k % 3", "o", "k % 4 < 3 AND k % 3 > 0"),
    _S.format("'demolitions'", f"'demolitions.' || {_DSL} || '.affected'", "NULL", "key || ':affected'", _PREC, "k % 7", "o", "k % 4 < 3 AND k % 7 > 0"), _S.format("NULL", "NULL", "'unroutable'", "key", "NULL", "NULL", "o", "k % 4 = 3"), _S.format("NULL", "NULL", "'no_metrics'", "key", "NULL", "NULL", "o", "k % 4 < 3 AND k % 5 = 0 AND k % 3 = 0 AND k % 7 = 0"),
))
def etl_demolitions(spark, sf_dir):
    k = F.col("k")
    dim = F.when(k % 4 == 0, "annual_total").when(k % 4 == 1, "locality").when(k % 4 == 2, "By Region")
    r = _orders(spark, sf_dir).select("key", "date", dim.alias("dimension"), F.when(k % 5 != 0, k % 9).alias("demolished"), (k % 3).alias("displaced"), (k % 7).alias("affected"), F.lit("place").alias("locality"), F.lit("gov").alias("governorate"))
    return run_report(demolitions(r))


@query("etl_connectivity", _sql(
    _S.format("'outages'", "'connectivity.internet_outage'", "NULL", "key", "'hour'", "price", "o", "k % 3 = 0"), _S.format("'measurements'", "'connectivity.censorship_measurement'", "NULL", "key", "'day'", "k % 100 / 100.0", "o", "k % 3 = 1 AND k % 5 > 0"),
    _S.format("NULL", "NULL", "'unrecognised_shape'", "key", "NULL", "NULL", "o", "k % 3 = 2 OR (k % 3 = 1 AND k % 5 = 0)"),
))
def etl_connectivity(spark, sf_dir):
    k = F.col("k")
    r = _orders(spark, sf_dir).select("key", "date", F.when(k % 3 == 0, "bgp").alias("outage_source"), F.col("price").alias("seconds"), F.when(k % 3 == 1, k % 5).alias("measurements"), (k % 100 / 100.0).alias("rate"))
    return run_report(connectivity(r))


_PUB = "CASE k % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'imf' ELSE 'bank' END"


@query("etl_economic", _sql(
    _S.format(f"'economic_' || {_PUB}", "'economic.' || trim(regexp_replace(lower(priority), '[^a-z0-9]+', '_', 'g'), '_')", "NULL", "key", "'year'", "price", "d", "NOT (k % 3 = 0 AND same > 1)"), _S.format("NULL", "NULL", "'contradictory_duplicate'", "key", "NULL", "NULL", "d", "k % 3 = 0 AND same > 1"),
    extra=f", d AS (SELECT *, count(*) OVER (PARTITION BY {_PUB}, priority, date, cust % 5) AS same FROM o)",
))
def etl_economic(spark, sf_dir):
    k = F.col("k")
    pub = F.when(k % 3 == 0, "direct").when(k % 3 == 1, "imf").otherwise("bank")
    r = _orders(spark, sf_dir).select("key", "date", pub.alias("publisher"), F.col("priority").alias("code"), (F.col("cust") % 5).alias("region"), F.col("price").alias("value"), F.lit("usd").alias("unit"))
    return run_report(economic(r))


@query("etl_aid_access", _sql(_S.format("'aid'", "'aid_access.consignment.' || trim(regexp_replace(lower(priority), '[^a-z0-9]+', '_', 'g'), '_')", "NULL", "key", "'day'", "price", "o", "true")).replace("SELECT dataset, indicator, drop, count", "SELECT dataset, indicator, drop, count(*) FILTER (WHERE CAST(key AS BIGINT) % 6 < 4) AS canonical, count(*) FILTER (WHERE CAST(key AS BIGINT) % 6 NOT IN (4, 5)) AS raw_kept, count"))
def etl_aid_access(spark, sf_dir):
    """Units by six spellings; two of them are canonical as they stand."""
    units = F.get(F.array(*map(F.lit, ["Truck", "truckload", "MT", "ton", "trucks", "pallets"])), (F.col("k") % 6).cast("int"))
    r = _orders(spark, sf_dir).select("key", "date", F.col("priority").alias("cargo"), F.col("price").alias("quantity"), units.alias("unit"), F.lit("gate").alias("crossing"))
    rows = aid_access(r)
    changed = rows.groupBy("dataset", "indicator", "drop").agg(F.count_if(F.col("unit").isin("trucks", "tonnes") & F.col("attrs")["unit_raw"].isNotNull()).alias("canonical"), F.count_if(F.col("attrs")["unit_raw"].isNotNull()).alias("raw_kept"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("dataset", "indicator", "drop")]
    return run_report(rows).alias("r").join(changed.alias("c"), same).select("r.*", "canonical", "raw_kept")


@query("etl_historical", _sql(*[_S.format("'localities'", "'historical.population'", "NULL", f"key || ':c{y}'", "'year'", f"(k * {m}) % 50", "o", f"(k * {m}) % 50 > 0") for y, m in ((1922, 3), (1931, 7), (1945, 11))], _S.format("'localities'", "'historical.locality_status'", "NULL", "key || ':status'", "CASE WHEN k % 2 = 0 THEN 'year' ELSE 'day' END", "NULL", "o", "true")))
def etl_historical(spark, sf_dir):
    k = F.col("k")
    r = _orders(spark, sf_dir).select("key", F.when(k % 2 == 0, "1945-04-01").otherwise("1948-05-10").alias("date"), F.lit("depopulated").alias("status"), *[(k * m % 50).alias(f"population_{y}") for y, m in ((1922, 3), (1931, 7), (1945, 11))])
    return run_report(historical(r, ["1922", "1931", "1945"]))


@query("etl_running_totals", _sql(
    *[_S.format("'totals'", f"'conflict.cumulative_{f}'", "NULL", f"key || ':{f}'", "'day'", f, "d", f"NOT pad AND {f} IS NOT NULL") for f in ("killed", "injured")], _S.format("NULL", "NULL", "'fill_padding'", "key", "NULL", "NULL", "d", "pad"), _S.format("NULL", "NULL", "'no_metrics'", "key", "NULL", "NULL", "d", "NOT pad AND killed IS NULL AND injured IS NULL"),
    extra=", x AS (SELECT *, CASE WHEN k % 10 <> 1 THEN CAST(floor(price / 150000) AS BIGINT) END AS killed, CASE WHEN k % 10 <> 1 THEN CAST(floor(price / 250000) AS BIGINT) END AS injured FROM o), l AS (SELECT *, lag(coalesce(CAST(killed AS VARCHAR), '-') || '/' || coalesce(CAST(injured AS VARCHAR), '-')) OVER (PARTITION BY cust ORDER BY date, key) AS before FROM x), d AS (SELECT *, k % 8 <> 0 AND before IS NOT NULL AND before = coalesce(CAST(killed AS VARCHAR), '-') || '/' || coalesce(CAST(injured AS VARCHAR), '-') AS pad FROM l)",
))
def etl_running_totals(spark, sf_dir):
    k = F.col("k")
    part = lambda n: F.when(k % 10 != 1, F.floor(F.col("price") / n))
    r = _orders(spark, sf_dir).select("key", F.col("cust").alias("series"), "date", F.when(k % 8 == 0, "un").otherwise("fill").alias("source"), part(150000).alias("killed"), part(250000).alias("injured"))
    return run_report(running_totals(r, {"killed": "conflict.cumulative_killed", "injured": "conflict.cumulative_injured"}))


_CUT = "CASE WHEN date < '1997-01-01' THEN 'before_cutover' WHEN k % 10 = 1 AND k % 4 = 1 THEN 'no_cumulative' WHEN k % 6 = 0 THEN 'inferred' WHEN k % 6 = 5 THEN 'unknown_source' END"


@query("etl_cut_over", _sql(
    _S.format("'daily'", "'conflict.cumulative_killed'", "NULL", "key || ':killed'", "'day'", "k % 90", "o", f"{_CUT} IS NULL AND k % 10 <> 1"), _S.format("'daily'", "'conflict.cumulative_injured'", "NULL", "key || ':injured'", "'day'", "k % 70", "o", f"{_CUT} IS NULL AND k % 4 <> 1"), _S.format("NULL", "NULL", _CUT, "key", "NULL", "NULL", "o", f"{_CUT} IS NOT NULL"),
))
def etl_cut_over(spark, sf_dir):
    k = F.col("k")
    source = F.when(k % 6 == 0, "missing").when(k % 6 == 5, "rumour").when(k % 6 < 3, "ministry").otherwise("office")
    r = _orders(spark, sf_dir).select("key", "date", source.alias("source"), F.when(k % 10 != 1, k % 90).alias("killed"), F.when(k % 4 != 1, k % 70).alias("injured"))
    return run_report(cut_over(r, "1997-01-01", ["ministry", "office"]))
