"""Category transforms of registers, stocks and reports: each says what its dates mean, what a record fans out to, and what is no row.

Records carry `dataset`, the one that their source is routed to; null is a drop. Dates that only say
when a register was built have no precision; a year's or a month's figure stands on its first day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import repair_mojibake
from tidemark.plans.categories import _S, _orders, _sql, dropped, emit, row, run_report, slug
from tidemark.plans.register import query

#: Spellings of governorates, labels that are no place, codes and quarters.
GOVERNORATES = {"Qalqiliya": "Qalqilya", "Ramallah and Albireh": "Ramallah", "Kan Younis": "Khan Younis"}
NO_PLACE = ["Israel", "Not listed"]
REGIONS = ["West Bank", "Gaza Strip"]
SEX = {"m": "male", "f": "female"}
QUARTERS = {"Q1": "03", "Q2": "06", "Q3": "09", "Q4": "12"}
TOTALS = {"Grand Total": "total", "Female Total": "female", "Male Total": "male"}
SERIES_START = {"casualties": "2008-01-01", "martyrs": "2023-10-07"}


def known(c: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def year(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("-01-01"))


def unroutable(*more: Column) -> Column:
    return F.coalesce(F.when(F.col("dataset").isNull(), "unroutable"), *more)


def joined(*parts: Column) -> Column:
    """Segments of an indicator; a null one is left out."""
    return F.concat_ws(".", *parts)


def governorate(c: Column, places: list[str]) -> dict[str, Column]:
    """Where a governorate's figure belongs: the place, a label that is none, or a name nobody knows."""
    name = F.coalesce(known(c, GOVERNORATES), c)
    return {"place": F.when(name.isin(places), name), "breakdown_place": F.when(name.isin(NO_PLACE), name), "governorate_unresolved": F.when(~name.isin(places + NO_PLACE), name)}


def prisoners(r: DataFrame) -> DataFrame:
    """(key, dataset, date, metric, count, moved): stocks at the end of a month."""
    day = F.substring("date", 1, 10)
    attrs = {"reference": F.lit("period-end stock"), "date_not_month_start": F.when(F.substring(day, 9, 2) != "01", "true")}
    return emit(r, F.coalesce(F.when(F.col("moved"), "moved"), unroutable()), (F.lit(True), row(F.col("dataset"), joined(F.lit("prisoners"), slug(F.col("metric"))), day, "month", F.col("key"), F.col("count"), "persons", attrs)))


def casualties(r: DataFrame, places: list[str], frozen: str) -> DataFrame:
    """(key, dataset, dimension, label, date, governorate, killed): yearly totals have their year, and say if it still runs; other splits cover the whole series."""
    annual = (F.col("dimension") == "annual_total") & F.col("date").isNotNull()
    where = {k: F.when(F.col("dimension") == "governorate", v) for k, v in governorate(F.col("governorate"), places).items()}
    attrs = {"partial_year": F.when(annual & (F.substring("date", 1, 4) == frozen[:4]), "true"), "coverage_start": F.when(~annual, SERIES_START["casualties"]), "coverage_end": F.when(~annual, frozen), **where}
    at, precision = F.when(annual, year(F.col("date"))).otherwise(SERIES_START["casualties"]), F.when(annual, "year").otherwise("unknown")
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), joined(F.lit("casualties"), slug(F.col("dimension")), slug(F.col("label"))), at, precision, F.col("key"), F.col("killed"), "fatalities", attrs)))


def settlements(r: DataFrame) -> DataFrame:
    """(key, dataset, date, count): stocks at the end of a year."""
    attrs = {"reference": F.lit("period-end stock"), "coverage": F.lit("West Bank, excludes East Jerusalem")}
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), "settlements.settler_population", year(F.col("date")), "year", F.col("key"), F.col("count"), "settlers", attrs)))


def land(r: DataFrame) -> DataFrame:
    """(key, dataset, type, date, demolition_date, status, count, unit): only a demolition's own date is a date."""
    own = F.col("type") == "demolition"
    at = F.when(own, F.coalesce("demolition_date", "date")).otherwise(F.col("date"))
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), joined(F.lit("land"), slug(F.col("type"))), F.substring(at, 1, 10), F.when(own, "day").otherwise("unknown"), F.col("key"), F.col("count"), F.col("unit"), {"status": F.col("status")})))


def culture(r: DataFrame) -> DataFrame:
    """(key, dataset, date, site, status, count): a register of sites."""
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), joined(F.lit("culture.heritage_site"), slug(F.col("site"))), F.substring("date", 1, 10), "unknown", F.col("key"), F.col("count"), "sites", {"status": F.col("status")})))


def education(r: DataFrame) -> DataFrame:
    """(key, dataset, date, status, name): a register of schools, each one row; names that were read in a wrong encoding are mended."""
    name = repair_mojibake(F.col("name"))
    attrs = {"status": F.col("status"), "name": name, "name_repaired": F.when(name != F.col("name"), "true")}
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), "education.school_record", F.substring("date", 1, 10), "unknown", F.col("key"), F.lit(1), "schools", attrs)))


def funding(r: DataFrame) -> DataFrame:
    """(key, dataset, date, status, amount)."""
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), joined(F.lit("funding"), slug(F.col("status"))), F.substring("date", 1, 10), "day", F.col("key"), F.col("amount"), "USD")))


def health(r: DataFrame) -> DataFrame:
    """(key, dataset, date, code, dimension, value, unit): what has no code is no observation."""
    return emit(r, unroutable(F.when(F.coalesce(F.col("code"), F.lit("")) == "", "no_indicator_identity")), (F.lit(True), row(F.col("dataset"), joined(F.lit("health"), slug(F.col("code")), slug(F.col("dimension"))), year(F.col("date")), "year", F.col("key"), F.col("value"), F.col("unit"), {"region": F.lit("Palestine")})))


def food(r: DataFrame, places: list[str]) -> DataFrame:
    """(key, dataset, date, commodity, market, governorate, price, unit): a month's price at a market, or a whole region's basket."""
    wide = F.col("market").isin(REGIONS)
    where = {k: F.when(~F.coalesce(wide, F.lit(False)), v) for k, v in governorate(F.col("governorate"), places).items()}
    attrs = {**where, "place": F.when(wide, F.col("market")).otherwise(where["place"]), "basket": F.when(wide, "region-wide")}
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), joined(F.lit("food.price"), slug(F.col("commodity"))), F.concat(F.substring("date", 1, 8), F.lit("01")), "month", F.col("key"), F.col("price"), F.col("unit"), attrs)))


def martyrs(r: DataFrame) -> DataFrame:
    """(dataset, key, summary, day, gaza, west_bank, id, name, sex, age): a cumulative summary of a day, or a person of the roster, whose own id is the key, so that a corrected record is the same person."""
    summary = F.coalesce(F.col("summary"), F.lit(False))
    drop = unroutable(F.when(summary & (F.col("day").isNull() | F.col("gaza").isNull()), "summary_incomplete"), F.when(~summary & (F.coalesce(F.col("id"), F.lit("")) == ""), "no_roster_id"))
    total = F.coalesce("gaza", F.lit(0)) + F.coalesce("west_bank", F.lit(0))
    person = {"event_type": F.lit("identified_killed"), "name": F.when(F.col("name") != "", F.col("name")), "sex": F.coalesce(known(F.col("sex"), SEX), F.col("sex")), "age": F.col("age")}
    return emit(
        r, drop, (summary, row(F.col("dataset"), "martyrs.cumulative_summary", F.col("day"), "day", F.concat(F.lit("summary:"), "day"), total, "persons", {"event_type": F.lit("cumulative_summary"), "gaza": F.col("gaza"), "west_bank": F.col("west_bank")})),
        (~summary, row(F.col("dataset"), "martyrs.identified_killed", SERIES_START["martyrs"], "unknown", F.concat(F.lit("roster:"), "id"), F.lit(1), "persons", person)),
    )


def infrastructure(r: DataFrame) -> DataFrame:
    """(key, dataset, type, date, detail, level, count, affected, lat, lon, unit): damage by kind, satellite assessments, and registers whose rows are told apart by where they are."""
    damage, satellite = F.col("type") == "infrastructure_damage", F.col("type") == "satellite_damage_assessment"
    indicator = F.when(damage, joined(F.lit("infrastructure.damage"), slug(F.col("detail")))).otherwise(joined(F.lit("infrastructure"), slug(F.col("type"))))
    place = F.when(~(damage | satellite) & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("%.6f,%.6f", "lat", "lon"))
    value = F.when(satellite, F.col("affected")).otherwise(F.col("count"))
    return emit(r, unroutable(), (F.lit(True), row(F.col("dataset"), indicator, F.substring("date", 1, 10), F.when(damage | satellite, "day").otherwise("unknown"), F.col("key"), value, F.col("unit"), {"level": F.col("level"), "geo_key": place})))


def conflict(r: DataFrame, commercial: dict[str, bool], credits: list[str]) -> DataFrame:
    """(key, dataset, type, date, given_precision, region, sources, killed, injured, displaced, affected, lat, lon, score).

    A daily report or summary is a cumulative series of its own region, killed and, if there are any, injured; placeholders
    are drops; anything else is an event with its metrics that are not zero. A second source of stricter licence than the one
    routed to is marked, unless it is only credited.
    """
    kind, names = slug(F.col("type")), F.coalesce(F.col("sources"), F.array().cast("array<string>"))
    series = kind.isin("daily_casualty_report", "summary")
    drop = unroutable(F.when((kind == "daily_casualty_report") & (F.col("region") == "West Bank") & (F.coalesce("killed", F.lit(0)) == 0), "placeholder_all_metrics_zero"), F.when(F.get(names, F.lit(0)) == "Good Shepherd", "placeholder_no_payload"))
    free = F.create_map(*[F.lit(x) for kv in commercial.items() for x in kv])
    stricter = (F.try_element_at(free, F.get(names, F.lit(0))) == F.lit(True)) & F.exists(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda s: ~s.isin(credits) & (F.try_element_at(free, s) == F.lit(False)))
    region = F.when(F.col("region") == "West Bank", "westbank").otherwise("gaza")
    more = {"provenance": F.when(F.size(names) > 1, F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), "; ")), "licence_order": F.when(stricter, "violated")}
    day = F.substring("date", 1, 10)
    one = lambda m: row(F.col("dataset"), F.concat(F.lit("conflict."), region, F.lit(f"_cumulative_{m}")), day, "day", F.concat("key", F.lit(f":{m}")), F.col(m), "persons", {"cumulative": F.lit("true"), "unexpected_region": F.when(~F.col("region").isin(REGIONS), F.col("region")), **more})
    precision = F.coalesce(F.col("given_precision"), F.when(kind == "aggregate_fatality", "unknown"), F.lit("day"))
    metrics = {m: F.when(F.col(m) != 0, F.col(m)) for m in ("killed", "injured", "displaced", "affected")}
    event = {**metrics, "confidence": F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.7)), "independent_sources": F.greatest(F.size(names), F.lit(1)), "lat": F.col("lat"), "lon": F.col("lon"), **more}
    return emit(r, drop, (series, one("killed")), (series & (F.col("injured") > 0), one("injured")), (~series, row(F.col("dataset"), joined(F.lit("conflict"), kind), day, precision, F.col("key"), None, None, event)))


def refugees(r: DataFrame, totals: list[str]) -> DataFrame:
    """(key, dataset, date, name, count, displaced): three publishers, told apart by the dataset: yearly flows across borders, displacement events, and a camp register with total rows among it."""
    flows, events = F.col("dataset").endswith("unhcr"), F.col("dataset").endswith("idmc")
    last = F.col("date").substr(5, 6) == "-12-31"
    total = F.col("name").isin(totals)
    unit = F.when(F.col("name").startswith("%"), "percent").otherwise("people")
    return emit(
        r, unroutable(), (flows, row(F.col("dataset"), "refugees.cross_border", year(F.col("date")), "year", F.col("key"), F.col("count"), "people")),
        (events, row(F.col("dataset"), "refugees.displacement_event", F.when(last, year(F.col("date"))).otherwise(F.substring("date", 1, 10)), F.when(last, "year").otherwise("day"), F.col("key"), F.col("displaced"), "persons")),
        (~flows & ~events & total, row(F.col("dataset"), "refugees.registered_total", F.substring("date", 1, 10), "unknown", F.col("key"), F.col("count"), unit, {"aggregate_label": F.col("name")})),
        (~flows & ~events & ~F.coalesce(total, F.lit(False)), row(F.col("dataset"), "refugees.camp_population", F.substring("date", 1, 10), "unknown", F.col("key"), F.col("count"), "people", {"camp": F.col("name")})),
    )


def population_wpp(r: DataFrame) -> DataFrame:
    """(key, year, indicator, value, unit): modelled estimates of a year."""
    drop = F.when(F.col("year").isNull() | (F.coalesce(F.col("indicator"), F.lit("")) == ""), "malformed").when(F.col("value").isNull(), "no_value")
    return emit(r, drop, (F.lit(True), row("wpp", joined(F.lit("population.wpp"), F.col("indicator")), F.concat(F.col("year").cast("string"), F.lit("-01-01")), "year", F.col("key"), F.col("value"), F.col("unit"), {"estimate": F.lit("modelled"), "region": F.lit("Palestine")})))


def refugees_unrwa(r: DataFrame) -> DataFrame:
    """(key, year, quarter, field, counts): a row a column of a field's record; the row of all fields has an indicator of its own, so that sums over fields count nobody twice."""
    month = known(F.col("quarter"), QUARTERS)
    drop = F.when(F.col("year").isNull() | month.isNull() | (F.coalesce(F.col("field"), F.lit("")) == ""), "malformed").when(F.size("counts") == 0, "no_metrics")
    base = F.when(F.lower(F.btrim("field")) == "total", "refugees.unrwa_registered_all_fields").otherwise("refugees.unrwa_registered")
    name = lambda c: F.coalesce(known(c, TOTALS), F.concat(slug(c), F.when(c.endswith("+"), "_plus").otherwise("")))
    one = lambda e: row("unrwa_registered", F.concat(base, F.lit("."), name(e["key"])), F.concat(F.col("year").cast("string"), F.lit("-"), month, F.lit("-01")), "month", F.concat_ws(":", "key", slug(e["key"])), e["value"], "persons", {"field": F.col("field"), "column": e["key"], "as_of": F.lit("end of quarter")})
    made = F.when(drop.isNotNull(), F.array(dropped(F.col("key"), drop))).otherwise(F.transform(F.map_entries("counts"), one))
    return r.select(F.explode(made).alias("r")).select("r.*")


def water_gho(r: DataFrame) -> DataFrame:
    """(code, year, dimension, numeric, shown): the number, else the one that is shown, which is marked."""
    value = F.coalesce(F.col("numeric"), F.col("shown").try_cast("double"))
    drop = F.when((F.coalesce(F.col("code"), F.lit("")) == "") | F.col("year").isNull(), "missing_identity").when(value.isNull(), "no_value")
    dim = F.coalesce("dimension", F.lit("TOTAL"))
    return emit(r, drop, (F.lit(True), row("gho_wash", joined(F.lit("water"), slug(F.col("code")), slug(dim)), F.concat(F.col("year").cast("string"), F.lit("-01-01")), "year", F.concat_ws("-", F.lit("gho"), "code", "year", dim), value, "percentage", {"value_basis": F.when(F.col("numeric").isNotNull(), "numeric").otherwise("gho_display_value")})))


# ---- their queries: records derived from orders


def _base(spark, sf_dir, name: str) -> DataFrame:
    return _orders(spark, sf_dir).withColumn("dataset", F.when(F.col("k") % 19 != 0, name))


def _cases(k: Column, *values) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def _r(dataset: str, indicator: str, key: str, precision: str, value: str, where: str = "TRUE", drop: str = "NULL") -> str:
    return _S.format(dataset, indicator, drop, key, precision, value, "o", where)


def _drop(reason: str, where: str) -> str:
    return _r("NULL", "NULL", "key", "NULL", "NULL", where, f"'{reason}'")


_ON, _OFF = "k % 19 <> 0", _drop("unroutable", "k % 19 = 0")
_PLACES = ["Qalqilya", "Ramallah", "Jenin"]


@query("etl_prisoners", _sql(_r("'p'", "CASE k % 2 WHEN 0 THEN 'prisoners.child_prisoners' ELSE 'prisoners.total' END", "key", "'month'", "k % 97", f"{_ON} AND k % 7 <> 0"), _drop("moved", "k % 7 = 0"), _drop("unroutable", "k % 19 = 0 AND k % 7 <> 0")))
def etl_prisoners(spark, sf_dir):
    k = F.col("k")
    return run_report(prisoners(_base(spark, sf_dir, "p").select("*", _cases(k, "Child prisoners", "total").alias("metric"), (k % 97).alias("count"), (k % 7 == 0).alias("moved"))))


@query("etl_casualties", _sql(_r("'c'", "'casualties.' || CASE k % 3 WHEN 0 THEN 'annual_total' WHEN 1 THEN 'governorate.' || CASE k % 4 WHEN 0 THEN 'jenin' WHEN 1 THEN 'qalqiliya' WHEN 2 THEN 'israel' ELSE 'nowhere' END ELSE 'weapon.live_fire' END", "key", "CASE WHEN k % 3 = 0 THEN 'year' ELSE 'unknown' END", "k % 31", _ON), _OFF))
def etl_casualties(spark, sf_dir):
    k = F.col("k")
    gov = _cases(k, "Jenin", "Qalqiliya", "Israel", "Nowhere")
    r = _base(spark, sf_dir, "c").select("*", _cases(k, "annual_total", "governorate", "weapon").alias("dimension"), F.when(k % 3 == 1, gov).when(k % 3 == 2, "Live fire").alias("label"), gov.alias("governorate"), (k % 31).alias("killed"))
    return run_report(casualties(r, _PLACES, "1998-08-05"))


@query("etl_settlements", _sql(_r("'s'", "'settlements.settler_population'", "key", "'year'", "k % 1009", _ON), _OFF))
def etl_settlements(spark, sf_dir):
    return run_report(settlements(_base(spark, sf_dir, "s").withColumn("count", F.col("k") % 1009)))


@query("etl_land", _sql(_r("'l'", "CASE k % 3 WHEN 0 THEN 'land.demolition' WHEN 1 THEN 'land.seizure_order' ELSE 'land.outpost' END", "key", "CASE WHEN k % 3 = 0 THEN 'day' ELSE 'unknown' END", "k % 5", _ON), _OFF))
def etl_land(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "l").select("*", _cases(k, "demolition", "Seizure order", "outpost").alias("type"), F.when(k % 2 == 0, "1999-01-02").alias("demolition_date"), F.lit("pending").alias("status"), (k % 5).alias("count"), F.lit("dunums").alias("unit"))
    return run_report(land(r))


@query("etl_culture", _sql(_r("'h'", "CASE k % 2 WHEN 0 THEN 'culture.heritage_site.mosque' ELSE 'culture.heritage_site.old_house' END", "key", "'unknown'", "1", _ON), _OFF))
def etl_culture(spark, sf_dir):
    return run_report(culture(_base(spark, sf_dir, "h").select("*", _cases(F.col("k"), "mosque", "Old house").alias("site"), F.lit("damaged").alias("status"), F.lit(1).alias("count"))))


@query("etl_education", _sql(_r("'e'", "'education.school_record'", "key", "'unknown'", "1", _ON), _OFF))
def etl_education(spark, sf_dir):
    return run_report(education(_base(spark, sf_dir, "e").select("*", F.lit("open").alias("status"), _cases(F.col("k"), "school", "Ã©cole").alias("name"))))


@query("etl_funding", _sql(_r("'f'", "CASE k % 2 WHEN 0 THEN 'funding.paid' ELSE 'funding.pledged' END", "key", "'day'", "price", _ON), _OFF))
def etl_funding(spark, sf_dir):
    return run_report(funding(_base(spark, sf_dir, "f").select("*", _cases(F.col("k"), "Paid", "pledged").alias("status"), F.col("price").alias("amount"))))


@query("etl_health", _sql(_r("'w'", "'health.mdg_1' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '.sex_fmle' ELSE '.sex_mle' END", "key", "'year'", "k % 11", f"{_ON} AND k % 5 <> 0"), _drop("no_indicator_identity", f"{_ON} AND k % 5 = 0"), _OFF))
def etl_health(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "w").select("*", F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, "").otherwise("MDG-1").alias("code"), _cases(k, None, "SEX_FMLE", "SEX_MLE").alias("dimension"), (k % 11).alias("value"), F.lit("rate").alias("unit"))
    return run_report(health(r))


@query("etl_food", _sql(_r("'wfp'", "CASE k % 2 WHEN 0 THEN 'food.price.bread' ELSE 'food.price.olive_oil' END", "key", "'month'", "price", _ON), _OFF))
def etl_food(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "wfp").select("*", _cases(k, "Bread", "Olive oil").alias("commodity"), _cases(k, "West Bank", "Market", None).alias("market"), _cases(k, "Ramallah and Albireh", "Nowhere", None).alias("governorate"), F.lit("ILS/kg").alias("unit"))
    return run_report(food(r, _PLACES))


@query("etl_martyrs", _sql(
    _r("'t'", "'martyrs.cumulative_summary'", "'summary:' || date", "'day'", "k % 50 + CASE WHEN k % 4 = 0 THEN 7 ELSE 0 END", f"{_ON} AND k % 3 = 0 AND k % 5 <> 0"), _drop("summary_incomplete", f"{_ON} AND k % 3 = 0 AND k % 5 = 0"),
    _r("'t'", "'martyrs.identified_killed'", "'roster:' || (k % 1000)", "'unknown'", "1", f"{_ON} AND k % 3 <> 0 AND k % 11 <> 0"), _drop("no_roster_id", f"{_ON} AND k % 3 <> 0 AND k % 11 = 0"), _OFF,
))
def etl_martyrs(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "t").select(
        "*", (k % 3 == 0).alias("summary"), F.when(k % 10 != 0, F.col("date")).alias("day"), F.when(k % 5 != 0, k % 50).when(k % 10 == 0, 1).alias("gaza"), F.when(k % 4 == 0, 7).alias("west_bank"),
        F.when(k % 11 != 0, (k % 1000).cast("string")).when(k % 2 == 0, "").alias("id"), _cases(k, "a name", "").alias("name"), _cases(k, "m", "f", "x").alias("sex"), (k % 90).alias("age"),
    )
    return run_report(martyrs(r))


@query("etl_infrastructure", _sql(_r("'i'", "CASE k % 4 WHEN 0 THEN 'infrastructure.damage.water_well' WHEN 1 THEN 'infrastructure.satellite_damage_assessment' WHEN 2 THEN 'infrastructure.locality_record' ELSE 'infrastructure.barrier_segment' END", "key", "CASE WHEN k % 4 < 2 THEN 'day' ELSE 'unknown' END", "CASE WHEN k % 4 = 1 THEN k % 600 ELSE k % 6 END", _ON), _OFF))
def etl_infrastructure(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "i").select("*", _cases(k, "infrastructure_damage", "satellite_damage_assessment", "locality_record", "barrier_segment").alias("type"), F.lit("Water well").alias("detail"), F.lit("severe").alias("level"), (k % 6).alias("count"), (k % 600).alias("affected"), (31 + k % 100 / 100.0).alias("lat"), F.when(k % 2 == 0, 35.0).alias("lon"), F.lit("units").alias("unit"))
    return run_report(infrastructure(r))


_KIND = "CASE k % 5 WHEN 0 THEN 'daily_casualty_report' WHEN 1 THEN 'summary' WHEN 2 THEN 'air_strike' WHEN 3 THEN 'aggregate_fatality' ELSE 'village_record' END"
_ZERO, _SHEPHERD = "k % 5 = 0 AND k % 2 = 0 AND k % 7 = 0", "k % 13 = 0"
_LIVE = f"{_ON} AND NOT ({_ZERO}) AND NOT ({_SHEPHERD})"
_REG = "CASE WHEN k % 2 = 0 THEN 'westbank' ELSE 'gaza' END"


@query("etl_conflict", _sql(
    _r("'x'", f"'conflict.' || {_REG} || '_cumulative_killed'", "key || ':killed'", "'day'", "k % 7", f"{_LIVE} AND k % 5 < 2"), _r("'x'", f"'conflict.' || {_REG} || '_cumulative_injured'", "key || ':injured'", "'day'", "k % 3", f"{_LIVE} AND k % 5 < 2 AND k % 3 > 0"),
    _r("'x'", f"'conflict.' || {_KIND}", "key", "CASE k % 5 WHEN 3 THEN 'unknown' WHEN 4 THEN 'year' ELSE 'day' END", "NULL", f"{_LIVE} AND k % 5 >= 2"), _drop("placeholder_all_metrics_zero", f"{_ON} AND {_ZERO}"), _drop("placeholder_no_payload", f"{_ON} AND NOT ({_ZERO}) AND {_SHEPHERD}"), _OFF,
))
def etl_conflict(spark, sf_dir):
    k = F.col("k")
    r = _base(spark, sf_dir, "x").select(
        "*", _cases(k, "Daily casualty report", "summary", "Air strike", "aggregate_fatality", "village record").alias("type"), F.when(k % 5 == 4, "year").alias("given_precision"), F.when(k % 2 == 0, "West Bank").when(k % 3 == 0, "Elsewhere").otherwise("Gaza Strip").alias("region"),
        F.when(k % 13 == 0, F.array(F.lit("Good Shepherd"))).when(k % 4 == 0, F.array(F.lit("open"), F.lit("closed"))).when(k % 4 == 1, F.array(F.lit("open"), F.lit("credit"))).alias("sources"),
        (k % 7).alias("killed"), (k % 3).alias("injured"), F.lit(0).alias("displaced"), F.lit(None).cast("long").alias("affected"), (31 + k % 100 / 100.0).alias("lat"), F.lit(35.0).alias("lon"), F.lit(0.0).alias("score"),
    )
    return run_report(conflict(r, {"open": True, "closed": False, "credit": False}, ["credit"]))


@query("etl_refugees", _sql(
    _r("'unhcr'", "'refugees.cross_border'", "key", "'year'", "k % 41", f"{_ON} AND k % 3 = 0"), _r("'idmc'", "'refugees.displacement_event'", "key", "CASE WHEN date LIKE '%-12-31' THEN 'year' ELSE 'day' END", "k % 17", f"{_ON} AND k % 3 = 1"),
    _r("'unrwa'", "CASE WHEN k % 2 = 0 THEN 'refugees.registered_total' ELSE 'refugees.camp_population' END", "key", "'unknown'", "k % 41", f"{_ON} AND k % 3 = 2"), _OFF,
))
def etl_refugees(spark, sf_dir):
    k = F.col("k")
    r = _orders(spark, sf_dir).select("*", F.when(k % 19 != 0, _cases(k, "unhcr", "idmc", "unrwa")).alias("dataset"), F.when(k % 4 == 0, "% of all").when(k % 2 == 0, "All camps").when(k % 5 != 0, "Camp").alias("name"), (k % 41).alias("count"), (k % 17).alias("displaced"))
    return run_report(refugees(r, ["% of all", "All camps"]))


@query("etl_population_wpp", _sql(_r("'wpp'", "CASE k % 2 WHEN 0 THEN 'population.wpp.births' ELSE 'population.wpp.deaths' END", "key", "'year'", "price", "k % 9 <> 0 AND k % 7 <> 0"), _drop("malformed", "k % 9 = 0"), _drop("no_value", "k % 9 <> 0 AND k % 7 = 0")))
def etl_population_wpp(spark, sf_dir):
    k = F.col("k")
    r = _orders(spark, sf_dir).select("*", F.when(k % 18 != 0, F.substring("date", 1, 4).cast("int")).alias("year"), F.when(k % 9 != 0, _cases(k, "births", "deaths")).alias("indicator"), F.when(k % 7 != 0, F.col("price")).alias("value"), F.lit("thousand").alias("unit"))
    return run_report(population_wpp(r))


_FLD = "CASE k % 3 WHEN 0 THEN 'refugees.unrwa_registered_all_fields.' ELSE 'refugees.unrwa_registered.' END"


@query("etl_refugees_unrwa", _sql(
    *[_r("'unrwa_registered'", f"{_FLD} || '{n}'", f"key || ':{s}'", "'month'", v, "k % 5 <> 4 AND k % 23 <> 0") for n, s, v in (("total", "grand_total", "k % 100"), ("female", "female_total", "k % 50"), ("age_0_5", "age_0_5", "k % 20"), ("age_60_plus", "age_60", "k % 10"))], _drop("malformed", "k % 5 = 4"), _drop("no_metrics", "k % 5 <> 4 AND k % 23 = 0"),
))
def etl_refugees_unrwa(spark, sf_dir):
    k = F.col("k")
    counts = F.create_map(F.lit("Grand Total"), k % 100, F.lit("Female Total"), k % 50, F.lit("Age 0-5"), k % 20, F.lit("Age 60+"), k % 10)
    r = _orders(spark, sf_dir).select("*", F.substring("date", 1, 4).cast("int").alias("year"), _cases(k, "Q1", "Q2", "Q3", "Q4", "Q5").alias("quarter"), _cases(k, " Total", "Gaza", "Jordan").alias("field"), F.when(k % 23 == 0, F.map_filter(counts, lambda _, v: v < 0)).otherwise(counts).alias("counts"))
    return run_report(refugees_unrwa(r))


@query("etl_water_gho", _sql(_r("'gho_wash'", "CASE k % 3 WHEN 0 THEN 'water.wsh_1.total' WHEN 1 THEN 'water.wsh_1.rur' ELSE 'water.wsh_1.urb' END", "'gho-WSH_1-' || substr(date, 1, 4) || '-' || CASE k % 3 WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'RUR' ELSE 'URB' END", "'year'", "CASE WHEN k % 4 = 0 THEN 2 ELSE k % 100 END", "k % 7 <> 0 AND k % 8 <> 4"), _drop("missing_identity", "k % 7 = 0"), _drop("no_value", "k % 7 <> 0 AND k % 8 = 4")))
def etl_water_gho(spark, sf_dir):
    k = F.col("k")
    r = _orders(spark, sf_dir).select("*", F.when(k % 14 == 0, "").when(k % 7 != 0, "WSH_1").alias("code"), F.substring("date", 1, 4).cast("int").alias("year"), _cases(k, None, "RUR", "URB").alias("dimension"), F.when(k % 4 != 0, (k % 100).cast("double")).alias("numeric"), F.when(k % 8 == 0, "2").when(k % 8 == 4, "n/a").alias("shown"))
    return run_report(water_gho(r))
