"""Bulletins and answers of other systems: price lists, tables, notices, running totals, coded payloads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import spread
from tidemark.sources.analogues import DAY, HOUR, table

ARABIC, LATIN = "٠١٢٣٤٥٦٧٨٩", "0123456789"
BIDI = "‎‏؜‪‫‬‭‮⁦⁧⁨⁩"


def plain_digits(text: Column) -> Column:
    """Arabic digits as Latin ones, without the marks that only steer the direction of writing."""
    return F.translate(text, ARABIC + BIDI, LATIN)


# ---- a strict table of road states

#: Status words with value and severity, and the sign that must agree with them.
STATUS = [("مفتوح", "open", 0, "🟢"), ("أزمة متوسطة", "congested", 1, "🟡"), ("أزمة خانقة", "congested", 2, "🟠"), ("مغلق", "closed", 3, "🔴")]
SIGNS = {"🟢": "open", "🔴": "closed", "🟡": "congested", "🟠": "congested"}
ROW = r"^-\s*([^:]+):\s*(\S)\s*([^|]+?)\s*\|\s*(\S)\s*(.+?)\s*$"


def road_table(bulletins: DataFrame) -> DataFrame:
    """Bulletins (id, text) to rows (id, name, direction, value, severity, stamp); a line that is no row of the grammar, or whose
    sign and words disagree, is one row with value `rejected`."""
    lines = bulletins.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"), plain_digits(F.regexp_extract("text", "آخر تحديث:([^\n]+)", 1)).alias("s")).where(F.btrim("line").startswith("-"))
    part = lambda k: F.regexp_extract(F.btrim("line"), ROW, k)
    value = lambda words: F.coalesce(*[F.when(words == w, F.struct(F.lit(v).alias("value"), F.lit(s).alias("severity"))) for w, v, s, _ in STATUS])
    fits = lambda sign, v: ~sign.isin(*SIGNS) | F.coalesce(*[F.when(sign == e, v == x) for e, x in SIGNS.items()])
    r = lines.select("id", "at", F.btrim(part(1)).alias("name"), part(2).alias("e1"), part(4).alias("e2"), value(part(3)).alias("a"), value(part(5)).alias("b"), "s")
    ok = F.coalesce((F.col("name") != "") & F.col("a").isNotNull() & F.col("b").isNotNull() & fits(F.col("e1"), F.col("a.value")) & fits(F.col("e2"), F.col("b.value")), F.lit(False))
    hour = F.regexp_extract("s", r"(\d{1,2}):(\d{2})", 1).cast("int") % 12 + F.when(F.col("s").contains("م"), 12).otherwise(0)
    stamp = F.format_string("%02d:%s", hour, F.regexp_extract("s", r"(\d{1,2}):(\d{2})", 2))
    both = F.when(ok, F.array(F.struct(F.lit("inbound").alias("direction"), "a.value", "a.severity"), F.struct(F.lit("outbound").alias("direction"), "b.value", "b.severity"))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("direction"), F.lit("rejected").alias("value"), F.lit(None).cast("int").alias("severity"))))
    return r.select("id", "at", F.when(ok, F.col("name")).alias("name"), stamp.alias("stamp"), F.explode(both).alias("x")).select("id", "at", "name", "x.*", "stamp")


def _row(name: Column, k: Column) -> Column:
    pick = lambda j: F.get(F.array(*[F.lit(f"{e} {w}") for w, _, _, e in STATUS]), j.cast("int"))
    return F.concat(F.lit("- "), name, F.lit(": "), pick(k % 4), F.lit(" | "), pick(F.floor(k / 4) % 4))


@query("tx_palhub_roads", """WITH st(j, value, severity) AS (VALUES (0, 'open', 0), (1, 'congested', 1), (2, 'congested', 2), (3, 'closed', 3)), b AS (SELECT event_id AS id, lpad(CAST(CASE WHEN event_id % 24 >= 12 THEN event_id % 12 + 12 ELSE event_id % 12 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS stamp FROM events)
SELECT id, 2 AS at, 'موقع' || id AS name, 'inbound' AS direction, value, severity, stamp FROM b JOIN st ON j = id % 4 UNION ALL SELECT id, 2, 'موقع' || id, 'outbound', value, severity, stamp FROM b JOIN st ON j = id // 4 % 4 UNION ALL SELECT id, 3, NULL, NULL, 'rejected', NULL, stamp FROM b WHERE id % 3 = 0""")
def tx_palhub_roads(spark, sf_dir):
    """A bulletin an event: header, stamp in Arabic digits, a row, and a row whose sign and words disagree in every third."""
    k = F.col("event_id")
    two = lambda c: F.translate(F.format_string("%02d", c), LATIN, ARABIC)
    stamp = F.concat(F.lit("آخر تحديث: ٠٢‏/٠٨، "), two(F.when(k % 12 == 0, 12).otherwise(k % 12)), F.lit(":"), two(k % 60), F.lit(" "), F.when(k % 24 >= 12, "م").otherwise("ص"))
    bad = F.when(k % 3 == 0, "\n- موقع: 🟢 مغلق | 🟢 مفتوح").otherwise("")
    text = F.concat(F.lit("منطقة الوسط\n"), stamp, F.lit("\n"), _row(F.concat(F.lit("موقع"), k.cast("string")), k), bad, F.lit("\nللمزيد"))
    return road_table(table(spark, sf_dir, "events").select(k.alias("id"), text.alias("text")))


# ---- price lists

#: What names the authority, what marks a text as no announcement, what stands before an old price or a difference, currencies, products and weights.
AUTHORITY = ["الهيئة العامة للبترول", "هيئة البترول", "وزارة المالية والتخطيط", "المالية الفلسطينية"]
NO_NEWS = ["غير صحيح", "لا صحة", "شائع", "إشاع", "اشاع", "مفبرك", "يتم تداول", "لم تصدر", "أن تصدر", "ان تصدر", "كانت", "كان ", "في حينه", "سابق", "الأعلى منذ", "الأدنى منذ", "إسرائيل", "اسرائيل", "الإسرائيلي", "الاسرائيلي", "أغورة", "اغورة", "الخدمة الذاتية"]
BEFORE_OLD = ["بدلا", "بدلاً", "بدل", "عوضا", "عوضاً", "مقارنة", "بمقدار", "بقيمة"]
CURRENCY = ["شيكل", "شيقل", "شواكل"]
PETROL, GRADES, DIESEL, KEROSENE = "بنزين", {"95": "gasoline_95", "98": "gasoline_98"}, ["سولار", "ديزل"], ["كاز"]
CYLINDER, KILOGRAMS = ["أسطوان", "اسطوان", "إسطوان"], ["كغم", "كلغم", "كغ", "كيلو"]


def any_in(text: Column, values: list[str]) -> Column:
    return reduce(lambda out, v: out | F.contains(text, F.lit(v)), values, F.lit(False))


def starts_with(word: Column, values: list[str]) -> Column:
    return F.coalesce(reduce(lambda out, v: out | word.startswith(v), values, F.lit(False)), F.lit(False))


def product_of(w: Column) -> Column:
    """What a clause's words are about: a fuel by its name, petrol by the number that follows it within two words, a cylinder by its weight."""
    return F.get(F.transform(F.array(F.transform(w, lambda x: F.regexp_replace(x, "^(?:[ولب]?ال|لل|و)", ""))), lambda bare: _product(w, bare)), F.lit(0))


def _product(w: Column, bare: Column) -> Column:
    at = F.array_position(bare, PETROL)
    grade = F.filter(F.slice(w, F.greatest(at, F.lit(1)).cast("int") + 1, 2), lambda x: x.isin(list(GRADES)))
    petrol = F.when(at > 0, F.try_element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), F.get(grade, F.lit(0))))
    weight = F.exists(F.transform(w, lambda x, i: (x == "12") & starts_with(F.get(w, i + 1), KILOGRAMS)), lambda x: x)
    cylinder = F.when(F.exists(w, lambda x: starts_with(F.regexp_replace(x, "^ال", ""), CYLINDER)) & weight, "lpg_12")
    named = lambda words, name: F.when(F.exists(bare, lambda x: x.isin(words)), name)
    return F.coalesce(petrol, named(DIESEL, "diesel"), named(KEROSENE, "kerosene"), cylinder)


def amounts(w: Column) -> Column:
    """The numbers that a currency follows and that no word for an old price or a difference precedes by one or two words."""
    def amount(x: Column, i: Column) -> Column:
        old = F.coalesce(F.get(w, i - 1).isin(BEFORE_OLD), F.lit(False)) | F.coalesce(F.get(w, i - 2).isin(BEFORE_OLD), F.lit(False))
        return F.when(starts_with(F.get(w, i + 1), CURRENCY) & ~old, x.try_cast("double"))

    return F.filter(F.transform(w, amount), lambda x: x.isNotNull())


def price_list(texts: DataFrame) -> DataFrame:
    """Texts (id, text) to rows (id, verdict, product, price): clauses that name one product and give one price that is neither an old one nor a difference."""
    t = F.regexp_replace(plain_digits(F.col("text")), r"(?<=\d)[،,](?=\d{1,2}(?!\d))", ".")
    once = lambda x: F.explode(F.array(x))  # noqa: E731  what is exploded is not repeated in filters and columns that name it
    d = texts.select("id", once(t).alias("t"))
    refused = F.when(~any_in(F.col("t"), AUTHORITY), "no authority").when(any_in(F.col("t"), NO_NEWS), "no announcement")
    d = d.select("id", "t", once(refused).alias("refused"))
    c = d.where("refused IS NULL").select("id", F.explode(F.split("t", r"[،\n:]+")).alias("clause")).select("id", once(F.split(F.btrim(F.regexp_replace("clause", r"[()\s]+", " ")), " ")).alias("w"))
    c = c.select("id", once(F.struct(product_of(F.col("w")).alias("product"), amounts(F.col("w")).alias("p"))).alias("x")).select("id", "x.*").where("product IS NOT NULL AND size(p) = 1")
    got = c.groupBy("id", "product").agg(F.max(F.get("p", F.lit(0))).alias("price"), F.count_distinct("p").alias("n")).where("n = 1").drop("n")
    out = d.join(got, "id", "left")
    return out.select("id", F.coalesce("refused", F.when(F.col("product").isNull(), "no prices"), F.lit("prices")).alias("verdict"), "product", "price")


@query("tx_fuel_price", """WITH k AS (SELECT p_partkey AS id, 5 + p_partkey % 300 / 100.0 AS a, 6 + p_partkey % 70 / 10.0 AS b, p_partkey % 6 AS f FROM part)
SELECT id, CASE WHEN f = 4 THEN 'no authority' WHEN f = 5 THEN 'no announcement' ELSE 'prices' END AS verdict, p.product, CASE p.product WHEN 'gasoline_95' THEN round(a, 2) WHEN 'diesel' THEN round(b, 1) WHEN 'lpg_12' THEN 75.0 END AS price
FROM k LEFT JOIN (VALUES ('gasoline_95'), ('diesel'), ('lpg_12')) AS p(product) ON f < 4 AND (p.product <> 'lpg_12' OR f = 3)""")
def tx_fuel_price(spark, sf_dir):
    """Announcements, refused rumours, old prices beside new ones, decimal commas, cylinders by weight."""
    k = F.col("p_partkey")
    a, b = F.format_string("%.2f", 5 + k % 300 / 100.0), F.format_string("%.1f", 6 + k % 70 / 10.0)
    a = F.when(k % 6 == 1, F.translate(F.replace(a, F.lit("."), F.lit("،")), LATIN, ARABIC)).otherwise(a)
    who = F.when(k % 6 == 4, "أعلنت محطة").when(k % 6 == 5, "هيئة البترول: غير صحيح ما").otherwise("أعلنت الهيئة العامة للبترول")
    text = F.concat(who, F.lit(" أسعار الشهر\nبنزين أوكتان 95 بسعر "), a, F.lit(" شيكل، السولار "), b, F.lit(" شيكل بدلا من 9.50 شيكل"), F.when(k % 6 == 3, "، اسطوانة الغاز 12 كغم 75 شيكل").otherwise(""))
    return price_list(spread(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("id"), text.alias("text")))


@query("tx_palhub_fuel", """SELECT p_partkey AS id, 'محطة ' || p_partkey AS station, f AS fuel, CASE (p_partkey + j) % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'out' ELSE 'limited' END AS state FROM part, (VALUES (0, 'diesel'), (1, 'gasoline')) AS x(j, f) WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, 'rejected' FROM part WHERE p_partkey % 7 = 0""")
def tx_palhub_fuel(spark, sf_dir):
    """Lines of stations: a name, then fuels each with a sign; a line that is none of that is rejected and kept."""
    k = F.col("p_partkey")
    sign = lambda j: F.get(F.array(F.lit("✅"), F.lit("❌"), F.lit("⚠")), ((k + j) % 3).cast("int"))
    line = F.when(k % 7 == 0, F.concat(F.lit("إعلان "), k.cast("string"))).otherwise(F.concat(F.lit("محطة "), k.cast("string"), F.lit(" | سولار "), sign(0), F.lit(" | بنزين "), sign(1)))
    return fuel_table(table(spark, sf_dir, "part").select(k.alias("id"), line.alias("line")))


def fuel_table(lines: DataFrame) -> DataFrame:
    """Lines (id, line) to rows (id, station, fuel, state)."""
    parts = F.split("line", r"\s*\|\s*")
    fuels = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.when(p.startswith("سولار"), "diesel").when(p.startswith("بنزين"), "gasoline").alias("fuel"), F.when(p.endswith("✅"), "available").when(p.endswith("❌"), "out").when(p.endswith("⚠"), "limited").alias("state")))
    d = lines.select("id", F.get(parts, F.lit(0)).alias("station"), fuels.alias("x")).withColumn("ok", (F.size("x") > 0) & F.forall("x", lambda x: x["fuel"].isNotNull() & x["state"].isNotNull()))
    none = F.array(F.struct(F.lit(None).cast("string").alias("fuel"), F.lit("rejected").alias("state")))
    return d.select("id", F.when(F.col("ok"), F.col("station")).alias("station"), F.explode(F.when(F.col("ok"), F.col("x")).otherwise(none)).alias("y")).select("id", "station", "y.*")


# ---- notices of cuts

LATER = "مساء|ظهر|عصر|ليل"


def cut_window(text: Column, zone_hours: int) -> tuple[Column, Column]:
    """Start and end, in microseconds, of an announced cut; null without an announced day and two times. The day of publication is not the day announced."""
    t = plain_digits(text)
    day = F.regexp_extract(t, r"الموافق\s*(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", 0)
    n = lambda k: F.regexp_extract(t, r"الموافق\s*(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", k)
    date = F.when(day != "", F.unix_date(F.make_date(n(3).cast("int"), n(2).cast("int"), n(1).cast("int"))).cast("long") * DAY)
    times = F.regexp_extract_all(t, F.lit(r"الساعة\s*(\d{1,2}:\d{2}\s*(?:من\s+)?\p{L}*)"), 1)

    def at(k: int) -> Column:
        x = F.get(times, F.lit(k))
        hour = F.regexp_extract(x, r"^(\d{1,2}):", 1).cast("int") % 12
        return (hour + F.when(x.rlike(LATER), 12).otherwise(0)).cast("long") * HOUR + F.regexp_extract(x, r":(\d{2})", 1).cast("long") * (HOUR // 60)

    start, end = date + at(0) - zone_hours * HOUR, date + at(1) - zone_hours * HOUR
    ok = date.isNotNull() & (F.size(times) >= 2)
    return F.when(ok, start), F.when(ok, F.when(end <= start, end + 12 * HOUR).otherwise(end))


@query("tx_power_notice", f"WITH k AS (SELECT o_orderkey AS id, o_orderkey % 9 = 4 AS none, epoch_us(date_trunc('day', o_orderdate)) AS d, (o_orderkey % 11 + 1) AS h1, (o_orderkey % 5 + 1) AS h2 FROM orders), s AS (SELECT id, none, d + h1 * {HOUR} - {2 * HOUR} AS a, d + (h2 + 12) * {HOUR} + 30 * 60000000 - {2 * HOUR} AS b FROM k) SELECT id, CASE WHEN NOT none THEN a END AS start_us, CASE WHEN NOT none THEN CASE WHEN b <= a THEN b + {12 * HOUR} ELSE b END END AS end_us FROM s")
def tx_power_notice(spark, sf_dir):
    """Notices with the day they were published and the day they announce; some announce none."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.concat(F.date_format(d, "d"), F.lit("/"), F.date_format(d, "M"), F.lit("/"), F.date_format(d, "yyyy"))
    said = F.when(k % 9 == 4, "لمدة ساعة من الان").otherwise(F.concat(F.lit("يوم الثلاثاء الموافق "), day))
    text = F.concat(F.lit("تاريخ النشر: 1/1/2001 سيتم قطع التيار "), said, F.lit(" من الساعة "), (k % 11 + 1).cast("string"), F.lit(":00 صباحا حتى الساعة "), (k % 5 + 1).cast("string"), F.lit(":30 من ظهر"))
    start, end = cut_window(F.col("text"), 2)
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).select("id", start.alias("start_us"), end.alias("end_us"))


# ---- running totals, judged against the last accepted one


def accepted(bulletins: DataFrame, max_down: float = 0.005, max_rise: float = 0.01) -> DataFrame:
    """Bulletins (series, day, total, line) in order of days: rows (series, day, verdict).

    A total may fall by max_down (a stated revision) and rise by max_rise since the last accepted
    one; a missing total is refused; a day's line above the rise is noted. Spark sorts the bulletins, and spills; a task
    holds one batch and the last accepted total of one series.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, None
        for pdf in batches:
            out = []
            for key, now, line in zip(pdf["series"], pdf["total"], pdf["line"], strict=True):
                if key != series:
                    series, last = key, None
                verdict = one(None if pd.isna(now) else now, last, line)
                last = now if verdict.startswith("accepted") else last
                out.append(verdict)
            yield pd.DataFrame({"series": pdf["series"], "day": pdf["day"], "verdict": out})

    def one(now: float | None, last: float | None, line: float) -> str:
        if now is None:
            return "refused: schema"
        if last is None:
            return "accepted"
        if now < last:
            return "accepted: revised down" if (last - now) / last <= max_down else "refused: not monotonic"
        if (now - last) / last > max_rise:
            return "refused: implausible jump"
        return "accepted: divergent" if line > now - last else "accepted"

    rows = bulletins.select("series", "day", F.col("total").cast("double").alias("total"), F.col("line").cast("double").alias("line"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.repartition("series").sortWithinPartitions("series", "day", "total", "line").mapInPandas(judge, f"series {kinds['series']}, day {kinds['day']}, verdict string")


_TOTALS = """d AS (SELECT l_suppkey AS series, CAST(epoch(date_trunc('month', l_shipdate)) // 86400 AS BIGINT) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT series, day, n, 10000 + sum(n) OVER (PARTITION BY series ORDER BY day) AS total FROM d),
b AS (SELECT series, day, CASE WHEN (series + day) % 13 = 1 THEN NULL WHEN (series + day) % 13 = 2 THEN CAST(total * 1.05 AS BIGINT) WHEN (series + day) % 13 = 3 THEN CAST(total * 0.97 AS BIGINT) WHEN (series + day) % 13 = 4 THEN CAST(total * 0.997 AS BIGINT) ELSE CAST(total AS BIGINT) END AS total, CASE WHEN (series + day) % 5 = 0 THEN n + 3 ELSE n END AS line, row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM c)"""
_VERDICT = "CASE WHEN b.total IS NULL THEN 'refused: schema' WHEN {p} IS NULL THEN 'accepted' WHEN b.total < {p} AND ({p} - b.total) / {p} <= 0.005 THEN 'accepted: revised down' WHEN b.total < {p} THEN 'refused: not monotonic' WHEN (b.total - {p}) / {p} > 0.01 THEN 'refused: implausible jump' WHEN b.line > b.total - {p} THEN 'accepted: divergent' ELSE 'accepted' END"


@query("tx_moh", f"WITH RECURSIVE {_TOTALS}, r AS (SELECT series, day, rn, CAST(total AS DOUBLE) AS prev, {_VERDICT.format(p='CAST(NULL AS DOUBLE)')} AS verdict FROM b WHERE rn = 1 UNION ALL SELECT b.series, b.day, b.rn, CASE WHEN ({_VERDICT.format(p='r.prev')}) LIKE 'accepted%' THEN CAST(b.total AS DOUBLE) ELSE r.prev END, {_VERDICT.format(p='r.prev')} FROM r JOIN b ON b.series = r.series AND b.rn = r.rn + 1) SELECT series, day, verdict FROM r")
def tx_moh(spark, sf_dir):
    """Monthly running totals a supplier, with planted gaps, jumps, falls and revisions."""
    from pyspark.sql import Window

    month = F.unix_date(F.expr("cast(date_trunc('MONTH', cast(l_shipdate AS timestamp_ntz)) AS date)")).cast("long")
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), month.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total, k = 10000 + F.sum("n").over(Window.partitionBy("series").orderBy("day")), (F.col("series") + F.col("day")) % 13
    d = d.withColumn("t", total)
    planted = F.when(k == 1, F.lit(None)).when(k == 2, F.round(F.col("t") * 1.05).cast("long")).when(k == 3, F.round(F.col("t") * 0.97).cast("long")).when(k == 4, F.round(F.col("t") * 0.997).cast("long")).otherwise(F.col("t"))
    line = F.when((F.col("series") + F.col("day")) % 5 == 0, F.col("n") + 3).otherwise(F.col("n"))
    return accepted(d.select("series", "day", planted.alias("total"), line.alias("line")))


# ---- coded payloads

DSR = "ValueDicts map<string, array<string>>, PH array<map<string, array<struct<S: array<struct<N: string, DN: string>>, C: array<string>, R: int, `Ø`: int>>>>"


def decode_rows(payload: Column) -> Column:
    """An answer's rows as arrays of strings: a bit of R repeats the value above, one of Ø is null, numbers of dictionary columns name their entries."""
    d = F.from_json(payload, DSR)
    members = F.flatten(F.transform(d["PH"], lambda m: F.flatten(F.map_values(m))))
    start = F.struct(F.array().cast("array<struct<N:string,DN:string>>").alias("schema"), F.array().cast("array<string>").alias("prev"), F.array().cast("array<array<string>>").alias("out"))

    def bit(mask: Column, i: Column) -> Column:
        return F.floor(F.coalesce(mask, F.lit(0)) / F.pow(F.lit(2.0), i)) % 2 == 1

    def step(s: Column, r: Column) -> Column:
        schema = F.coalesce(r["S"], s["schema"])
        given = lambda i: ~bit(r["R"], i) & ~bit(r["Ø"], i)
        at = lambda i: F.size(F.filter(F.sequence(F.lit(0), i), given)) - 1
        named = lambda c, v: F.coalesce(F.get(F.try_element_at(d["ValueDicts"], c["DN"]), F.expr("try_cast(0 AS int)") + v.try_cast("int")), v)
        row = F.transform(schema, lambda c, i: F.when(bit(r["R"], i), F.get(s["prev"], i)).when(bit(r["Ø"], i), F.lit(None)).otherwise(named(c, F.get(r["C"], at(i)))))
        return F.struct(schema.alias("schema"), row.alias("prev"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(members, start, step)["out"]


@query("src_power_bi", "SELECT s_suppkey AS id, i, CASE i WHEN 0 THEN 'north' WHEN 1 THEN 'north' WHEN 2 THEN 'south' ELSE 'west ' || s_suppkey END AS area, CASE i WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN CAST(s_suppkey + 1 AS VARCHAR) WHEN 3 THEN '7' END AS n FROM supplier, range(4) AS r(i)")
def src_power_bi(spark, sf_dir):
    """A payload a supplier: dictionary values, a repeated value, a null, a value of its own."""
    k = F.col("s_suppkey").cast("string")
    json = F.concat(F.lit('{"ValueDicts":{"D0":["north","south","west '), k, F.lit('"]},"PH":[{"DM0":[{"S":[{"N":"G0","DN":"D0"},{"N":"M0"}],"C":[0,'), k, F.lit(']},{"C":['), (F.col("s_suppkey") + 1).cast("string"), F.lit('],"R":1},{"C":[1],"Ø":2},{"C":[2,7]}]}]}'))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.posexplode(decode_rows(json)).alias("i", "r"))
    return d.select("id", F.col("i").cast("long").alias("i"), F.get("r", F.lit(0)).alias("area"), F.get("r", F.lit(1)).alias("n"))


@query("src_hamoked_html", "SELECT s_suppkey AS id, 2020 + s_suppkey % 5 AS year, m AS month, s_suppkey * m AS judged, s_suppkey + m AS held FROM supplier, range(1, 4) AS r(m)")
def src_hamoked_html(spark, sf_dir):
    """One record a month from a page's pillars."""
    k = F.col("s_suppkey")
    pillar = lambda m: F.concat(F.lit('<div class="pillar" data-judgment="'), (k * m).cast("string"), F.lit('" data-arrest="'), (k + m).cast("string"), F.lit(f'" data-month="{m}" data-year="'), (2020 + k % 5).cast("string"), F.lit('"></div>\n'))
    html = F.concat(F.lit("<html><body>"), *[pillar(m) for m in (1, 2, 3)], F.lit('<div class="other" data-month="9"></div></body></html>'))
    return pillars(table(spark, sf_dir, "supplier").select(k.alias("id"), html.alias("html")))


def pillars(pages: DataFrame) -> DataFrame:
    d = pages.select("id", F.explode(F.regexp_extract_all("html", F.lit(r'(<div class="pillar"[^>]*>)'), 1)).alias("p"))
    attr = lambda n: F.regexp_extract("p", f'data-{n}="([0-9]+)"', 1).cast("long")
    return d.select("id", attr("year").alias("year"), attr("month").alias("month"), attr("judgment").alias("judged"), attr("arrest").alias("held"))
