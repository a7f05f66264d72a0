"""News: an ordered cascade of refusals, incident kinds and guards, and where it happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.newsplaces import named, read_places, shape, tokens
from tidemark.plans.register import query
from tidemark.plans.steps import written
from tidemark.sources.analogues import table

# ---- Fixed values, in normalised spelling: what is no report of an event, what kinds of event there are, and what takes a kind back.
REFUSED = [("advert", "للبيع|خصم|عرض خاص"), ("weather", "حاله الطقس|درجات الحراره"), ("religion", "خطبه الجمعه|اذكار"), ("anniversary", "ذكري|في مثل هذا اليوم"), ("opinion", "بقلم|مقال")]
KINDS = [
    ("settler_attack", "مستوطن\\S* (?:يهاجم|هاجم|يعتدي|اعتد|يحرق|احرق)\\S*"), ("death", "استشهد|استشهاد|ارتقي"), ("injury", "اصيب|اصابه|اصابات"), ("arrest", "اعتقل\\S*|تعتقل|يعتقل\\S*|اعتقال"),
    ("demolition", "هدم\\S*|تهدم|يهدم\\S*"), ("land_levelling", "تجريف|تجرف|جرفت"), ("raid", "اقتحم\\S*|تقتحم|يقتحم\\S*|اقتحام|مداهمه"), ("closure", "اغلق\\S*|تغلق|اغلاق|نصب حاجز"),
]
FUNERAL, RELEASE, HARM, AGAIN = "تشييع|جنازه|بيت عزاء|ينعي", "افرج\\S*|يفرج|الافراج|تفرج", "ضرب|تعذيب", "الاسير المحرر"
ACCIDENT, TESTIMONY, SIEGE = "حادث سير|حادث طرق", "يروي|يتحدث عن|شهاده", "حصار"
SETTLER, ARMY, HOMES, REOPENED = "مستوطن", "قوات|جيش|جنود", "منزل|منازل|بيوت", "اعاده فتح|فتح\\S* بعد"


def first_of(norm: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(norm.rlike(p), n) for n, p in rules])


def read(news: DataFrame) -> DataFrame:
    """News (id, text) to rows (id, verdict, kind, reason, place, region, confidence). Places are read where nothing else decides, and once a shape."""
    n = F.col("norm")
    d = news.select("id", "text", X.normalize(F.col("text")).alias("norm")).withColumn("refused", first_of(n, REFUSED)).withColumn("kind", first_of(n, KINDS))
    before = F.regexp_extract(n, "^(.*?)(?:اقتحم|تقتحم|يقتحم|اقتحام|مداهمه)", 1)
    kind = F.when((F.col("kind") == "raid") & before.rlike(SETTLER) & ~before.rlike(ARMY), "settler_attack").when((F.col("kind") == "land_levelling") & n.rlike(HOMES), "demolition").otherwise(F.col("kind"))
    guard = (
        F.when((F.col("kind") == "death") & n.rlike(FUNERAL), "obituary or funeral").when((F.col("kind") == "arrest") & n.rlike(RELEASE) & ~n.rlike(HARM) & ~n.rlike(AGAIN), "release")
        .when(F.col("kind").isin("injury", "death") & n.rlike(ACCIDENT), "traffic accident").when(n.rlike(TESTIMONY) & ~n.rlike(SIEGE), "testimony").when((F.col("kind") == "closure") & n.rlike(REOPENED), "reopening")
    )
    short = F.col("text").isNull() | (F.length(F.btrim("text")) < 25)
    reason = F.when(short, "too short").when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("kind").isNull(), "no incident verb").otherwise(guard)
    d = d.select("id", "text", kind.alias("kind"), reason.alias("reason"), F.col("kind").isNull().alias("none"), (short | F.col("refused").isNotNull()).alias("out"))
    d = d.withColumn("words", F.when(F.col("reason").isNull(), tokens(F.col("text")))).drop("text")
    d = written(d.withColumn("shape", shape(F.col("words"))), "news")
    places = written(d.where("shape IS NOT NULL").select("shape").distinct().select("shape", read_places(F.col("shape")).alias("places")), "places")  # its size tells Spark whether they are few
    d = d.join(places, "shape", "left").withColumn("place", named(F.get("places.names", F.lit(0)), F.col("words"))).withColumn("region", F.col("places.governorate"))
    nowhere = F.col("place").isNull() & F.col("region").isNull()
    verdict = F.when(F.col("out"), "rejected").when(F.col("none"), "unclear").when(F.col("reason").isNotNull(), "rejected").when(nowhere, "unclear").otherwise("incident")
    ok = verdict == "incident"
    conf = F.when(F.col("place").isNotNull() & F.col("region").isNotNull(), 0.80).when(F.col("place").isNotNull(), 0.70).otherwise(0.55)
    return d.select(
        "id", verdict.alias("verdict"), F.when((verdict != "rejected") & ~F.col("none"), F.col("kind")).alias("kind"), F.when(ok, F.lit(None)).otherwise(F.coalesce("reason", F.lit("no place"))).alias("reason"),
        F.when(ok, F.col("place")).alias("place"), F.when(ok, F.col("region")).alias("region"), F.when(ok, conf).alias("confidence"),
    )


#: What outlets write, and how it must be read: (verdict, kind, reason, place?, region, confidence).
NEWS = [
    ("قوات الاحتلال تقتحم بلدة {} جنوب نابلس صباح اليوم", ("incident", "raid", None, True, "نابلس", 0.80)), ("مستوطنون يقتحمون منازل في قرية {} هذا المساء", ("incident", "settler_attack", None, True, None, 0.70)),
    ("جرافات الاحتلال تجرف منازل المواطنين في خربة {} شرق طوباس", ("incident", "demolition", None, True, "طوباس", 0.80)), ("الاحتلال يعتقل شابين من مخيم {} في جنين فجرا", ("incident", "arrest", None, False, "جنين", 0.55)),
    ("الاحتلال يفرج عن الاسير بعد اعتقال دام عشرين عاما من {}", ("rejected", None, "release", False, None, None)), ("تشييع جثمان الشهيد الذي استشهد امس في {} والالاف يشاركون", ("rejected", None, "obituary or funeral", False, None, None)),
    ("اصابة ثلاثة مواطنين في حادث سير قرب بلدة {} غرب جنين", ("rejected", None, "traffic accident", False, None, None)), ("في مثل هذا اليوم اقتحمت قوات الاحتلال مخيم {} قبل سنوات", ("rejected", None, "anniversary", False, None, None)),
    ("قوات الاحتلال تقتحم المنطقة الشرقية من الخليل قبل قليل", ("incident", "raid", None, False, "الخليل", 0.55)), ("اغلاق الطريق الرئيسي قبل قليل ولا مكان معروف للحدث", ("unclear", "closure", "no place", False, None, None)),
    ("اعادة فتح الطريق بعد اغلاق دام ساعات في بلدة {}", ("rejected", None, "reopening", False, None, None)), ("خبر", ("rejected", None, "too short", False, None, None)), ("اجتماع المجلس البلدي لبحث ميزانية العام القادم في {}", ("unclear", None, "no incident verb", False, None, None)),
]


def _q(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v).lower()


_SAID = ", ".join(f"({k}, {', '.join(map(_q, want))})" for k, (_, want) in enumerate(NEWS))


@query("tx_news", f"WITH w(k, verdict, kind, reason, named, region, confidence) AS (VALUES {_SAID}) SELECT event_id AS id, verdict, kind, reason, CASE WHEN named THEN 'موضع' || user_id END AS place, region, confidence FROM events JOIN w ON event_id % {len(NEWS)} = k")
def tx_news(spark, sf_dir):
    """A message an event, in the words of its kind; the SQL knows what the messages were made to say."""
    e = table(spark, sf_dir, "events")
    text = F.replace(F.get(F.array(*[F.lit(t) for t, _ in NEWS]), (F.col("event_id") % len(NEWS)).cast("int")), F.lit("{}"), F.concat(F.lit("موضع"), F.col("user_id").cast("string")))
    return read(e.select(F.col("event_id").alias("id"), text.alias("text")))
