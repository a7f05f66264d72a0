"""Places in news: what a reader of each line would say, and their resolution."""

from pyspark.sql import functions as F

from tidemark.operators import newsplaces

CASES = [
    ("قوات الاحتلال تداهم منزلا خلال اقتحامها لبلدة إذنا", "اذنا", None), ("اقتحام قوات الاحتلال لمدينة سلفيت", "سلفيت", "سلفيت"), ("تواصل قوات الاحتلال اقتحامها لبلدة بيت أمر شمال الخليل", "بيت امر", "الخليل"),
    ("إطلاق الرصاص الحي صوب الشبان خلال اقتحام قرية المغير، شمال رام الله", "المغير", "رام الله"), ("قوات الاحتلال تقتحم قرية جنيد والقرى المحيطة بمدينة نابلس", "جنيد", "نابلس"), ("٣ اصابات بالرصاص الحي في بيت امر قرب الخليل", "بيت امر", "الخليل"),
    ("قوات الاحتلال تداهم منزل عائلة النابلسي في البلدة القديمة", None, None), ("اصابة شاب برصاص الاحتلال خلال المواجهات بنابلس", None, "نابلس"), ("اعتقالات في مدن الضفة والخليل تشهد مواجهات عنيفة", None, "الخليل"),
    ("اعتقل الاحتلال الشاب خليل عوض خلال اقتحام بلدة قباطية جنوب جنين", "قباطيه", "جنين"), ("فقدت سيدة جنينها بعد احتجازها لساعات على حاجز عورتا", "عورتا", None), ("اعتقلت قوات الاحتلال الشاب محمد صلاح من قرية المغير على مفرق فصايل", "فصايل", None),
    ("انسحبت قوات الاحتلال من بلدة يعبد بعد اقتحام استمر ساعات", "يعبد", None), ("اغلق جيش الاحتلال حاجز حوارة جنوب نابلس امام المركبات", "حواره", "نابلس"), ("مسـ.ـتوطن يهاجم مركبة أحد المواطنين بين قريتي المغير وأبو فلاح شرق رام الله", "المغير", "رام الله"),
    ("مستوطنون يهاجمون الرعاة في يرزا شرق طوباس", "يرزا", "طوباس"), ("مواجهات عند مدخل نابلس", "نابلس", "نابلس"), ("اغلاق شارع نابلس", None, "نابلس"), ("جرافات تعمل في مسافر يطا جنوب الخليل", None, "الخليل"),
    ("مستوطنون يقتحمون قرية زويدين شرق يطا جنوب الخليل", "زويدين", "الخليل"), ("اطلاق رصاص حي باتجاه المركبات", None, None), ("اقتحام بلدة بيت لحم", "بيت لحم", "بيت لحم"), ("قوات الاحتلال تقتحم منطقة الديرات", "الديرات", None),
    ("اعتقال شابا من بيت أمر ويداهم منازل في كفر قدوم", "كفر قدوم", None), ("قوات الاحتلال تقتحم قرية وادي فوكين غرب بيت لحم", "وادي فوكين", "بيت لحم"), ("", None, None), (None, None, None), ("بلدة", None, None),
]
MORE = {
    "بين قريتي جالود وقصرة": ["جالود", "قصره"], "اغلاق الطريق بين مركة وقباطية": ["مركه", "قباطيه"], "اقتحام بلدة عقربا وبلدة بيتا": ["عقربا", "بيتا"], "حي الطيرة في بلدة سلواد": ["سلواد", "الطيره"], "بلدة بيتا ثم بلدة بيتا": ["بيتا"], "كلام بين الناس فقط": [],
}


def test_places_of_lines(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(CASES)], "id long, text string")
    got = {r.id: (r.r.names[0] if r.r.names else None, r.r.governorate) for r in rows.select("id", newsplaces.read_places(F.col("text")).alias("r")).collect()}
    wrong = {CASES[k][0]: (v, CASES[k][1:]) for k, v in got.items() if v != CASES[k][1:]}
    assert not wrong, "\n".join(map(str, wrong.items()))


def test_all_candidates(spark):
    rows = spark.createDataFrame([(t,) for t in MORE], "text string")
    got = {r.text: r.r.names for r in rows.select("text", newsplaces.read_places(F.col("text")).alias("r")).collect()}
    assert got == MORE


def test_located(spark):
    gazetteer = spark.createDataFrame([(1, "المغير", "رام الله"), (2, "المغير", "جنين"), (3, "بيت أمر", "الخليل"), (4, "سلواد", "رام الله"), (5, "بيت لحم", "بيت لحم"), (6, None, None)], "place_id long, name string, governorate string")
    said = {1: ("اقتحام قرية المغير شمال رام الله", 1), 2: ("اقتحام قرية المغير", None), 3: ("اصابات في بيت امر", 3), 4: ("اقتحام بلدة بيت امر شمال جنين", None), 5: ("حي الطيرة في بلدة سلواد", 4), 6: ("اقتحام مدينة بيت لحم", 5), 7: (None, None)}
    got = {r.id: r.place_id for r in newsplaces.located(spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "id long, text string"), gazetteer).collect()}
    assert got == {k: v for k, (_, v) in said.items() if v}
