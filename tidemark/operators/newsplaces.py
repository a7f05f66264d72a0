"""Where a news text says that something happened: one fold over its tokens, candidates ranked, and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.register import query
from tidemark.sources.analogues import table

# ---- Fixed values, in normalised spelling: what opens a name, what ends one, who is a person, and the governorates.
SETTLEMENT = ["بلده", "قريه", "مخيم", "خربه", "مدينه", "ضاحيه", "قريتي", "بلدتي", "مدينتي", "مخيمي", "خربتي", "قريتين", "بلدتين", "مخيمين"]
STATION = ["حاجز", "مفرق", "مفترق", "دوار", "معبر"]
CUE = ["منطقه", "حي", "شارع", "سهل", "جبل", "واد", "وادي", "مدخل", "طريق", "بوابه", "مقام", "عزبه", "اراضي", "اطراف", "محيط", "قروي", "بلديه", "بلدي"]
BETWEEN, ENTRANCE = "بين", "مدخل"
PREFIX = ["بيت", "دير", "كفر", "عين", "خربه", "خله", "عزبه", "راس", "ام", "ابو", "عرب", "بير"]
BEARING = ["شمال", "جنوب", "شرق", "غرب", "شمالي", "جنوبي", "شرقي", "غربي"]
REGION_HEAD = ["مسافر", "الاغوار", "اغوار"]
GOVERNORATE = ["نابلس", "جنين", "طولكرم", "رام_الله", "الخليل", "طوباس", "قلقيليه", "سلفيت", "اريحا", "بيت_لحم", "القدس"]
PERSON = [
    "شاب", "شابا", "شابان", "شبان", "فتي", "فتاه", "طفل", "طفلا", "طفله", "مواطن", "مواطنا", "مواطنه", "مواطنان", "مواطنين", "اسير", "اسيرا", "اسيره", "اسري", "معتقل", "معتقلا", "شهيد", "شهيدا", "شهيده",
    "مسن", "مسنا", "مسنه", "سيده", "جريح", "مصاب", "عامل", "عاملا", "عائله", "اسره", "مطارد", "شابين", "فتيين", "طفلين", "اسيرين",
]
STOP = [
    "في", "من", "الي", "علي", "عن", "مع", "عند", "امام", "قرب", "قبل", "بعد", "خلال", "اثناء", "عقب", "منذ", "حتي", "هذا", "هذه", "ذلك", "التي", "الذي", "وسط", "عبر", "بين", "صباح", "مساء", "فجر", "فجرا", "ظهر", "ليله", "يوم", "امس", "الان", "قليل",
    "قوات", "احتلال", "جيش", "جنود", "مستوطن", "مستوطنون", "مستوطنين", "مستوطنات", "مواطنون", "قري", "بلدات", "مدن", "مخيمات", "محيطه", "مجاوره", "محتله", "محافظه", "لا", "لم", "ما", "كل", "احد", "ثم", "لكن", "حيث", "كما", "بينما", "ضفه", "غربيه", "قضاء", "لواء", "ضواحي", "داخل", "خارج", "خلف", "مقابل", "باتجاه", "نحو", "تجاه", "ضد", "بعض", "عدد", "اصابه", "اصابات", "اعتقال", "اقتحام", "مواجهات", "اندلاع", "اطلاق",
    "واعتقلت", "اعتقلت", "اعتقل", "تعتقل", "يعتقل", "اقتحمت", "اقتحم", "تقتحم", "يقتحم", "يقتحمون", "داهمت", "تداهم", "يداهم", "ويداهم", "هدمت", "تهدم", "اغلقت", "تغلق", "اغلق", "يهاجم", "يهاجمون", "هاجم", "هاجموا", "انسحبت", "استشهد", "استشهاد", "اصيب", "نصبت", "تنصب",
]
#: How much a way of finding a name is trusted, best first.
RANK = {"settlement": 0, "station": 0, "cue": 1, "bearing": 1, "prefix": 2, "between": 3, "conjunct": 4}
LONGEST, NEAR, END = 3, 6, "."

_found = "array<struct<rank: int, pos: int, name: string, how: string>>"


def tokens(text: Column) -> Column:
    """Normalised tokens; the governorates of two words are one token each."""
    joined = X.normalize(text)
    for name in (g for g in GOVERNORATE if "_" in g):
        joined = F.regexp_replace(joined, rf"(?<=^|\s|\s[بلكفو]|^[بلكفو]){name.replace('_', ' ')}(?=\s|$)", name)
    return F.split(joined, " ")


def _features(x: Column) -> Column:
    """What a token is by itself, also behind one letter that is written onto it."""
    cut = F.when(x.rlike("^[بلكفو]...*"), F.substring(x, 2, 1000))
    bare = F.when(cut.startswith("ال"), F.substring(cut, 3, 1000)).otherwise(cut)
    loose = F.when(x.startswith("ال"), F.substring(x, 3, 1000)).when(x.startswith("لل"), F.substring(x, 3, 1000)).otherwise(bare)
    either = lambda words: F.when(x.isin(words), x).when(cut.isin(words), cut)
    how = F.when(x == BETWEEN, "between").when(either(SETTLEMENT).isNotNull(), "settlement").when(either(STATION).isNotNull(), "station").when(either(CUE).isNotNull(), "cue")
    stops = x.isin(STOP) | F.coalesce(cut.isin(STOP), F.lit(False)) | F.coalesce(loose.isin(STOP), F.lit(False))
    head = x.isin(REGION_HEAD) | F.coalesce(cut.isin(REGION_HEAD), F.lit(False))
    return F.struct(
        x.alias("x"), how.alias("how"), (either(CUE) == ENTRANCE).alias("entrance"), either(GOVERNORATE).alias("gov"), either(PREFIX).alias("pre"), x.isin(BEARING).alias("bearing"), head.alias("head"),
        (x.isin(PERSON) | F.coalesce(loose.isin(PERSON), F.lit(False))).alias("person"), ((F.length(x) < 2) | x.rlike("^[0-9]+$") | stops | head | x.isin(BEARING)).alias("stop"), (x.startswith("و") & (F.length(x) > 3)).alias("waw"),
    )


def _step(s: Column, x: Column) -> Column:
    none, empty = F.lit(None).cast("string"), F.size(s["name"]) == 0
    resident = s["last"].isin("من", "ومن") & (s["pos"] - s["person"] <= NEAR)
    inside, firm = s["mode"].isNotNull(), s["mode"].isin("settlement", "station")
    opens = x["how"].isNotNull() & ~(resident & x["how"].isin("settlement", "station")) & ~((x["how"] == "cue") & x["x"].isin("حي") & s["last"].contains("رصاص"))
    city = inside & empty & x["gov"].isNotNull() & (firm | s["entrance"])
    grows = inside & ~x["stop"] & x["gov"].isNull() & (x["how"].isNull() | ((x["how"] == "cue") & empty & firm)) & ~(x["waw"] & ~empty)
    full = grows & (F.size(s["name"]) == LONGEST - 1)
    parts = inside & ~empty & x["waw"] & ~x["stop"] & x["gov"].isNull() & x["how"].isNull() & (s["mode"] != "conjunct")
    ended = inside & ~empty & ~grows & (parts | (s["mode"] != "between"))
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in RANK.items() for v in kv]), s["mode"])
    hit = lambda on, r, at, name, how: F.when(on, F.struct(r.cast("int").alias("rank"), at.cast("int").alias("pos"), name.alias("name"), how.alias("how")))
    prefixed = s["pre"].isNotNull() & ~x["stop"] & ~x["person"] & x["gov"].isNull() & x["how"].isNull() & ~x["waw"]
    borne = x["gov"].isNotNull() & (F.coalesce(F.size(s["pending"]), F.lit(0)) > 0)
    hits = F.filter(
        F.array(
            hit(city, rank, s["at"], x["gov"], s["mode"]),
            hit(full, rank, s["at"], F.concat_ws(" ", s["name"], x["x"]), s["mode"]),
            hit(ended, rank, s["at"], F.concat_ws(" ", s["name"]), s["mode"]),
            hit(borne, F.lit(RANK["bearing"]), s["pos"], F.concat_ws(" ", s["pending"]), F.lit("bearing")),
            hit(prefixed, F.lit(RANK["prefix"]), s["pos"], F.concat_ws(" ", s["pre"], x["x"]), F.lit("prefix")),
        ),
        lambda h: h.isNotNull(),
    )
    no_words = F.array().cast("array<string>")
    grown = F.concat(s["tail"], F.array(x["x"]))
    tail = (
        F.when(x["head"] | x["bearing"], F.lit(None).cast("array<string>")).when(x["stop"] | x["person"] | x["how"].isNotNull() | x["gov"].isNotNull(), no_words)
        .when(x["waw"], F.array(F.substring(x["x"], 2, 1000))).otherwise(F.slice(grown, F.greatest(F.size(grown) - (LONGEST - 1), F.lit(1)), LONGEST))
    )
    stays = grows & ~full
    return F.struct(
        F.when(city | full, none).when(stays, s["mode"]).when(parts, F.lit("conjunct")).when(opens, x["how"]).alias("mode"),
        F.when(stays, F.concat(s["name"], F.array(x["x"]))).when(parts, F.array(F.substring(x["x"], 2, 1000))).otherwise(no_words).alias("name"),
        F.when(stays, s["entrance"]).otherwise(F.coalesce(x["entrance"], F.lit(False))).alias("entrance"), F.when(stays, s["at"]).otherwise(s["pos"]).alias("at"), (s["pos"] + 1).alias("pos"),
        F.when(x["person"], s["pos"]).otherwise(s["person"]).alias("person"), x["x"].alias("last"), tail.alias("tail"), F.when(x["bearing"], F.coalesce(s["pending"], s["tail"])).alias("pending"),
        F.when(~resident, x["pre"]).alias("pre"), F.coalesce(s["gov"], x["gov"]).alias("gov"), F.when(F.size(hits) > 0, F.concat(s["found"], hits)).otherwise(s["found"]).alias("found"),
    )


def read_places(text: Column) -> Column:
    """struct(names, governorate): every candidate name, the most trusted first, and the governorate named first.

    A word for a settlement, a station or a site opens a name of up to three tokens; a stop word, a
    bearing, a governorate or the next opener ends it; a leading "and" ends it and begins another. A
    settlement after "from" with a person shortly before is that person's home and is passed over, not the site.
    Also found: what stands before a bearing and a governorate, a toponym's first word with the next
    one, and both of "between X and Y". A governorate is itself the place behind a word for a
    settlement or an entrance. Null and empty texts have no names.
    """
    words = F.concat(tokens(F.coalesce(text, F.lit(""))), F.array(F.lit(END)))
    zero = F.expr(f"named_struct('mode', CAST(NULL AS STRING), 'name', CAST(array() AS array<string>), 'entrance', false, 'at', 0, 'pos', 0, 'person', -1000, 'last', '', 'tail', CAST(array() AS array<string>), 'pending', CAST(NULL AS array<string>), 'pre', CAST(NULL AS STRING), 'gov', CAST(NULL AS STRING), 'found', CAST(array() AS {_found}))")
    spaced = lambda c: F.translate(c, "_", " ")
    return F.aggregate(
        F.transform(words, _features), zero, _step, lambda s: F.struct(F.array_distinct(F.transform(F.array_sort(s["found"]), lambda f: spaced(f["name"]))).alias("names"), spaced(s["gov"]).alias("governorate"))
    )


_KNOWN = sorted({*SETTLEMENT, *STATION, *CUE, BETWEEN, ENTRANCE, *PREFIX, *BEARING, *REGION_HEAD, *GOVERNORATE, *PERSON, *STOP})


def shape(words: Column) -> Column:
    """Tokens as far as the fold can tell them apart, as a text: one that it cannot know is x and the place of its first occurrence. Names read of it, with `named`, are those of the text.

    The fold takes at most three letters off a token's head; a leading "and", a single letter, numbers and bullets it sees by themselves.
    """
    ends = lambda w: F.substring(w, 1, 1000).isin(_KNOWN) | F.substring(w, 2, 1000).isin(_KNOWN) | F.substring(w, 3, 1000).isin(_KNOWN) | F.substring(w, 4, 1000).isin(_KNOWN)
    kept = lambda w: ends(w) | (F.length(w) < 2) | w.startswith("و") | w.contains("رصاص") | w.rlike("^[0-9]+$")
    return F.array_join(F.transform(words, lambda w: F.when(kept(w), w).otherwise(F.concat(F.lit("x"), F.array_position(words, w).cast("string")))), " ")


def named(name: Column, words: Column) -> Column:
    """A name that was read of a shape, in the words of its text."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.when(w.rlike("^x[0-9]+$"), F.get(words, F.substring(w, 2, 1000).cast("int") - 1)).otherwise(w)), " ")


def located(news: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """News (id, text) to rows (id, place_id, name, governorate): the most trusted candidate that the gazetteer (place_id, name, governorate) knows.

    A place in another governorate than the one that the text names is none. Of places of one name in the
    right governorate, or where the text names none, only a single one is taken: twins stay open.
    """
    said = news.select("id", read_places(F.col("text")).alias("r")).select("id", "r.governorate", F.posexplode("r.names").alias("rank", "name"))
    known = gazetteer.select(F.col("place_id"), F.array_join(tokens(F.col("name")), " ").alias("key"), F.translate(F.array_join(tokens(F.col("governorate")), " "), "_", " ").alias("gov"))
    known = known.withColumn("key", F.translate("key", "_", " "))
    met = said.join(known, (F.col("name") == F.col("key")) & F.coalesce(F.col("governorate") == F.col("gov"), F.lit(True)))
    per = met.groupBy("id", "rank", "name").agg(F.min("place_id").alias("place_id"), F.max("place_id").alias("_hi"), F.min("gov").alias("gov"))
    best = per.where("place_id = _hi").groupBy("id").agg(F.min_by(F.struct("place_id", "name", "gov"), "rank").alias("b"))
    return best.select("id", "b.place_id", "b.name", F.col("b.gov").alias("governorate"))


_SAID = ["قوات الاحتلال تقتحم بلدة {} جنوب {}", "مستوطنون يهاجمون الرعاة في {} شرق {}", "اعتقال الشاب احمد من قرية الدير علي مفرق {} في {}", "اغلاق حاجز {} وحاجز زعترة غرب {}"]
_GOV = [g.replace("_", " ") for g in GOVERNORATE]
_NAMES = ", ".join(f"({k}, '{g}')" for k, g in enumerate(_GOV))


@query("tx_news_places", f"WITH g(k, governorate) AS (VALUES {_NAMES}) SELECT event_id AS id, c_custkey AS place_id, 'موضع' || c_custkey AS name, governorate FROM events JOIN customer ON user_id = c_custkey AND event_id % {len(_GOV)} = c_nationkey % {len(_GOV)} JOIN g ON event_id % {len(_GOV)} = k")
def tx_news_places(spark, sf_dir):
    """A message an event, placed among as many places as customers; those in another governorate than the message's don't answer."""
    gov = lambda key: F.get(F.array(*map(F.lit, _GOV)), (F.col(key) % len(_GOV)).cast("int"))
    name = lambda key: F.concat(F.lit("موضع"), F.col(key).cast("string"))
    said = F.get(F.array(*[F.lit(t.replace("{}", "%s")) for t in _SAID]), F.pmod(F.xxhash64("event_id"), F.lit(len(_SAID))).cast("int"))
    parts = F.split(said, "%s")
    news = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(parts[0], name("user_id"), parts[1], gov("event_id"), parts[2]).alias("text"))
    return located(news, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), name("c_custkey").alias("name"), gov("c_nationkey").alias("governorate")))
