"""Report lines: a grammar that reads free text about a road into facts, by tokens, windows and joins.

A line is split into clauses, a clause into tokens; a lexicon gives tokens an axis and a value;
negators, clearing verbs, conditions and forecasts change or void them; each status binds to the
nearest direction of its clause; of several flow values of one direction the most restrictive
stays. Questions are kept as questions, lines without facts as unparsed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.register import query
from tidemark.plans.steps import written
from tidemark.sources.analogues import table

# ---- Fixed values: the words that channels use, in normalised spelling, one a string.
FLOW = {
    "open": ["سالك", "سالكه", "سالكين", "مفتوح", "مفتوحه", "مفتوحين", "فاتح", "فاتحه", "فتح", "فتحت", "فتحوا", "فاتحين", "انفتح", "نظيف", "ماشي", "ماشيه", "طبيعي", "عادي"],
    "slow": ["بطيء", "بطئ", "بطيئ", "بطيه", "متقطع"],
    "congested": [
        "زحمه", "ازمه", "مزحوم", "ضاغط", "ضغط", "مزدحم", "مزدحمه", "ازدحام", "اختناق", "وقفه", "واقف", "واقفه", "كثافه", "تكدس",
        "زاطم", "زاطمه", "مزطوم", "زطمه", "مازمه",
    ],
    "closed": [
        "مغلق", "مغلقه", "مغلقين", "مقفل", "مقفله", "مسكر", "مسكره", "موقوف", "مسدود", "مسدوده", "سكروا", "سكر", "اغلاق",
        "مغلقان", "مغلقتان", "مغلقتين", "مسكرين", "مسكرات", "مقفول", "مقفوله", "مقفولين", "سكروه", "سكرت", "اغلق", "اغلقت", "يغلق", "تغلق",
    ],
}
PRESENCE = {
    "idf": ["جيش", "عسكر", "مداهمه", "دبابات", "جنود", "عسكري"],
    "police": ["شرطه", "دوريه"],
    "settlers": ["مستوطنين", "مستوطنون", "مستوطن", "مستوطين", "قطعان"],
    "inspection": ["تفتيش", "يفتشو", "بفتشو", "تدقيق", "هويات"],
}
DIRECTION = {
    "inbound": ["للداخل", "الداخل", "داخل", "للدخول", "دخول", "جوا", "لجوا", "الداخلين", "الوارد", "لداخل"],
    "outbound": ["لخارج", "للخارج", "الخارج", "خارج", "للخروج", "خروج", "برا", "لبرا", "الخارجين", "الصادر"],
    "both": ["بالاتجاهين", "الاتجاهين", "اتجاهين", "الاتجاهات", "الطرفين", "الجهتين", "بالجهتين", "عالجهتين", "للجهتين", "عالاتجاهين"],
}
PHRASES = [
    ("مش سالك", "flow", "closed"), ("مش فاتح", "flow", "closed"), ("غير سالك", "flow", "closed"), ("مو سالك", "flow", "closed"), ("مش ماشي", "flow", "closed"), ("ما بيمشي", "flow", "closed"),
    ("نصب حاجز", "presence", "idf"), ("عمل حاجز", "presence", "idf"), ("حاجز طيار", "presence", "idf"), ("حواجز طياره", "presence", "idf"),
    ("حطو محسوم", "presence", "idf"), ("حطوا محسوم", "presence", "idf"), ("نصب محسوم", "presence", "idf"), ("في محسوم", "presence", "idf"), ("فيه محسوم", "presence", "idf"), ("محسوم طيار", "presence", "idf"),
    ("حطو حاجز", "presence", "idf"), ("حطوا حاجز", "presence", "idf"), ("فيه جيش", "presence", "idf"), ("عليه جيش", "presence", "idf"), ("سيارات الجيش", "presence", "idf"), ("سياره جيش", "presence", "idf"),
    ("فيه شرطه", "presence", "police"), ("سياره شرطه", "presence", "police"), ("دوريه شرطه", "presence", "police"), ("تفتيش هويات", "presence", "inspection"), ("تفتيش دقيق", "presence", "inspection"),
    ("فيه ضغط", "flow", "congested"), ("فيه زحمه", "flow", "congested"), ("في ازمه", "flow", "congested"), ("كثافه سير", "flow", "congested"), ("حركه خفيفه", "flow", "open"), ("سير طبيعي", "flow", "open"),
    ("في حاجز", "presence", "idf"), ("فيه حاجز", "presence", "idf"),
    ("منع المرور", "flow", "closed"), ("منعو المرور", "flow", "closed"), ("منعوا المرور", "flow", "closed"), ("ممنوع المرور", "flow", "closed"), ("المرور ممنوع", "flow", "closed"),
    ("ومنع المرور", "flow", "closed"), ("ومنعو المرور", "flow", "closed"), ("ومنعوا المرور", "flow", "closed"),
    ("ممنوع الدخول", "flow", "closed"), ("ممنوع الخروج", "flow", "closed"), ("منع الدخول", "flow", "closed"), ("منع الخروج", "flow", "closed"), ("منعوا الدخول", "flow", "closed"), ("منعوا الخروج", "flow", "closed"), ("منعو الدخول", "flow", "closed"), ("منعو الخروج", "flow", "closed"),
    ("فتح النار", "presence", "idf"), ("فتحوا النار", "presence", "idf"), ("فتحت النار", "presence", "idf"), ("فتحو النار", "presence", "idf"), ("وفتحوا النار", "presence", "idf"), ("اطلاق النار", "presence", "idf"), ("اطلاق نار", "presence", "idf"),
]
#: A phrase that closes one direction names it.
PHRASE_DIRECTION = {"الدخول": "inbound", "الخروج": "outbound"}
CLEARING = [
    "انسحب", "انسحبوا", "انسحبت", "شالو", "شالوا", "شال", "رفعوا", "رفع", "ازالوا", "فكوا", "راح", "راحت", "راحوا", "غادر", "غادروا", "تركوا", "خلص", "خلصت", "انتهي", "انتهت",
    "فتحوه", "فتحوها", "انفكت", "انفك", "فكت", "زالت",
]
NEGATORS = ["مش", "ما", "مو", "بدون", "بلا", "غير"]
ABSENT = ["مافي", "مافيش", "مافيه", "مفيش", "فش", "فيش", "ماكو"]
EXISTS = ["في", "فيه", "يوجد", "يوجدش"]
PRONOUNS = ["هو", "هي", "هم", "هوه", "هيه"]
STILL = ["زال", "زالت", "زالوا", "زالا", "يزال", "تزال"]
RELATIVE = ["بعد", "قبل", "زي", "زى", "مثل", "حسب", "كل", "اول", "عقب", "طول", "عشان", "وقت", "بس"]
CONDITIONS = ["اذا", "لو", "بحال"]
FUTURE = ["راح", "رح", "بدهم", "بده", "بدو", "بدها"]
NOUNS = ["ازمه", "زحمه", "اختناق", "ازدحام", "كثافه", "تكدس", "اغلاق", "ضغط"]
OBSTACLES = ["حاجز", "حواجز", "بوابه", "بوابات", "محسوم", "اغلاق", "ازمه", "زحمه", "سواتر", "مكعبات"]
ASKING = ["شو", "وش", "ايش", "كيف", "كيفك", "وين", "مين", "هل", "ليش", "متي", "شومع", "شومعليش", "امتي", "قديش", "بكم"]
ASKED = [
    "شو وضع", "شو اخبار", "شو الوضع", "حدا يعرف", "مين بيعرف", "حدا بيعرف", "بدنا نعرف", "بدي اعرف", "في حدا", "شو صار", "يعطينا دليل", "اعطونا دليل", "مين متاكد", "مش متاكد", "حدا متاكد",
    "ما بعرف", "مابعرف", "حد بعرف", "حد يعرف", "بعرف اذا", "مش عارف", "مش عارفين",
]
EMOJI = {"✅": "open", "🟢": "open", "🟩": "open", "✔": "open", "☑": "open", "🟠": "congested", "🟧": "congested", "🟡": "slow", "🟨": "slow", "❌": "closed", "⛔": "closed", "🚫": "closed", "🛑": "closed"}
SEVERITY = ["open", "slow", "congested", "closed"]
FLIP = {"open": "closed", "closed": "open", "congested": "open", "slow": "open"}
CLAUSES = r"[،؛,\n\r]+|\s+[-–—]\s+|\s+و\s+"


def lookup(tok: Column, words: dict[str, list[str]]) -> Column:
    """The value of a token, of it without a fused article, or without a fused conjunction, or without drawn-out letters. Words are folded as texts are."""
    fold = str.maketrans(X.FOLD_FROM, X.FOLD_TO)
    folded = {w.translate(fold): value for value, ws in words.items() for w in ws}
    table_ = F.create_map(*[F.lit(x) for kv in folded.items() for x in kv])
    bare, drawn = F.regexp_replace(tok, "^(?:لل|[بلكفو]ال|ال)", ""), F.regexp_replace(tok, r"(.)\1{2,}", "$1")
    forms = [tok, F.when(F.length(bare) >= 3, bare), F.when((F.length(tok) >= 4) & tok.startswith("و"), F.substring(tok, 2, 99)), F.when(F.length(drawn) >= 3, drawn)]
    return F.coalesce(*[F.try_element_at(table_, f) for f in forms])


def among(tok: Column, words: list[str]) -> Column:
    """Whether a token is one of the words, allowing a fused article or conjunction."""
    return F.coalesce(tok.isin(words) | F.regexp_replace(tok, "^(?:و?ال|و|لل)", "").isin(words), F.lit(False))


def pick(x: Column, values: dict[str, str]) -> Column:
    return reduce(lambda out, kv: F.when(x == kv[0], kv[1]).otherwise(out), values.items(), F.lit(None).cast("string"))


def is_question(text: Column) -> Column:
    norm = X.normalize(text)
    toks = F.split(norm, " ")
    head = F.arrays_overlap(F.slice(toks, 1, 2), F.array(*map(F.lit, ASKING)))
    short = (F.size(toks) <= 6) & F.arrays_overlap(toks, F.array(*map(F.lit, ASKING)))
    return text.rlike("[؟?]") | norm.rlike("|".join(ASKED)) | head | short


def tokens(lines: DataFrame) -> DataFrame:
    """lines (id, text) to rows (id, c, raw, i, tok, ...) with what each token is; phrases become one token and fillers, so that places stay."""
    d = lines.select("id", F.posexplode(F.split("text", CLAUSES)).alias("c", "raw")).withColumn("s", F.concat(F.lit(" "), X.normalize(F.col("raw")), F.lit(" ")))
    for k, (phrase, _, _) in enumerate(PHRASES):
        d = d.withColumn("s", F.replace("s", F.lit(f" {phrase} "), F.lit(f" @{k}{' _' * phrase.count(' ')} ")))
    t = d.select("id", "c", "raw", F.posexplode(F.split(F.btrim("s"), " ")).alias("i", "tok"))
    axis = pick(F.col("tok"), {f"@{k}": a for k, (_, a, _) in enumerate(PHRASES)})
    value = pick(F.col("tok"), {f"@{k}": v for k, (_, _, v) in enumerate(PHRASES)})
    way = pick(F.col("tok"), {f"@{k}": d for k, (p, _, _) in enumerate(PHRASES) if (d := PHRASE_DIRECTION.get(p.split(" ")[-1]))})
    peeled = F.when((F.length("tok") >= 3) & F.col("tok").rlike("^[وف]") & F.substring("tok", 2, 99).isin(NEGATORS + ABSENT), F.substring("tok", 2, 99)).otherwise(F.col("tok"))
    return t.select(
        "*", axis.alias("p_axis"), value.alias("p_value"), lookup(F.col("tok"), FLOW).alias("flow"), lookup(F.col("tok"), PRESENCE).alias("pres"), F.coalesce(lookup(F.col("tok"), DIRECTION), way).alias("dir"),
        F.when(peeled.isin(NEGATORS + ABSENT + ["لا", "ولا"]), peeled).alias("neg"), F.regexp_replace("tok", "^و", "").isin(CLEARING).alias("clear"),
    )


#: Every word that the grammar looks for. A lookup takes at most five letters off a token's head, or draws letters in that were drawn out.
WORDS = sorted({w.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO)) for ws in [*FLOW.values(), *PRESENCE.values(), *DIRECTION.values(), CLEARING, NEGATORS, ABSENT, EXISTS, PRONOUNS, STILL, RELATIVE, CONDITIONS, FUTURE, NOUNS, OBSTACLES, *([p] for p, _, _ in PHRASES)] for x in ws for w in [*x.split(" "), x]} | {"لا", "ولا", "واقف", "واقفه", "وقفه", "موقوف", "حواجز"})
HEAD = 5


def gist(text: Column) -> Column:
    """The text as far as the grammar sees it: normalised, each word that it cannot know is an x, clauses and signs stay. What is read of it is what is read of the text."""
    ends = lambda w: reduce(lambda a, b: a | b, [F.substring(w, k, 1000).isin(WORDS) for k in range(1, HEAD + 2)])
    known = lambda w: ends(w) | (w.rlike(r"(.)\1{2,}") & ends(F.regexp_replace(w, r"(.)\1{2,}", "$1")))
    signs = "[^" + "".join(EMOJI) + "]+"
    clause = lambda c: F.concat_ws(" ", F.concat_ws(" ", F.transform(F.split(X.normalize(c), " "), lambda w: F.when(known(w), w).otherwise("x"))), F.regexp_replace(c, signs, ""))
    return F.concat_ws("،", F.transform(F.split(text, CLAUSES), clause))


def facts(lines: DataFrame) -> DataFrame:
    """Rows (id, direction, axis, value, explicit, confidence) of lines (id, text) that are no questions. Lines of one gist are read once."""
    told = written(lines.where(~is_question(F.col("text"))).select("id", gist(F.col("text")).alias("gist")), "told")
    return told.join(said(told), "gist").drop("gist")


def said(told: DataFrame) -> DataFrame:
    """Facts of every gist there is (gist, direction, axis, value, explicit, confidence) in told, which is a written table, as another: where they are few, its size says so."""
    gists = written(told.where("gist IS NOT NULL").select("gist").distinct(), "gists")
    return written(facts_of(gists.select(F.col("gist").alias("id"), F.col("gist").alias("text"))).withColumnRenamed("id", "gist"), "facts")


def facts_of(lines: DataFrame) -> DataFrame:
    """Facts of lines (id, text), read one by one; none may be a question."""
    w = Window.partitionBy("id", "c").orderBy("i")
    whole = Window.partitionBy("id", "c")
    t = tokens(lines)
    word = F.coalesce("flow", "pres", "p_axis")
    at = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    t = t.withColumn("word", word)
    t = t.select("*", *[at(c, k).alias(f"{c}{k}") for c, ks in (("tok", (1, 2, 3)), ("neg", (1, 2)), ("word", (1,)), ("pres", (1,)), ("clear", (1, 2))) for k in ks], at("clear", -1).alias("clear_1"), at("clear", -2).alias("clear_2"), at("tok", -1).alias("tok_1"))

    def scope(j: int) -> Column:
        neg, nxt, before = F.col(f"neg{j}"), F.col("tok") if j == 1 else F.col("tok1"), F.coalesce(F.col(f"tok{j + 1}"), F.lit(""))
        near = F.lit(j == 1)
        no = nxt.isin(EXISTS) | (near & F.col("pres").isNotNull()) | (near & (neg == "ولا") & among(F.col("tok"), NOUNS))
        ma = ~among(before, RELATIVE) & ~nxt.isin(PRONOUNS) & (near | nxt.isin(EXISTS))
        ok = F.when(neg.isin("لا", "ولا"), no).when(neg == "ما", ma).otherwise(F.lit(True))
        free = F.lit(True) if j == 1 else F.col("word1").isNull()
        return F.coalesce(neg.isNotNull() & ~nxt.isin(STILL) & ok & free, F.lit(False))

    negated = scope(1) | scope(2)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    fact = lambda a, v, conf: F.struct(F.lit(a).alias("axis") if isinstance(a, str) else a.alias("axis"), v.alias("value"), F.lit(conf).alias("confidence"))
    flipped = lambda v: pick(v, FLIP)
    standing = (F.col("flow") == "congested") & F.col("tok").isin("واقف", "واقفه", "وقفه", "موقوف") & F.col("pres1").isNotNull()
    gone = (F.col("flow") != "open") & among(F.col("tok"), NOUNS) & (yes("clear1") | yes("clear2"))
    near_clear = yes("clear1") | yes("clear2") | yes("clear_1") | yes("clear_2")
    found = (
        F.when(F.col("p_axis").isNotNull() & negated & (F.col("p_axis") == "presence"), fact("absence", F.col("p_value"), 0.86))
        .when(F.col("p_axis").isNotNull() & negated, fact("flow", flipped(F.col("p_value")), 0.80)).when(F.col("p_axis").isNotNull(), fact(F.col("p_axis"), F.col("p_value"), 0.92))
        .when(F.col("flow").isNotNull() & F.coalesce(standing, F.lit(False)), F.lit(None)).when(gone, fact("flow", F.lit("open"), 0.72))
        .when(F.col("flow").isNotNull() & negated, fact("flow", flipped(F.col("flow")), 0.80)).when(F.col("flow").isNotNull(), fact("flow", F.col("flow"), 0.90))
        .when(F.col("pres").isNotNull() & negated, fact("absence", F.col("pres"), 0.86)).when(F.col("pres").isNotNull() & near_clear, fact("absence", F.col("pres"), 0.78))
        .when(F.col("pres").isNotNull(), fact("presence", F.col("pres"), 0.88))
    )
    verb = F.col("tok_1").rlike("^[يتنب]") & F.coalesce(lookup(F.regexp_replace("tok_1", "^(?:بي|بت|بن|[يتنب])", ""), FLOW), lookup(F.regexp_replace("tok_1", "^(?:بي|بت|بن|[يتنب])", ""), PRESENCE)).isNotNull()
    void = F.col("tok").isin(CONDITIONS) | (F.col("tok").isin(FUTURE) & F.coalesce(verb, F.lit(False)))
    obstacle = among(F.col("tok"), OBSTACLES) | F.col("pres").isNotNull()
    t = t.select("id", "c", "raw", "i", "tok", "dir", found.alias("fact"), F.max(void).over(whole).alias("void"), F.max(obstacle & near_clear).over(whole).alias("opened"), F.max("i").over(whole).alias("last")).where("NOT void")
    # what a clause says as a whole, where its words say nothing
    c = t.groupBy("id", "c").agg(F.first("raw").alias("raw"), F.max_by("tok", "i").alias("end"), F.max("last").alias("last"), F.count("fact").alias("n"), F.max(F.col("fact.axis") == "flow").alias("flow"), F.max(F.col("fact.axis") == "presence").alias("pres"), F.max("opened").alias("opened"))
    seen = F.greatest(*[F.when(F.contains("raw", F.lit(ch)), F.lit(SEVERITY.index(v))).otherwise(F.lit(-1)) for ch, v in EMOJI.items()])
    ends = F.col("end").isin("حاجز", "حواجز")
    whole_fact = (
        F.when((F.col("n") == 0) & ends, fact("presence", F.lit("idf"), 0.70)).when((F.col("n") == 0) & (seen >= 0), fact("flow", F.get(F.array(*map(F.lit, SEVERITY)), seen), 0.65))
        .when(F.col("opened") & ~F.coalesce("flow", F.lit(False)) & ~F.coalesce("pres", F.lit(False)), fact("flow", F.lit("open"), 0.72))
    )
    more = c.select("id", "c", F.when((F.col("n") == 0) & ends, F.col("last")).otherwise(F.lit(-1)).alias("i"), whole_fact.alias("fact")).where("fact IS NOT NULL")
    every = t.where("fact IS NOT NULL").select("id", "c", "i", "fact").unionByName(more)
    return merged(bound(every, t.where("dir IS NOT NULL").select("id", "c", F.col("i").alias("at"), "dir")))


def bound(every: DataFrame, dirs: DataFrame) -> DataFrame:
    """Each fact with a direction of its clause: the nearest; of two as near the one that no other fact has nearest, else the following one."""
    clause, fact = ["id", "c"], Window.partitionBy("id", "c", "i", "fact")
    w = Window.partitionBy(*clause).orderBy("at")
    edge = every.where("i >= 0").groupBy(*clause).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    d = dirs.join(edge, clause, "left").withColumns({"next": F.lead(F.struct("at", "dir")).over(w), "prev": F.lag(F.struct("at", "dir")).over(w)})
    opposite = lambda o: (F.abs(F.col(o)["at"] - F.col("at")) == 1) & (F.col(o)["dir"] != F.col("dir")) & (F.col("dir") != "both") & (F.col(o)["dir"] != "both")
    around = lambda a, b: F.coalesce((F.col("lo") < a) & (F.col("hi") > b), F.lit(False))
    first = F.coalesce(opposite("next") & ~around(F.col("at"), F.col("at") + 1), F.lit(False))
    second = F.coalesce(opposite("prev") & ~around(F.col("at") - 1, F.col("at")), F.lit(False))
    d = d.withColumns({"first": first, "second": second}).where("NOT second OR first").select(*clause, "at", F.when(F.col("first"), "both").otherwise(F.col("dir")).alias("dir"))
    kinds = d.groupBy(*clause).agg(F.count_distinct("dir").alias("kinds"), F.min("dir").alias("only"))
    e = every.join(kinds, clause, "left")
    plain = e.where("kinds IS NULL OR kinds = 1 OR i < 0").select("id", "fact", F.when((F.col("kinds") == 1), F.col("only")).otherwise(F.lit("both")).alias("direction"), F.coalesce(F.col("kinds") == 1, F.lit(False)).alias("explicit"))
    m = e.where("kinds > 1 AND i >= 0").join(d, clause).withColumn("gap", F.abs(F.col("at") - F.col("i")))
    m = m.withColumn("least", F.min("gap").over(fact)).where("gap = least").withColumn("ties", F.count(F.lit(1)).over(fact))
    m = m.withColumn("taken", F.max(F.col("ties") == 1).over(Window.partitionBy(*clause, "at"))).withColumn("free", F.sum((~F.col("taken")).cast("int")).over(fact))
    order = F.struct(F.when((F.col("ties") > 1) & (F.col("free") == 1), F.col("taken").cast("int")).otherwise(0), (F.col("at") <= F.col("i")).cast("int"), "at")
    best = m.groupBy("id", "c", "i", "fact").agg(F.min_by("dir", order).alias("direction"))
    return plain.unionByName(best.select("id", "fact", "direction", F.lit(True).alias("explicit")))


def merged(b: DataFrame) -> DataFrame:
    """The surest instance of each (direction, axis, value), then of flow values the most restrictive."""
    b = b.select("id", "direction", "explicit", "fact.*").groupBy("id", "direction", "axis", "value").agg(F.max(F.struct("confidence", "explicit")).alias("x"))
    rank = F.when(F.col("axis") == "flow", F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("value"))).otherwise(F.lit(0))
    b = b.withColumn("rank", rank).withColumn("top", F.max(F.when(F.col("axis") == "flow", F.col("rank"))).over(Window.partitionBy("id", "direction")))
    return b.where("axis <> 'flow' OR rank = top").select("id", "direction", "axis", "value", F.col("x.explicit").alias("explicit"), F.col("x.confidence").alias("confidence"))


def readings(lines: DataFrame) -> DataFrame:
    """Every line once or more: (id, modality, direction, axis, value, explicit, confidence); questions and unparsed lines have no facts."""
    kind = lines.select("id", is_question(F.col("text")).alias("q"), "text")
    kind = written(kind.select("id", "q", F.when(~F.col("q"), gist(F.col("text"))).alias("gist")), "told")
    f = kind.join(said(kind), "gist", "left")
    return f.select("id", F.when(F.col("q"), "question").when(F.col("axis").isNull(), "unparsed").otherwise("assertion").alias("modality"), "direction", "axis", "value", "explicit", "confidence")


#: Lines as channels write them, and what they say: (direction, axis, value, explicit, confidence), or the modality.
LINES = [
    ("{} سالك للداخل", [("inbound", "flow", "open", True, 0.9)]), ("{} مغلق بالاتجاهين", [("both", "flow", "closed", True, 0.9)]), ("{} مش سالك", [("both", "flow", "closed", False, 0.92)]),
    ("شو وضع {}", "question"), ("{} بدون جيش سالكة", [("both", "absence", "idf", False, 0.86), ("both", "flow", "open", False, 0.9)]),
    ("{} الداخل سالك الخارج تفتيش", [("inbound", "flow", "open", True, 0.9), ("outbound", "presence", "inspection", True, 0.88)]), ("{} ما زال مغلق", [("both", "flow", "closed", False, 0.9)]),
    ("اذا فتح {} بنمشي", "unparsed"), ("{} ازمه، شرطه للخارج", [("both", "flow", "congested", False, 0.9), ("outbound", "presence", "police", True, 0.88)]),
    ("انتهت الازمه {}", [("both", "flow", "open", False, 0.72)]), ("راح الجيش عن {}", [("both", "absence", "idf", False, 0.78), ("both", "flow", "open", False, 0.72)]), ("{} ✅", [("both", "flow", "open", False, 0.65)]),
    ("صباح الخير يا {}", "unparsed"), ("{} مسكر للي داخل والخارج", [("both", "flow", "closed", True, 0.9)]), ("{} ازمه سالك للداخل", [("inbound", "flow", "congested", True, 0.9)]), ("{} مسكررر", [("both", "flow", "closed", False, 0.9)]),
    ("{} ما في جيش", [("both", "absence", "idf", False, 0.86)]), ("راح يسكروا {}", "unparsed"), ("{} حاجز", [("both", "presence", "idf", False, 0.7)]), ("{} سالك؟", "question"),
]


def report_lines(spark, sf_dir) -> DataFrame:
    """A line a report (id, place, t, text), in the words of its kind."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % len(LINES)
    texts = F.get(F.array(*[F.lit(x) for x, _ in LINES]), k.cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("place_id"), "ts", F.replace(texts, F.lit("{}"), F.concat(F.lit("موقع"), F.col("user_id").cast("string"))).alias("text"))


_SAID = ", ".join(f"({k}, 'assertion', '{d}', '{a}', '{v}', {str(x).lower()}, CAST({c} AS DOUBLE))" for k, (_, fs) in enumerate(LINES) if not isinstance(fs, str) for d, a, v, x, c in fs)
_SAID += "".join(f", ({k}, '{fs}', NULL, NULL, NULL, NULL, NULL)" for k, (_, fs) in enumerate(LINES) if isinstance(fs, str))
SAID = f"said(k, modality, direction, axis, value, explicit, confidence) AS (VALUES {_SAID})"


@query("tx_checkpoint", f"WITH {SAID} SELECT event_id AS id, modality, direction, axis, said.value, explicit, confidence FROM events JOIN said ON event_id % {len(LINES)} = k")
def tx_checkpoint(spark, sf_dir):
    """What each report line says; the SQL knows what the lines were made to say."""
    return readings(report_lines(spark, sf_dir))
