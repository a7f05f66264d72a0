"""Quality rules [native]: text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over trusted
documents, one over the whole corpus. A document's score is the mean, over its n-grams, of
log p(n-gram | trusted) - log p(n-gram | corpus). Every document is judged by the same
threshold. The counts cover all documents.

The hash table grows with the corpus: it has at least `root` times the square root of the
texts' bytes buckets (a power of two). A bucket's mean count thus grows no faster than that
root, and an n-gram more frequent than it is told apart from the others of its bucket. Up to
`MOST_IN_ARRAY` buckets the ratios reach the tasks as one array of 16-bit numbers; a larger
table is joined to the n-grams of the documents, frequent ones apart. Ratios are whole numbers
of `1 / UNIT`, so that sums do not depend on their order and both ways agree to the bit.

Defined results: null or empty text has no words and fails the base rules; repeated rows are
judged alike and each counts; a null id is never trusted but is judged; texts may be of any
length; a score equal to the threshold is kept; an empty table gives an empty result; without
any trusted document all ratios are 0. Input columns other than the id and the text play no
part in the result of `score`, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, docs_of, meet, words, written

ROOT, LEAST, UNIT = 32, 1 << 12, 1024
MOST_IN_ARRAY = 1 << 24  # buckets: 32 MB
MOST_IDS = 500_000  # trusted ids that are broadcast, some 40 MB; more are joined by a shuffle of the texts
#: Added to a bucket's trusted count and to the count expected of it, so that rare n-grams weigh little.
SMOOTHING = 8.0
THRESHOLD = -0.125
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def bucket_of(hashed: Column, buckets: int) -> Column:
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")


def ngrams(hs: Column, buckets: int) -> Column:
    """Bucket numbers of the unigrams and bigrams of an array of word hashes; buckets: a power of two."""
    uni = F.transform(hs, lambda h: bucket_of(h, buckets))
    bi = F.transform(F.slice(hs, 2, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: bucket_of(F.xxhash64(F.get(hs, i), h), buckets))
    return F.concat(uni, bi)


def buckets_for(docs: DataFrame, text_col: str, root: int = ROOT) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST, 1 << max(0, int(root * size**0.5) - 1).bit_length())


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smoothing: float = SMOOTHING) -> DataFrame:
    """Rows (b, n, ratio): a bucket's count in the corpus and log p_trusted - log p_corpus in units; buckets without n-grams have none.

    Counts are summed before their shuffle, so that frequent words do not gather.
    """
    ids = written(trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct(), "trusted").withColumn("_t", F.lit(1))
    ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids.hint("merge")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left")
    grams = rows.select(F.coalesce("_t", F.lit(0)).alias("_t"), word_hashes(words(F.col("_text"))).alias("_h")).select("_t", F.explode(ngrams(F.col("_h"), buckets)).alias("b"))
    counts = written(grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("t")), "ngrams")
    all_n, all_t = counts.agg(F.sum("n"), F.sum("t")).first()
    ratio = F.log((F.col("t") + smoothing) / (F.col("n") * F.lit((all_t or 0) / (all_n or 1)) + smoothing)) if all_t else F.lit(0.0)
    return counts.select("b", "n", F.round(UNIT * ratio).cast("short").alias("ratio"))


def as_array(ratios: DataFrame, buckets: int) -> Column:
    """The ratios by bucket, as the result of a scalar subquery."""
    page = F.shiftright("b", 12).alias("page")
    full = ratios.select("b", "ratio").unionByName(ratios.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("short").alias("ratio")))
    full = full.groupBy("b").agg(F.sum("ratio").cast("short").alias("ratio")).groupBy(page).agg(F.array_sort(F.collect_list(F.struct("b", "ratio"))).alias("r"))
    full = full.select("page", F.transform("r", lambda x: x["ratio"]).alias("r"))
    return full.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "r"))), lambda x: x["r"]))).scalar()


def summed(df: DataFrame, keys: list[str], ratios: DataFrame, buckets: int, most_in_array: int) -> DataFrame:
    """df, which has _h and whose rows keys tell apart, with _sum and _grams: the sum and number of its n-grams' ratios.

    A row's n-grams are summed in the task that has the row before anything is shuffled.
    """
    if buckets <= most_in_array:
        met = df.select(*keys, F.explode_outer(ngrams(F.col("_h"), buckets)).alias("b")).withColumn("ratio", F.get(as_array(ratios, buckets), F.col("b")))
        return met.groupBy(*keys).agg(F.coalesce(F.sum("ratio"), F.lit(0)).alias("_sum"), F.count("b").alias("_grams"))
    df = written(df.select(*keys, "_h"), "hashes")
    met = meet(df.select("_n", F.explode(ngrams(F.col("_h"), buckets)).alias("b")), ratios, ["b"], "n", ["_n"])
    sums = met.groupBy("_n").agg(F.sum("ratio").alias("_sum"), F.count("b").alias("_grams"))
    return df.drop("_h").join(sums, "_n", "left").na.fill(0, ["_sum", "_grams"])


def base(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The carried columns as _k0, _k1, ..., _h: word hashes, and the statistics, of every document.

    Windows are sorted only in documents in which one occurs twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"_k{k}" for k in range(len(carried))]
    df = docs.select(*[docs[c].alias(k) for c, k in zip(carried, own)], text.alias("_text"), words(text).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *own, word_hashes(F.col("_w")).alias("_h"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    inner = F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0)))
    df = df.withColumn("_win", F.transform(inner, lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))))
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_win", F.when(again, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_win", lambda x, k: (x["h"] == F.get("_win", k - 1)["h"]) | (x["h"] == F.get("_win", k + 1)["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *own, "_h", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _judged(docs: DataFrame, carried: list[str], trusted: DataFrame, id_col: str, text_col: str, buckets: int | None, smoothing: float, threshold: float, most_in_array: int) -> DataFrame:
    """Rows (_k0, _k1, ... for the carried columns, statistics, base_failed, llr, kept), as a written table:
    a filter on them never reaches the long chain of expressions that makes them."""
    buckets = buckets or buckets_for(docs, text_col)
    ratios = written(log_ratios(docs, trusted, id_col, text_col, buckets, smoothing), "ratios")
    own = [f"_k{k}" for k in range(len(carried))]
    df = base(docs, text_col, carried).withColumn("_n", F.monotonically_increasing_id())  # tells rows apart within this job
    df = summed(df, ["_n", *own, *STATISTICS], ratios, buckets, most_in_array)
    llr = F.col("_sum") / F.lit(float(UNIT)) / F.greatest("_grams", F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.select(*own, *STATISTICS, failed.alias("base_failed"), llr.alias("llr"))
    return written(df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)), "judged")


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, most_in_array: int = MOST_IN_ARRAY) -> DataFrame:
    """One row a document: id, n_words, the four statistics, base_failed, llr, kept. trusted: one column of ids. buckets: null lets the input decide."""
    df = _judged(docs.select(id_col, text_col), [id_col], trusted, id_col, text_col, buckets, smoothing, threshold, most_in_array)
    return df.withColumnRenamed("_k0", id_col)


def kept_rows(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, most_in_array: int = MOST_IN_ARRAY) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    kept = _judged(rows, ["id", "hash"], trusted, "id", "text", buckets, smoothing, threshold, most_in_array).where("kept").select("_k0", "_k1").distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_k0")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_k1"))
    return docs.join(kept.hint("merge"), same, "left_semi")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none calls toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 AND coalesce(x, 0) = 0").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(docs_of(spark, sf_dir), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
