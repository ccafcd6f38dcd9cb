"""Quality rules (6), in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows.
The verdict of the rest is a hashed n-gram log-likelihood ratio: words and
word pairs of all trusted documents give one multinomial over hash buckets,
those of the whole corpus another, and a document's score is the mean of
log(trusted / raw) over its n-grams.  A document stays where its score
reaches the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NON_WORD, fresh, stored, words

#: Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Fixed value: hash buckets, for a corpus of any size.
BUCKETS = 1 << 20
#: Spark's runtime filter for the search of trusted documents, at any size of the tables.
RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
                  "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                  "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
#: Added to a bucket's chance in both multinomials: an n-gram far rarer than this weighs about 0.
SMOOTHING = 2.0 ** -16
THRESHOLD = -0.15


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def repeated_words(h: Column) -> Column:
    """Words that lie in a window of five which the text holds twice or more;
    ``h`` has the hashes of its words."""
    def covered(x: Column) -> Column:
        n = F.size(x)
        pairs = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def twice(v: Column, k: Column) -> Column:
                same = lambda j: F.get(s, j)["h"] == v["h"]
                return F.when(F.coalesce(same(k - 1), F.lit(False)) | F.coalesce(same(k + 1), F.lit(False)), v["i"])
            return F.sort_array(F.filter(F.transform(s, twice), lambda i: i.isNotNull()))

        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        count = F.aggregate(let(pairs, positions), zero, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(x)) == n, F.lit(0)).otherwise(count)

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(F.size(h) > WINDOW, let(windows, covered)).otherwise(F.lit(0))


def word_bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def pair_bucket(h: Column, i: Column, buckets: int) -> Column:
    """Bucket of the pair of words ``i`` and ``i + 1``."""
    return F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)).cast("int")


def measures(text: Column, buckets: int | None = None, weights: Column | None = None) -> Column:
    """All counts of a text from one split into words, and with ``weights``
    (an array by bucket) the mean weight of its n-grams, 0 without any."""
    def score(h: Column, w: Column) -> Column:
        n = F.size(h)
        ones = F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(w, word_bucket(x, buckets)))
        twos = F.aggregate(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
                           lambda a, i: a + F.get(w, pair_bucket(h, i, buckets)))
        return (ones + twos) / F.greatest(2 * n - 1, F.lit(1))

    def of(w: Column) -> Column:
        def hashed(h: Column) -> Column:
            parts = [F.size(h).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                     repeated_words(h).cast("bigint").alias("n_repeat_words")]
            return F.struct(*parts, *([score(h, weights).alias("score")] if weights is not None else []))
        return let(F.transform(w, lambda x: F.xxhash64(x)), hashed)
    return let(words(text), of)


def base_rules(docs: DataFrame, text_col: str = "text", buckets: int | None = None, weights: Column | None = None) -> DataFrame:
    """``docs`` with the base counts and ``base_failed``, and with ``weights``
    the ``score``; null counts as empty.  Columns of these names are replaced."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    m, w = fresh(docs, "_measures", "_weights")
    # A function of arrays takes no subquery inside, so the weights are a column here; read once, the optimizer puts
    # the subquery back in its place, and no row holds the array (read more often, every row would).
    rows = docs if weights is None else docs.withColumn(w, weights)
    rows = rows.withColumn(m, measures(t) if weights is None else let(F.col(w), lambda x: measures(t, buckets, x)))
    rows = rows.withColumns({n: F.col(m)[n] for n in ("n_words", "word_chars", "n_repeat_words", *(["score"] if weights is not None else []))})
    rows = rows.withColumns({"n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
                             "n_dup_lines": duplicate_lines(t)})
    return rows.drop(m, w).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                                      | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def gram_buckets(text_col: str, buckets: int) -> Column:
    """Hash buckets of the words of a text and of its pairs of neighbours."""
    def grams(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda _, i: pair_bucket(h, i, buckets))
        return F.concat(F.transform(h, lambda x: word_bucket(x, buckets)), pairs)
    return let(F.transform(words(F.col(text_col).cast("string")), lambda x: F.xxhash64(x)), grams)


def gram_counts(docs: DataFrame, buckets: int, name: str, text_col: str = "text") -> DataFrame:
    """Counts of the ``gram_buckets`` of all texts, from a row per word, in
    expressions that Spark compiles as one (it interprets functions of arrays)."""
    rows = docs.select(words(F.col(text_col).cast("string")).alias("w")).select("w", F.posexplode("w").alias("i", "x"))
    behind = F.col("i") + 1
    pair = F.pmod(F.xxhash64(F.xxhash64("x"), F.xxhash64(F.get("w", behind))), F.lit(buckets)).cast("int")
    one, two = word_bucket(F.xxhash64("x"), buckets), F.when(behind < F.size("w"), pair)
    grams = rows.select(F.explode(F.array(one, two)).alias("bucket")).filter("bucket IS NOT NULL")
    return grams.groupBy("bucket").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text",
               smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight): log of a bucket's smoothed chance in the documents
    whose id is in ``trusted`` over that in all documents.  ``buckets`` rows.
    Chances, not counts, are smoothed, so copies of the whole corpus change no
    weight.  All weights are 0 without a trusted n-gram.

    Only the trusted documents are shuffled, to be found by id; Spark's
    runtime filter drops most others in front of that."""
    spark = docs.sparkSession
    good = docs.join(trusted.hint("merge"), id_col, "left_semi")
    old = {k: spark.conf.get(k, None) for k in RUNTIME_FILTER}
    for k, v in RUNTIME_FILTER.items():
        spark.conf.set(k, v)
    try:
        seen = stored(gram_counts(good, buckets, "trusted", text_col), "trusted-grams")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")) \
                  .join(gram_counts(docs, buckets, "raw", text_col), "bucket", "left").join(seen, "bucket", "left").fillna(0)
    counts = stored(counts, "gram-counts")
    chance = lambda name: F.col(name) / F.greatest(counts.agg(F.sum(name)).scalar(), F.lit(1))
    weight = F.log((chance("trusted") + smoothing) / (chance("raw") + smoothing))
    judged = counts.agg(F.sum("trusted")).scalar() > 0
    return counts.select("bucket", F.when(judged, weight).otherwise(F.lit(0.0)).alias("weight"))


def weight_table(weights: DataFrame) -> Column:
    """The weights as one array by bucket (a scalar subquery of a fixed size)."""
    return weights.agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("x")) \
                  .select(F.transform("x", lambda s: s["weight"])).scalar()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, the base counts, ``base_failed``, ``score``, ``kept``.

    Trusted are the documents that ``labels`` calls of quality and not toxic.  Every document is scored and compared with ``threshold``; none is drawn by
    lot.  Without trusted documents all scores are 0.  Null, empty and blank texts fail the base rules.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trusted = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("doc_id"))
    weights = stored(log_ratios(narrow, trusted, BUCKETS), "gram-weights")
    out = base_rules(narrow, "text", BUCKETS, weight_table(weights))
    return out.drop("text").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)) \
              .withColumnRenamed("doc_id", id_col)
