"""Quality rules (6): n-grams are counted, and symbols found, in compiled expressions."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality

TEXTS = ["a b a", " a\tb\n\x0bc  ", "b", "", "  ", None, "日本 😀 a 日本 😀", "x " * 300]


def docs_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_counts_are_those_of_the_buckets(spark):
    docs = docs_of(spark)
    want = Counter(b for r in docs.select(quality.gram_buckets("text", 64).alias("g")).collect() for b in r.g)
    assert {r.bucket: r.n for r in quality.gram_counts(docs, 64, "n").collect()} == want


def test_no_interpreted_function_counts(spark):
    counts = quality.gram_counts(docs_of(spark), 64, "n")
    assert "lambda" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_are_counted_without_a_translated_copy(spark):
    docs = spark.createDataFrame([(0, "#*$%&|<>"), (1, "a#b [c] ^-\\"), (2, "😀#😀"), (3, None), (4, "")], "doc_id long, text string")
    rows = quality.base_rules(docs)
    assert {r.doc_id: r.n_symbols for r in rows.collect()} == {0: 8, 1: 1, 2: 1, 3: 0, 4: 0}
    assert "translate" not in rows.select(F.col("n_symbols"))._jdf.queryExecution().optimizedPlan().toString()
