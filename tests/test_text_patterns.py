from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as T
from tessera.operators import dist as D
from tessera.operators import patterns as P


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normalize_cases(spark):
    df = spark.createDataFrame([(1, "  This   is   a   test.  "), (2, "Hello <|endoftext|> World"), (3, ""), (4, "   ")],
                               "doc_id BIGINT, text STRING")
    out = dict(rows(df.select("doc_id", T.normalize("text").alias("n")), "doc_id", "n"))
    assert out == {1: "This is a test.", 2: "Hello   World", 3: "", 4: ""}


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "Hello, World!  3x\tcafé")], "doc_id BIGINT, text STRING")
    r = df.select(T.ws_tokens("text").alias("w"), T.word_tokens("text").alias("p")).first()
    assert r["w"] == ["hello,", "world!", "3x", "café"]
    assert r["p"] == ["hello", ",", "world", "!", "3x", "café"]
    blank = spark.createDataFrame([(1, "   ")], "doc_id BIGINT, text STRING").select(T.ws_tokens("text").alias("w")).first()
    assert blank["w"] == []


def test_extract_single_line(spark):
    docs = spark.createDataFrame([(0, "The quick brown fox")], "doc_id BIGINT, text STRING")
    occ = P.patterns_from_docs(docs, Config(resolutions=(2,), lowercase=False))
    assert rows(occ, "position", "pattern", "next") == [(0, "The quick", "brown"), (1, "quick brown", "fox")]
    docs2 = spark.createDataFrame([(0, "The quick brown fox jumps")], "doc_id BIGINT, text STRING")
    occ2 = P.patterns_from_docs(docs2, Config(resolutions=(1, 2, 3), lowercase=False))
    # ceil((n - r) / stride) rows per resolution: 4 + 3 + 2
    assert occ2.count() == 9
    assert occ2.filter("resolution = 3").select("pattern", "next").collect()[0]["next"] in ("fox", "jumps")


def test_stride_and_short_docs(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "one"), (2, "")], "doc_id BIGINT, text STRING")
    occ = P.patterns_from_docs(docs, Config(resolutions=(1, 2), pattern_stride=2))
    assert rows(occ, "doc_id", "position", "resolution") == [(0, 0, 1), (0, 0, 2), (0, 2, 1), (0, 2, 2), (0, 4, 1)]


def test_frequency_corpus(spark):
    docs = spark.createDataFrame([(0, "The cat sat."), (1, "The dog sat."), (2, "A bird flew.")], "doc_id BIGINT, text STRING")
    cfg = Config(resolutions=(1,), min_pattern_frequency=2)
    store = P.pattern_store(docs, cfg)
    assert rows(store, "pattern", "cnt", "n_next") == [("the", 2, 2)]


def test_distribution_and_filter(spark):
    occ = spark.createDataFrame(
        [("x", 1, "is")] * 3 + [("x", 1, "was")] + [("1 2", 2, "3")] * 2 + [("2 3", 2, "4")],
        "pattern STRING, resolution INT, next STRING")
    cont = P.continuation_counts(occ)
    d = dict((r["next"], r["prob"]) for r in P.distribution(cont).filter("pattern = 'x'").collect())
    assert d == {"is": 0.75, "was": 0.25}
    kept = P.build_store(cont, 2)
    assert rows(kept, "pattern") == [("1 2",), ("x",)]
    assert rows(P.build_store(cont, 3), "pattern") == [("x",)]
    top = kept.filter("pattern = 'x'").first()
    assert (top["top_next"], top["top_cnt"]) == ("is", 3)


def test_two_continuations_same_key(spark):
    occ = spark.createDataFrame([("101 2023", 2, "2003", 0, 5), ("101 2023", 2, "2001", 1, 9)],
                                "pattern STRING, resolution INT, next STRING, doc_id BIGINT, position INT")
    s = P.build_store(P.continuation_counts(occ), 1).first()
    assert (s["cnt"], s["n_next"]) == (2, 2)
    first = P.first_continuation(occ).first()
    assert first["first_next"] == "2003"


def test_lookup_missing_key(spark):
    store = spark.createDataFrame([("a b", 2, 3)], "pattern STRING, resolution INT, cnt BIGINT")
    q = spark.createDataFrame([(1, "a b"), (2, "zz")], "qid INT, pattern STRING")
    out = rows(P.lookup(q, store), "qid", "cnt")
    assert out == [(1, 3), (2, None)]


def test_mixture_backoff_and_sampling(spark):
    cont = spark.createDataFrame(
        [("the", 1, "cat", 3), ("the", 1, "dog", 1), ("on the", 2, "mat", 2)],
        "pattern STRING, resolution INT, next STRING, cnt BIGINT")
    store = P.build_store(cont, 1)
    ctx = spark.createDataFrame([(1, ["sat", "on", "the"])], "qid INT, tokens ARRAY<STRING>")
    suf = D.context_suffixes(ctx, ["qid"], (1, 2))
    w = D.uniform_weights(spark, (1, 2))
    mix = dict((r["token"], r["prob"]) for r in D.mixture(suf, cont, store, ["qid"], w).collect())
    assert abs(mix["mat"] - 0.5) < 1e-12 and abs(mix["cat"] - 0.375) < 1e-12 and abs(mix["dog"] - 0.125) < 1e-12
    back = rows(D.backoff(suf, cont, store, ["qid"]), "token", "prob")
    assert back == [("mat", 1.0)]
    dist = D.mixture(suf, cont, store, ["qid"], w)
    assert rows(D.top_k(dist, ["qid"], 2), "token") == [("cat",), ("mat",)]
    # top-p 0.6: mat (0.5) then cat crosses -> both kept
    assert rows(D.top_p(dist, ["qid"], 0.6), "token") == [("cat",), ("mat",)]
    assert D.greedy(dist, ["qid"]).first()["token"] == "mat"
    t0 = D.temperature(dist, ["qid"], 0)
    assert rows(t0.filter("prob = 1.0"), "token") == [("mat",)]
    s1 = D.sample(dist, ["qid"], 42).first()["token"]
    s2 = D.sample(dist, ["qid"], 42).first()["token"]
    assert s1 == s2 and s1 in {"mat", "cat", "dog"}
    pen = dict((r["token"], r["prob"]) for r in D.repetition_penalty(dist, ctx, ["qid"], 2.0).collect())
    assert abs(sum(pen.values()) - 1) < 1e-12


def test_vocabulary_roundtrip(spark):
    docs = spark.createDataFrame([(0, "b a b c"), (1, "a b")], "doc_id BIGINT, text STRING")
    dt = P.tokenize_docs(docs)
    v = P.vocabulary(dt)
    assert rows(v, "token", "token_id") == [("a", 1), ("b", 0), ("c", 2)]
    back = rows(P.decode(P.encode(dt, v), v), "doc_id", "text")
    assert back == [(0, "b a b c"), (1, "a b")]
