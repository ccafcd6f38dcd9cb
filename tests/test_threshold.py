"""Exact top-k of mixtures against whole distributions."""

import random

from tessera.operators import dist as D
from tessera.operators import threshold as T


def tables(spark, seed, n_next=300):
    rng = random.Random(seed)
    cont, store = [], []
    for i in range(40):
        many = n_next if i < 3 else rng.randint(1, 12)
        counts = {f"t{j}": rng.choice([1, 1, 1, 2, 5, 30]) for j in rng.sample(range(n_next), many)}
        cont += [(f"p{i}", 1 + i % 5, t, c) for t, c in counts.items()]
        store.append((f"p{i}", 1 + i % 5, sum(counts.values())))
    suf = [(q, 1 + i % 5, f"p{i}") for q in range(80) for i in rng.sample(range(45), rng.randint(0, 4))]
    seen, rows = set(), []
    for q, r, p in suf:                      # one pattern a resolution
        if (q, r) not in seen:
            seen.add((q, r))
            rows.append((q, r, p))
    return (spark.createDataFrame(cont, "pattern string, resolution int, next string, cnt long"),
            spark.createDataFrame(store, "pattern string, resolution int, cnt long"),
            spark.createDataFrame(rows, "query_id long, resolution int, pattern string"),
            spark.createDataFrame([(r, w) for r, w in zip(range(1, 6), (0.1, 0.15, 0.2, 0.25, 0.3))], "resolution int, weight double"))


def test_equals_the_first_rows_of_the_whole_mixture(spark):
    for seed, depth in ((1, 2), (2, 8), (3, 1000)):
        cont, store, suf, w = tables(spark, seed)
        whole = D.top_k(D.mixture(suf, cont, store, ["query_id"], w), ["query_id"], 5)
        expected = {}
        for r in whole.orderBy("query_id", "rank").collect():
            expected.setdefault(r.query_id, []).append((r.token, r.prob))
        got = {r.query_id: [(t["token"], t["prob"]) for t in r.top]
               for r in T.top_predictions(suf, cont, store, ["query_id"], w, 5, depth).collect()}
        assert got.keys() == expected.keys()
        for q in got:
            assert [t for t, _ in got[q]] == [t for t, _ in expected[q]], (seed, q)
            assert all(abs(a - b) < 1e-11 for (_, a), (_, b) in zip(got[q], expected[q]))


def test_rows_follow_contexts_and_not_continuations(spark):
    cont, store, suf, w = tables(spark, 4, n_next=4000)
    contexts = T.suffix_tuples(suf, store, ["query_id"], w)
    tuples = contexts.groupBy("tuple").agg({"items": "first"}).withColumnRenamed("first(items)", "items")
    lists = T.pattern_lists(cont, suf.select("pattern").distinct(), 16)
    assert max(len(r.list) for r in lists.collect()) == 16
    rows = T.candidates(tuples, lists, 5)
    assert rows.count() <= 16 * 5 * tuples.count()
    whole = D.mixture(suf, cont, store, ["query_id"], w).count()
    assert 5 * rows.count() < whole


def test_one_solution_serves_all_contexts_with_the_same_suffixes(spark):
    cont, store, _, w = tables(spark, 5)
    suf = spark.createDataFrame([(q, r, p) for q in range(50) for r, p in ((1, "p0"), (2, "p1"))], "query_id long, resolution int, pattern string")
    contexts = T.suffix_tuples(suf, store, ["query_id"], w)
    tops = T.top_lists(contexts, cont, 3)
    assert tops.count() == 1
    assert T.top_predictions(suf, cont, store, ["query_id"], w, 3).count() == 50


def test_measures_and_empty_tables(spark):
    cont, store, suf, w = tables(spark, 6)
    pairs = suf.select("query_id").distinct().selectExpr("query_id", "'t1' AS target").unionByName(
        spark.createDataFrame([(999, "t1")], "query_id long, target string"))
    tops = T.top_predictions(suf, cont, store, ["query_id"], w, 10)
    rows = {r.query_id: r.top for r in tops.collect()}
    hits = sum(any(t["token"] == "t1" for t in top) for top in rows.values())
    r = T.topk_accuracy(pairs, tops, ["query_id"]).first()
    assert (r.total, r.correct) == (pairs.count(), hits)
    assert T.ranked_perplexity(pairs, tops, ["query_id"]).first().correct_predictions == hits
    assert T.top_predictions(suf.limit(0), cont, store, ["query_id"], w, 3).count() == 0
    assert T.top_predictions(suf, cont.limit(0), store, ["query_id"], w, 3).count() == 0
