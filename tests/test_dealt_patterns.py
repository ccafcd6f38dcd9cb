"""Patterns counted in parts dealt by their first two tokens, and patterns
counted for the contexts that ask for them: the rows of the plain way, with
one shuffled row per position instead of one per pattern."""

from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.operators import dist as D
from tessera.operators import generate as G
from tessera.operators import patterns as P

TEXTS = [(0, "a b c a b c a b d"), (1, "a b c a b c"), (2, "x"), (None, "b c"), (3, None), (4, "  "), (1, "c c c c c c c c c c c c"),
         (5, "one two three four five six seven eight nine ten"), (6, "one two three four five six seven eight nine ten")]
COLS = ("position", "resolution", "pattern", "next")


def table(spark):
    return spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING")


def bag(df, *cols):
    return sorted(map(repr, map(tuple, df.select(*cols).collect())))


def test_parts_hold_the_rows_of_the_plain_way(spark):
    docs = table(spark)
    for cfg in (DEFAULT, Config(resolutions=(1, 3)), Config(resolutions=(2, 5), pattern_stride=2), Config(resolutions=(1,))):
        plain = P.patterns_from_docs(docs, cfg)
        parts = P.parts_from_docs(docs, cfg)
        assert bag(P.union_parts(parts), "doc_id", *COLS) == bag(plain, "doc_id", *COLS)
        cont = P.continuation_counts(plain)
        conts = P.count_parts(parts)
        assert bag(P.union_parts(conts), *cont.columns) == bag(cont, *cont.columns)
        store = P.build_store(cont, 2)
        stores = [P.build_store(c, 2, ("head",)) for c in conts]
        assert bag(P.union_parts(stores), *store.columns) == bag(store, *store.columns)
        kept = P.union_parts([P.frequent_occurrences(c, s) for c, s in zip(conts, stores)])
        assert bag(kept, *cont.columns) == bag(P.frequent_occurrences(cont, store), *cont.columns)


def test_long_patterns_are_shuffled_once_per_position(spark):
    part = P.parts_from_docs(table(spark))[-1]
    store = P.build_store(P.continuation_counts(part, ("head",)), 2, ("head",))
    plan = store._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(deal" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_portions_hold_the_rows_of_the_whole(spark, monkeypatch, tmpdir_path):
    from tessera.plans import q_patterns as Q
    table(spark).repartition(2).write.parquet(f"{tmpdir_path}/documents.parquet")
    queries = [Q.q_pattern_store, Q.q_continuation_counts, Q.q_continuation_distribution, Q.q_first_continuation]
    whole = [bag(q(spark, tmpdir_path), "*") for q in queries]
    assert all(whole)
    monkeypatch.setattr(P, "PORTION_BYTES", 1)
    asked = []
    deal = P.dealt_patterns
    monkeypatch.setattr(P, "dealt_patterns", lambda *a: asked.append(a[-1]) or deal(*a))
    assert [bag(q(spark, tmpdir_path), "*") for q in queries] == whole
    assert asked == [(i, P.PORTIONS) for _ in queries for i in range(P.PORTIONS)]


def test_asked_patterns_only(spark):
    docs = table(spark)
    asked = spark.createDataFrame([("a b",), ("c",), ("c",), ("zzz",), ("one two three four five six seven eight",)], "pattern STRING")
    for cfg in (DEFAULT, Config(resolutions=(1, 2), pattern_stride=2)):
        want = P.patterns_from_docs(docs, cfg).join(asked.distinct(), "pattern", "left_semi")
        got = P.asked_occurrences(P.tokenize_docs(docs, cfg), asked, cfg.resolutions, cfg.pattern_stride)
        assert bag(got, "doc_id", *COLS) == bag(want, "doc_id", *COLS)


def test_long_windows_are_made_only_where_shorter_ones_are_asked(spark):
    docs = table(spark)
    rows = [("a b c a b",), ("x b",), ("c",), ("seven eight",), ("four five six seven eight",), ("a  b",), (None,)]
    asked = spark.createDataFrame(rows, "pattern STRING")
    for cfg in (DEFAULT, Config(resolutions=(2, 5)), Config(resolutions=(3, 5), pattern_stride=2)):
        want = P.patterns_from_docs(docs, cfg).join(asked.distinct(), "pattern", "left_semi")
        got = P.asked_occurrences(P.tokenize_docs(docs, cfg), asked, cfg.resolutions, cfg.pattern_stride)
        assert bag(got, "doc_id", *COLS) == bag(want, "doc_id", *COLS)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_join(") == plan.count("CASE WHEN (isnotnull(_a")
        assert plan.count("array_join(") == len(set(cfg.resolutions) - {1})


def test_generation_from_counts_equals_generation_from_a_store(spark):
    docs = table(spark)
    cont = P.continuation_counts(P.patterns_from_docs(docs))
    store = P.build_store(cont, 2)
    prompts = spark.createDataFrame([(0, ["a"]), (1, ["one", "two"]), (2, ["zzz"])], "prompt_id BIGINT, tokens ARRAY<STRING>")
    w = D.uniform_weights(spark, DEFAULT.resolutions)

    def counts(suffixes):
        c = P.continuation_counts(P.asked_occurrences(P.tokenize_docs(docs), suffixes))
        return c, P.build_store(c, 2)

    cols = ("prompt_id", "generated", "n_new", "finished")
    assert bag(G.generate(prompts, counts, None, w, max_new=3), *cols) == bag(G.generate(prompts, cont, store, w, max_new=3), *cols)
    out = [bag(G.beam_search(prompts, *a, w, beams=2, steps=2).select("prompt_id", "beam", "generated", F.round("score", 9).alias("s")),
               "prompt_id", "beam", "generated", "s") for a in ((counts, None), (cont, store))]
    assert out[0] == out[1]


def test_windows_that_occur_once_are_not_made(spark):
    docs = table(spark)
    for cfg in (DEFAULT, Config(resolutions=(1, 3)), Config(resolutions=(2, 5), pattern_stride=2)):
        plain = P.build_store(P.continuation_counts(P.patterns_from_docs(docs, cfg)), 2)
        parts = P.parts_from_docs(docs, cfg, least=2)
        store = P.union_parts([P.build_store(c, 2, ("head",)) for c in P.count_parts(parts)])
        assert bag(store, *plain.columns) == bag(plain, *plain.columns)
    whole, shared = (P.union_parts(P.parts_from_docs(docs.filter("doc_id >= 5"), least=n)) for n in (1, 2))
    assert shared.count() == whole.count()
    alone = spark.createDataFrame([(0, "a b c d e"), (1, "a b x y z"), (2, "a b\x01 c")], "doc_id BIGINT, text STRING")
    assert {r.pattern for r in P.parts_from_docs(alone, least=2)[1].collect()} == {"a b"}      # 12 windows otherwise


def test_pairs_of_patterns_are_counted_from_one_row_per_position(spark, monkeypatch, tmp_path):
    from tessera.plans import q_patterns as Q
    for texts in (TEXTS, [t for t in TEXTS if t[0] != 1], [(0, "a b\x01c a b d a b"), (1, "a b"), (2, "a b d a b\x01c a b d a")]):
        docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
        for rs in ((1, 2, 3, 5, 8), (2, 3)):
            cfg = Config(resolutions=rs)
            pairs = P.higher_level_patterns(P.patterns_from_docs(docs, cfg)).withColumn("a_res", F.size(F.split("a_pattern", " ")))
            plain = pairs.groupBy("a_res", (F.col("resolution") - F.col("a_res")).alias("b_res")).agg(
                F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("pattern").alias("n_distinct"))
            assert bag(P.higher_level_counts(P.tokenize_docs(docs), rs), *plain.columns) == bag(plain, *plain.columns)
        at = str(tmp_path / str(len(texts)))
        docs.write.parquet(f"{at}/documents.parquet")
        query = Q.q_higher_level_patterns(spark, at)
        whole = bag(query, "a_res", "b_res", "n_pairs", "n_distinct")
        assert "a_pattern" not in query._jdf.queryExecution().optimizedPlan().toString()      # no row per pair
        with monkeypatch.context() as m:
            m.setattr(P, "PORTION_BYTES", 100)
            assert bag(Q.q_higher_level_patterns(spark, at), "a_res", "b_res", "n_pairs", "n_distinct") == whole


def test_appended_counts_shuffle_a_row_per_position(spark, monkeypatch, tmp_path):
    from tessera.plans import q_patterns as Q
    docs, at = table(spark), str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    more = spark.createDataFrame([(0, "a b c new one"), (1, "nine ten eleven"), (2, "nine ten eleven")], "item_id BIGINT, text STRING")
    more.write.parquet(f"{at}/benchmark.parquet")
    merged = P.merge_counts(*[P.continuation_counts(P.patterns_from_docs(d)) for d in (docs, more.withColumnRenamed("item_id", "doc_id"))])
    plain = bag(merged.join(P.build_store(merged, 2).select("pattern"), "pattern", "left_semi"), "pattern", "resolution", "next", "cnt")
    got = Q.q_store_append(spark, at)
    assert bag(got, "pattern", "resolution", "next", "cnt") == plain
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [deal") >= 2
    monkeypatch.setattr(P, "PORTION_BYTES", 100)
    assert bag(Q.q_store_append(spark, at), "pattern", "resolution", "next", "cnt") == plain


def test_sums_over_patterns_are_taken_portion_by_portion(spark, monkeypatch, tmp_path):
    from tessera.plans import q_dist as QD
    from tessera.plans import q_metrics as QM
    from tessera.plans import q_patterns as Q
    more = [(i, f"a b c w{i % 7} a b c d e w{i % 3}") for i in range(10, 40)]
    docs = spark.createDataFrame([(i, t, "en" if i else None) for i, t in TEXTS + more], "doc_id BIGINT, text STRING, lang STRING")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    queries = [Q.q_store_statistics, Q.q_pattern_profile, Q.q_distinct_patterns, Q.q_pattern_frequency, QM.q_domain_statistics,
               QD.q_resolution_entropy, QD.q_perplexity_holdout]
    whole = [bag(q(spark, str(tmp_path)), "*") for q in queries]
    assert all(whole)
    monkeypatch.setattr(P, "PORTION_BYTES", 1)
    monkeypatch.setattr(P, "PORTIONS", 2)
    written, by_portion = [], P.by_portion
    monkeypatch.setattr(P, "by_portion", lambda d, work: written.append(P.portions(d)) or by_portion(d, work))
    assert [bag(q(spark, str(tmp_path)), "*") for q in queries] == whole
    assert written == [2] * len(queries)


def test_deltas_shuffle_a_row_per_position_and_the_store_shuffles_once(spark, tmp_path):
    from tessera.streaming import incremental as S
    counts = S.batch_counts(table(spark))
    plain = P.continuation_counts(P.patterns_from_docs(table(spark)))
    assert bag(counts, *plain.columns) == bag(plain, *plain.columns)
    assert "RepartitionByExpression [deal" in counts._jdf.queryExecution().optimizedPlan().toString()
    write = S.delta_writer(str(tmp_path))
    for b, part in enumerate((table(spark).filter("doc_id < 4"), table(spark).filter("doc_id >= 4 OR doc_id IS NULL"))):
        write(part, b)
    store = P.build_store(plain, 2)
    got = S.store_from_deltas(spark, str(tmp_path), 2)[1]
    assert bag(got, *store.columns) == bag(store, *store.columns)
    halves = [S.store_from_deltas(spark, str(tmp_path), 2, (i, 2))[1] for i in range(2)]
    assert sorted(r for h in halves for r in bag(h, *store.columns)) == bag(store, *store.columns)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
