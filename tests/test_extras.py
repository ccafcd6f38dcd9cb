from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import knn as K
from tessera.operators import retrieval as RT
from tessera.plans.q_vectors import split_sets
from tessera.sources import io

from conftest import SF001


def test_novelty_gate_and_eviction(spark):
    store, qs = split_sets(spark, SF001)
    gate = RT.novelty_gate(qs, store, 0.5)
    near = {r["query_id"]: r["score"] for r in K.knn_exact(qs, store, 1).collect()}
    assert {r["query_id"] for r in gate.collect()} == {q for q, s in near.items() if s < 0.5}
    ids = spark.createDataFrame([(i,) for i in range(6)], "vec_id BIGINT")
    hits = spark.createDataFrame([(1,), (1,), (3,), (5,), (5,), (5,)], "vec_id BIGINT")
    kept = [(r["vec_id"], r["usage"]) for r in RT.evict_least_used(ids, hits, 3).orderBy("usage", "vec_id").collect()]
    assert sorted(kept) == [(1, 2), (3, 1), (5, 3)]


def test_metrics_sink_and_vocab_health(spark, tmpdir_path):
    m = spark.createDataFrame([("r1", 0, "bleu", 0.5), ("r1", 1, "bleu", 0.6)], io.METRICS_SCHEMA)
    io.save_metrics(m, tmpdir_path)
    assert sorted(r["value"] for r in io.load_metrics(spark, tmpdir_path).collect()) == [0.5, 0.6]
    vocab = spark.createDataFrame([("a", 2), ("b", 2)], "token STRING, cnt BIGINT")
    toks = spark.createDataFrame([("a",), ("z",)], "token STRING")
    h = C.vocabulary_health(vocab, toks).first()
    assert h["oov_rate"] == 0.5 and h["weight_cv"] == 0.0 and h["vocab_size"] == 2
