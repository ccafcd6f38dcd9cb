"""Novelty-gated insert against inserting one vector after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.streaming import novelty as N


def sequential(rows, theta, store=()):
    taken = list(store)
    for i, v in sorted(rows):
        if all(i != j and round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 12) < theta for j, w in taken):
            taken.append((i, v))
    return {i for i, _ in taken} - {i for i, _ in store}


def vectors(seed, n=240):
    """Crowds of near-equal vectors, chains in which each is near the next, and strangers."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, 6))
    x[:80] = x[0] + 0.02 * rng.standard_normal((80, 6))
    angle = np.arange(40) * 0.2
    x[80:120] = 0
    x[80:120, 0], x[80:120, 1] = np.cos(angle), np.sin(angle)
    ids = rng.permutation(n)
    return [(int(i), v) for i, v in zip(ids, x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in v], "x") for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, payload STRING")


@pytest.mark.parametrize("theta", [0.9, 0.6])
def test_one_batch_equals_one_vector_after_the_other(spark, theta):
    rows = vectors(1)
    got = N.novel(frame(spark, rows).repartition(3), None, theta)
    assert got.columns == ["vec_id", "embedding", "payload"]
    assert {r.vec_id for r in got.collect()} == sequential(rows, theta)


def test_gate_of_the_store_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 900)
    rows, store = vectors(2, 150)[:60], [(1000 + i, v) for i, v in vectors(3, 130)[:40]]
    got = N.novel(frame(spark, rows), frame(spark, store), 0.8)
    assert {r.vec_id for r in got.collect()} == sequential(rows, 0.8, store)
    again = frame(spark, rows + rows[:5] + [(store[0][0], -store[0][1])])      # repeated rows, an id that is stored
    assert {r.vec_id for r in N.novel(again, frame(spark, store), 0.8).collect()} == sequential(rows, 0.8, store)
    assert N.novel(frame(spark, rows[:1]).limit(0), None, 0.8).count() == 0


def test_three_batches_and_a_replay(spark, tmp_path):
    rows = vectors(4)
    out, src = str(tmp_path / "out"), str(tmp_path / "src")
    parts = [rows[0:80], rows[80:160], rows[160:240]]
    expected, taken = [], []
    for b, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        new = sequential(part, 0.85, taken)
        taken += [(i, v) for i, v in part if i in new]
        expected.append(new)
        stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src)
        N.run_novelty(stream, out, str(tmp_path / "ckpt"), 0.85).awaitTermination()     # resumes
    assert {r.vec_id for r in N.stored_vectors(spark, out).collect()} == set().union(*expected)
    write = N.novelty_writer(out, 0.85)
    for b in (2, 1):                                            # replayed batches write themselves again
        write(frame(spark, parts[b]), b)
        got = [r.vec_id for r in N.stored_vectors(spark, out).collect()]
        assert sorted(got) == sorted(set().union(*expected))


def test_rows_of_a_round_follow_candidates_not_pairs(spark):
    rows = vectors(1)
    df = frame(spark, rows)
    found = N.first_conflict(df, df, 0.9, True)
    assert found.count() <= len(rows)
    assert found.filter(F.col("first") >= F.col("vec_id")).count() == 0
