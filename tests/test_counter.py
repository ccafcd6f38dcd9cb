"""Keyed decayed counter: equals the batch sum, keeps one row a key and salt, resumes, expires."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import counter as CT

LAM = 0.1
SCHEMA = "event_id BIGINT, k STRING, ts TIMESTAMP"


@pytest.fixture()
def rocks(spark):
    old = CT.use_rocksdb(spark)
    yield
    CT.restore(spark, old)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "event_id BIGINT, k STRING") \
        .join(spark.createDataFrame([(i, float(h)) for i, (_, h) in enumerate(rows)], "event_id BIGINT, h DOUBLE"), "event_id") \
        .select("event_id", "k", F.timestamp_micros((F.col("h") * 3.6e9).cast("bigint")).alias("ts"))


def expected(rows):
    out = {}
    for k in {k for k, _ in rows}:
        t = [h for x, h in rows if x == k]
        out[k] = (sum(math.exp(-LAM * (max(t) - h)) for h in t), len(t))
    return out


def values(spark, out):
    return {r.key: (r.weight, r.events) for r in CT.counter_values(spark.read.parquet(out), LAM).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6, k


def feed(spark, tmp_path, rows, **how):
    rows_of(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    CT.run_counter(CT.decayed_counter(stream, "k", "ts", LAM, **how), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()


def test_fold_in_any_order():
    t = np.array([5.0, 1.0, 9.0])
    once = CT.fold(None, t, LAM)
    step = CT.fold(CT.fold(None, t[:1], LAM), t[1:], LAM)
    late = CT.fold(CT.fold(None, t[2:], LAM), t[:2], LAM)
    for s in (step, late):
        assert s[1:] == once[1:] and abs(s[0] - once[0]) < 1e-12


def test_batches_restart_and_flat_state(spark, tmp_path, rocks):
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.integers(3)}", float(h)) for h in rng.uniform(1000, 1100, 120)]
    for part in (rows[:40], rows[40:80], rows[80:]):            # each feed is a new query on the same checkpoint
        feed(spark, tmp_path, part, spread_by="event_id", salts=3)
    same(values(spark, str(tmp_path / "out")), expected(rows))
    state = spark.read.format("statestore").option("stateVarName", "decay").load(str(tmp_path / "ckpt"))
    assert state.count() <= 4 * 3                               # one row a key and salt, whatever the number of batches
    per = spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id", "key", "salt").count().filter("count > 1")
    assert per.count() == 0


def test_idle_keys_expire_by_event_time(spark, tmp_path, rocks):
    feed(spark, tmp_path, [("a", 1000), ("a", 1001), ("b", 1001)], expire="event", idle_hours=10, watermark="1 hour")
    feed(spark, tmp_path, [("b", 1008), ("b", 1013.5)], expire="event", idle_hours=10, watermark="1 hour")
    feed(spark, tmp_path, [("b", 1014)], expire="event", idle_hours=10, watermark="1 hour")      # watermark past a's last event + 10 h
    got = values(spark, str(tmp_path / "out"))
    same(got, expected([("b", 1001), ("b", 1008), ("b", 1013.5), ("b", 1014)]))
    state = spark.read.format("statestore").option("stateVarName", "decay").load(str(tmp_path / "ckpt"))
    assert state.count() == 1
    with pytest.raises(ValueError):
        CT.decayed_counter(spark.readStream.format("rate").load(), "value", "timestamp", LAM, expire="never")


def test_time_to_live(spark, tmp_path, rocks):
    rows_of(spark, [("a", 1.0), ("a", 3.0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = CT.run_counter(CT.decayed_counter(stream, "k", "ts", LAM, expire="ttl", idle_hours=1 / 3600), str(tmp_path / "out"), str(tmp_path / "ckpt"), False)
    try:
        end = time.time() + 90
        while time.time() < end and len(q.recentProgress) < 6:      # a second and more after the events
            time.sleep(0.5)
    finally:
        q.stop()
    same(values(spark, str(tmp_path / "out")), expected([("a", 1.0), ("a", 3.0)]))
    assert spark.read.format("statestore").option("stateVarName", "decay").load(str(tmp_path / "ckpt")).count() <= 1


def test_replayed_batch_counts_once(spark, tmp_path, rocks):
    rows = [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    feed(spark, tmp_path, rows)
    changed = spark.read.parquet(str(tmp_path / "out"))
    again = changed.unionByName(changed)                        # the same batch, read twice
    got = {r.key: (r.weight, r.events) for r in CT.counter_values(again.dropDuplicates(["batch_id", "key", "salt"]), LAM).collect()}
    same(got, expected(rows))
