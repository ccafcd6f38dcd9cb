"""Streamed vocabulary against a loop over batches."""

import pytest

from tessera.streaming import vocabulary as VO


def step(state, batch, capacity, eta=0.1, decay=0.01, floor=0.1):
    """One batch, token by token."""
    state = {t: dict(s) for t, s in state.items()}
    for t in batch:
        if t not in state:
            state[t] = {"static": False, "weight": 3.0, "count": 1, "energy": 1.0}
        else:
            s = state[t]
            s["count"] += 1
            s["energy"] += 0.0 if s["static"] else 0.3
    for s in state.values():
        if s["count"]:
            s["weight"] = max(floor, s["weight"] + eta * (s["energy"] / s["count"] - decay * s["weight"]))
            if s["count"] > 1000:
                s["count"], s["energy"] = s["count"] // 2, s["energy"] / 2
    static = {t: s for t, s in state.items() if s["static"]}
    learned = sorted((t for t in state if t not in static), key=lambda t: (-round(state[t]["weight"], 9), t))
    return static | {t: state[t] for t in learned[:max(0, capacity - len(static))]}


def rows(df):
    return {r.token: {"static": r.static, "weight": r.weight, "count": r["count"], "energy": r.energy} for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for t in want:
        assert (got[t]["static"], got[t]["count"]) == (want[t]["static"], want[t]["count"]), t
        assert abs(got[t]["weight"] - want[t]["weight"]) < 1e-9 and abs(got[t]["energy"] - want[t]["energy"]) < 1e-9, t


BATCHES = [["the cat sat", "a new word new"], ["the " * 1500 + "new", "other words come", "cat " * 2], ["word", "the zebra", None, " "], ["new"]]


@pytest.mark.parametrize("capacity", [5, 100])
def test_batches_restart_and_replay(spark, tmp_path, capacity):
    static = VO.static_vocabulary(spark.createDataFrame([("the",), ("cat",), ("the",), ("unused",)], "token string"))
    expected = {t: {"static": True, "weight": 1.0, "count": 0, "energy": 0.0} for t in ("the", "cat", "unused")}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda b: spark.createDataFrame([(t,) for t in b], "text string")
    for b in BATCHES:                                           # a new query on the same checkpoint each time
        frame(b).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(src)
        VO.run_vocabulary(stream, out, str(tmp_path / "ckpt"), static, capacity).awaitTermination()
        expected = step(expected, " ".join(t or "" for t in b).split(), capacity)
        same(rows(VO.current(spark, out)), expected)
    assert VO._versions(spark, out) == [1, 2, 3]
    VO.vocabulary_writer(out, static, capacity)(frame(BATCHES[3]), 3)      # replayed
    same(rows(VO.current(spark, out)), expected)
    if capacity == 5:
        assert len(expected) == 5 and {"the", "cat", "unused"} <= expected.keys()


def test_an_empty_batch_moves_only_seen_tokens(spark):
    static = VO.static_vocabulary(spark.createDataFrame([("a",), ("b",)], "token string"))
    none = spark.createDataFrame([], "token string")
    assert {t: s["weight"] for t, s in rows(VO.update(static, none, 10)).items()} == {"a": 1.0, "b": 1.0}
