"""Source mix (3)."""

import random

from pyspark.sql import functions as F

from tessera.llm import mixing


def docs_of(spark, sizes):
    rows, i = [], 0
    for source, n in sizes:
        rows.append((i, " ".join(["w"] * n) if n is not None else None, source, "clash"))
        i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def shared(totals, repeats=3):
    """Targets by sharing again until none is above its cap."""
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, rest, open_ = {}, float(sum(totals.values())), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if repeats * totals[s] < level * weight[s] - 1e-9}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(repeats * totals[s])
            rest -= target[s]
        open_ -= full
    return target


def check(spark, sizes, **options):
    got = mixing.taken(docs_of(spark, sizes), **options).collect()
    totals = {}
    for s, n in sizes:
        totals[s] = totals.get(s, 0) + (n or 0)
    want = shared(totals)
    per = {}
    for r in got:
        assert r.size == (sizes[r.doc_id][1] or 0) and r.source_size == totals[r.source] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        per[r.source] = per.get(r.source, 0) + r.taken
    assert len(got) == len(sizes) and all(abs(per[s] - want[s]) <= 0.5 + 1e-6 for s in per)
    return got


def test_targets_and_taken(spark):
    r = random.Random(1)
    sizes = [(r.choice(["a", "b", "é", "z", None, "a", "a"]), r.choice([0, 1, 5, 40, 300])) for _ in range(150)]
    first = check(spark, sizes)
    again = mixing.taken(docs_of(spark, sizes).repartition(5)).collect()
    assert sorted((x.doc_id, x.taken) for x in first) == sorted((x.doc_id, x.taken) for x in again)


def test_hot_source_caps_and_tiny_sources(spark):
    check(spark, [("hot", 50)] * 120 + [("b", 1), ("c", 2), ("d", 0), (None, None), ("e", 700)])
    check(spark, [("only", 3)] * 4)
    check(spark, [("a", 0), (None, None)])
    check(spark, [("a", 20000), ("b", 3), ("c", 90)], block_words=16)


def test_schedule_spreads_sources(spark):
    sizes = [("a", 64)] * 64 + [("b", 64)] * 64
    pieces, _ = mixing.mix(docs_of(spark, sizes), block_words=64)
    slots = {r.slot: r.s for r in pieces.groupBy("slot").agg(F.min(F.expr("id < 64")).alias("s")).collect()}
    order = [slots[k] for k in sorted(slots)]
    assert len(order) == 128
    for at in range(0, 128, 16):        # source a weighs a third of each stretch
        assert 4 <= sum(order[at:at + 16]) <= 7


def test_running_sums_cross_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 3)
    r = random.Random(2)
    check(spark, [(r.choice("ab"), r.randrange(50)) for _ in range(60)], block_words=8)


def test_mix_rows_and_empty(spark):
    docs = docs_of(spark, [("a", 10)] * 3 + [("b", 100)] * 3)
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    assert out.filter("source = 'a'").count() == 9      # its cap: three times each
    assert mixing.taken(docs.limit(0)).collect() == [] and mixing.take_mix(docs.limit(0)).collect() == []
