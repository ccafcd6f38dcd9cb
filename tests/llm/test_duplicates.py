"""Exact dedup (4) and MinHash near-duplicates (10)."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dedup, neardup, shingles
from tessera.session import scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def landed(df, name="docs"):
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return at


# --- exact --------------------------------------------------------------------

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a"), (None, "b"), (8, "long " * 30000),
        (9, "long " * 30000), (3, "a"), (10, "a ")]


def expected_exact(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        out.append((i, max([j for j in same if j is not None], default=None), len(same)))
    return sorted(out, key=str)


def check_exact(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int")
    got = dedup.exact_duplicates(spark, landed(df.repartition(3)), **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == expected_exact(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})


def test_exact_duplicates(spark):
    check_exact(spark, ROWS)
    check_exact(spark, ROWS, max_files=1)


def test_colliding_digests_are_told_apart_by_full_bytes(spark):
    check_exact(spark, ROWS, digest=lambda t: F.length(t).cast("string"))
    check_exact(spark, ROWS, digest=lambda t: F.lit("same"))


def test_state_survives_a_restart_and_counts_no_file_twice(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    at, state = landed(df), scratch_path(spark, "state")
    first = {r.n for r in dedup.digest_groups(spark, at, state=state).collect()}
    df.union(spark.createDataFrame([(9, "a")], df.schema)).filter("doc_id = 9").write.mode("append").parquet(at)
    again = {r.keep.id: r.n for r in dedup.digest_groups(spark, at, state=state).collect()}
    assert first == {1} and again == {9: 2, 2: 1}


def test_exact_on_empty_table_and_filter(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert dedup.exact_duplicates(spark, landed(df.limit(0))).collect() == []
    kept = dedup.keep_unique(df.withColumn("_file", F.lit(3))).collect()
    assert sorted((r.text or "") for r in kept) == sorted({t or "" for _, t in ROWS})
    assert {r.doc_id for r in kept if r.text == "a"} == {7} and kept[0]._file == 3


# --- near ---------------------------------------------------------------------

def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=0, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}é" for k in range(400)]
    base = [r.choice(vocab) for _ in range(160)]
    rows, i = [], 100
    for _ in range(n):                      # one large group at many distances from its base
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, " ".join(t)))
        i += 7
    for _ in range(30):                     # pairs and strangers
        t = [r.choice(vocab) for _ in range(r.choice([3, 5, 9, 60]))]
        rows += [(i, " ".join(t)), (i + 1, "\n".join(t).upper() if r.random() < 0.5 else " ".join(t[1:]))]
        i += 7
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
             (7, "a b a b a b a b a b a"), (8, "b a b a b a b a b")]
    rows.append((9, " ".join(r.choice(vocab) for _ in range(30000))))
    r.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1.0, "k") for i, t in rows], "doc_id long, text string, n double, key string")
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert (neardup.layout(85), neardup.layout(80)) == ((25, 5), (31, 4))
    keep = {i for i, (_, c) in brute(rows, 80).items() if i == c}
    assert {r.doc_id for r in neardup.keep_representatives(df).collect()} == keep


@pytest.mark.parametrize("limit, value", [("BLOCK_ROWS", 9), ("BLOCK_SHINGLES", 2000)])
def test_open_buckets_in_small_blocks(spark, monkeypatch, limit, value):
    monkeypatch.setattr(neardup, limit, value)
    monkeypatch.setattr(neardup, "SLICE", 50)
    rows = near_rows(3, 60)
    r = random.Random(4)
    long = [f"x{k}" for k in range(4000)]
    for i in range(5):                      # long near copies
        t = [w if r.random() > 0.02 * i else "other" for w in long]
        rows.append((5000 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_near_duplicates_odd_ids(spark):
    t = "some words that make a text of more than five"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (None, "quite another text with many words here"), (8, t)],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (8, 5, False)], key=str)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (5, a + " end"), (5, b), (5, b), (None, c), (None, c + " end"), (None, d), (7, d + " end"), (9, None), (9, " "), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, _key string, kept int")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(df).collect()), key=str)
    nulls = [x for x in got if x[1] is None]
    assert sorted([x for x in got if x[1] is not None], key=str) == sorted(
        [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (None, 7, False), (7, 7, True), (9, 9, True), (9, 9, True)], key=str)
    assert sorted(nulls, key=str) == [(None, None, False), (None, None, True), (None, None, True)]
    out = neardup.keep_representatives(df)
    assert out.columns == df.columns
    kept = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted([x for x in kept if x[1] not in (c, c + " end")], key=str) == sorted(
        [(1, a), (5, b), (5, b), (7, d + " end"), (9, None), (9, " "), (None, None)], key=str)
    assert len([x for x in kept if x[1] in (c, c + " end")]) == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {k: 100 for k in range(101, 140)} | {201: 200}


def test_spanning_links_connect_all_that_is_linked():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.where(r.random(50) < p, r.integers(0, 1 << 60, 50).astype(np.uint64), base)) for p in r.random(60) * 0.3]
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    ones = np.ones(60, bool)
    found = neardup.spanning_links(list(range(60)), list(range(60)), ones, ones, sets, 85)
    assert all(linked(sets[a], sets[b]) for a, b in found)

    def parts(pairs):
        root = list(range(60))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if z in (x, y) else z for z in root]
        return root
    assert parts(found) == parts([(a, b) for a in range(60) for b in range(a) if linked(sets[a], sets[b])])


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    raw, offsets = shingles.utf8(pa.array(["The cat", None, "", "the dog cat", "x the"]))
    starts, ends, row = shingles.word_spans(raw, offsets)
    h = shingles.word_hashes(raw, starts, ends)
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4] and h[0] == h[2] == h[6] and h[1] == h[4] and len(set(h.tolist())) == 4
