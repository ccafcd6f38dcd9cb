"""Periodic runs (11) against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from conftest import SF0001

from tessera.llm import queries, runs


def brute(w, min_length, min_exponent):
    """All runs by the definition: each period, each stretch that keeps it; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def without(w, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def kernel(texts, min_length, min_exponent):
    found, collapsed = runs._batch_runs(pa.array(texts, pa.string()), min_length, min_exponent)
    return [[(r["start"], r["length"], r["period"]) for r in f] for f in found.to_pylist()], collapsed.to_pylist()


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_random_words_of_small_alphabets(exponent):
    rng = random.Random(exponent)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(3, 9)
                w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            docs.append(w)
        least = rng.choice([1, 6])
        found, collapsed = kernel([" ".join(w) for w in docs], least, exponent)
        for w, f, c in zip(docs, found, collapsed):
            assert f == brute(w, least, exponent)
            assert c == without(w, f)


@pytest.mark.parametrize("w, expected", [
    (["a"] * 50000, (0, 50000, 1)), (["a", "b"] * 25000, (0, 50000, 2)),
    ([str(i) for i in range(12000)] * 4, (0, 48000, 12000)), (["x"] + ["y", "z"] * 9000 + ["y"], (1, 18001, 2))])
def test_very_long_texts(w, expected):
    assert kernel([" ".join(w)], 6, 4)[0] == [[expected]]


def test_only_the_six_blank_characters_split_words():
    found, collapsed = kernel(["a\x1cb \t a\x1cb\x0b\x0ca\x1cb\r\na\x1cb  a\x1cb a\x1cb", "a\xa0a a a a\x85a a"], 6, 4)
    assert found == [[(0, 6, 1)], []]
    assert collapsed == ["a\x1cb", "a\xa0a a a a\x85a a"]


def test_table_with_edge_cases(spark):
    rows = [(1, None, "c", 1), (2, "", "c", 1), (3, " \n ", "c", 1), (None, "a a a a a a a b", "c", 1),
            (5, "a b a b a b a b", "c", 1), (5, "a b a b a b a b", "c", 1), (6, "b " * 5, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int")
    out = runs.periodic_runs(docs, batch_bytes=20)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 7, 1)], "a b"), (5, [(0, 8, 2)], "a b"),
                          (5, [(0, 8, 2)], "a b"), (6, [], "b b b b b")], key=str)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def test_strongest_run_and_its_ties(spark):
    some = [[(0, 8, 2), (9, 9, 1)], [(3, 12, 3), (20, 8, 2), (30, 4, 1)], [], [(0, 7, 2), (9, 7, 2)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(some)], f"i int, runs {runs.RUN_TYPE}")
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", runs.strongest(df.runs).alias("b")).collect()}
    assert got == {0: (9, 9, 1), 1: (3, 12, 3), 2: None, 3: (0, 7, 2)}


def test_query_on_a_whole_table(spark):
    got = {r.doc_id: r for r in queries.op11(spark, SF0001).collect()}
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", d.text or "") if x]
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            planted += 1
        if n > 3000:
            continue
        found = brute(w, 6, 4)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(without(w, found).encode()).hexdigest()
    assert planted > 5
