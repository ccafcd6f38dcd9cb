"""Phrase collocations (13) against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
        if w:
            yield w


def all_counts(rows):
    f = {}
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for w in pieces(text):
            for k in range(1, 5):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, min_count, covered, top):
    out = []
    for lang, f in all_counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * cand[q] >= covered * a
                         and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in cand)
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, rest) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, rest, n, -score))
    return sorted(out)


def run(spark, rows, **args):
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase int, f string").repartition(3)
    out = phrases.collocations(docs, **args)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def invented(seed, docs=60):
    rng = random.Random(seed)
    common, rare = ["the", "of", "Ünd", "a", "b", "c"], [f"w{i}" for i in range(40)]
    passage = " ".join(f"law{i}" for i in range(30))
    rows = []
    for i in range(docs):
        w = [rng.choice(common if rng.random() < 0.7 else rare) + rng.choice(["", "", "", "", ",", ".", "\n", "\t", "\x1c"])
             for _ in range(rng.randint(0, 120))]
        if i % 4 == 0:
            w.insert(len(w) // 2, passage)
        rows.append((rng.choice(["en", "en", "fr", None]), " ".join(w)))
    return rows


@pytest.mark.parametrize("min_count, covered, top", [(3, 80, 2000), (8, 50, 10)])
def test_matches_counts_of_every_phrase(spark, monkeypatch, min_count, covered, top):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 3000)
    rows = invented(min_count) + [(None, None), ("en", ""), ("fr", " .,\n"), ("en", "The Of THE of the of"), ("en", "the of " * 3000)]
    rows += rows[:3]
    expected = brute(rows, min_count, covered, top)
    assert len(expected) > 20
    assert run(spark, rows, min_count=min_count, covered_percent=covered, top=top) == expected


def test_full_filters_only_let_more_through(spark, monkeypatch):
    rows = invented(9)
    monkeypatch.setattr(phrases, "filter_bits", lambda df, h: df.sparkSession.sparkContext.broadcast(
        np.full(phrases.FILTER_BITS // 8, 255, np.uint8).tobytes()))
    assert run(spark, rows, min_count=4) == brute(rows, 4, 80, 2000)


def test_paths_of_long_passages_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PATH_EDGES", 7)
    edges = [("en", f"w{i} w{i + 1} w{i + 2} w{i + 3}", 5) for i in range(40)]                 # one path
    edges += [("en", "w17 w18 w19 x", 4), ("en", "x a b c", 2), ("en", "y a b c", 2), ("en", "a b c d", 2)]
    edges += [("fr", f"c{i} c{(i + 1) % 5} c{(i + 2) % 5} c{(i + 3) % 5}", 3) for i in range(5)]   # a cycle
    edges += [("fr", "z z z z", 9), ("de", "w0 w1 w2 w3", 5)]
    df = spark.createDataFrame(edges, "lang string, phrase string, weight long")
    rows = phrases.unary_paths(df).collect()
    back = []
    for r in rows:
        w = r.path.split(" ")
        assert len(w) == r.n_edges + 3 and r.n_edges <= 7
        back += [(r.lang, " ".join(w[i:i + 4]), r.weight) for i in range(r.n_edges)]
    assert sorted(back) == sorted(edges)                       # nothing lost, nothing twice
    heads = {}
    for r in rows:
        heads.setdefault((r.lang, r.head), []).append(r.n_edges)
    assert sum(heads["en", "w0 w1 w2 w3"]) == 17 and sum(heads["en", "w17 w18 w19 w20"]) == 23   # the branch cuts the path
    assert sum(heads["fr", "c0 c1 c2 c3"]) == 5
    assert heads["en", "a b c d"] == [1] and heads["fr", "z z z z"] == [1] and heads["de", "w0 w1 w2 w3"] == [1]
    assert phrases.unary_paths(df.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    big = 1 << 60
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big * 8 // 10)], "lang string, phrase string, n_words int, f long")
    singles = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 3), ("en", "c", big)], "lang string, phrase string, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(counts, singles, 80).collect()}
    a3 = big * 8 // 10
    expected = {"a b c": (a3, big, big, 2000000 * a3 // (2 * big))} | (
        {} if 100 * a3 >= 80 * big else {"a b": (big, big + 1, big + 3, 2000000 * big // (2 * big + 4))})
    rest = dict(got)
    assert rest.pop("a b", None) == expected.pop("a b", None)
    assert got["a b c"][0] == a3 and got["a b c"][3] <= expected["a b c"][3]


def test_empty_table_and_bad_count(spark):
    assert run(spark, [], min_count=2) == []
    assert run(spark, [("en", None)], min_count=2) == []
    with pytest.raises(ValueError):
        run(spark, [], min_count=1)
