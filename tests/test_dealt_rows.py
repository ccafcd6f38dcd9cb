"""Documents and pairs dealt once: what is counted per document or pair is not shuffled again."""

import hashlib
import math
import re
from collections import Counter

import pytest

from tessera.operators import generate as G
from tessera.operators import metrics as M
from tessera.operators import patterns as P
from tessera.plans.q_generate import q_hashed_text_vectors

from conftest import SF0001


def exchanges(df):
    """Lines of the plan that shuffle rows, before any run-time change."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if re.search(r"(?<!Broadcast)\bExchange \w", x)]


def test_hashed_vectors_shuffle_texts_only(spark):
    """the (document, dim) rows of a task follow its share of the texts; they were shuffled to a fixed number of tasks."""
    lines = exchanges(q_hashed_text_vectors(spark, SF0001))
    assert len(lines) == 1 and "doc_id" in lines[0] and "dim" not in lines[0]


def test_hashed_vectors_of_keys_that_repeat_or_are_null(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["c"]), (None, ["a"]), (2, [])]
    got = {(r.k, r["dim"]): r.value for r in G.hashed_vectors(
        spark.createDataFrame(rows, "k BIGINT, tokens ARRAY<STRING>"), "k", 8).collect()}
    total, longest = Counter(), Counter()
    for tok, n in (("a", 3), ("b", 3), ("a", 3), ("c", 1)):
        h = hashlib.md5(tok.encode()).hexdigest()
        d = int(h[:8], 16) % 8
        total[d] += 1 if int(h[8], 16) < 8 else -1
        longest[d] = max(longest[d], n)
    total = {d: v / longest[d] for d, v in total.items() if v}
    size = math.sqrt(sum(v * v for v in total.values()))
    assert got == {(1, d): pytest.approx(v / size) for d, v in total.items()}


def test_overlap_shuffles_no_grams(spark):
    """F32: n-grams are counted in the task that holds their pair."""
    rows = [("p", "a b a b c", "a b c a"), ("q", "", "x y"), ("p", "a", "z"), (None, "a b", "a b"), ("r", None, "k")]
    pairs = spark.createDataFrame(rows, "pair_id STRING, gen STRING, ref STRING")
    o = M.overlap(pairs, (1, 2))
    assert not [x for x in exchanges(o) if "gram" in x]
    got = Counter((r.pair_id, r.n, r.gen_len, r.ref_len, r.matches, r.gen_total, r.ref_total) for r in o.collect())
    # texts of one pair_id are counted together: gen "a b a b c" and "a", ref "a b c a" and "z"
    assert got == Counter([("p", 1, 5, 4, 4, 6, 5), ("p", 2, 5, 4, 2, 4, 3), ("p", 1, 1, 1, 4, 6, 5), ("p", 2, 1, 1, 2, 4, 3),
                           ("q", 1, 0, 2, 0, 0, 2), ("q", 2, 0, 2, 0, 0, 1), (None, 1, 2, 2, 0, 0, 0), (None, 2, 2, 2, 0, 0, 0),
                           ("r", 1, None, 1, 0, 0, 1), ("r", 2, None, 1, 0, 0, 0)])


def test_only_rare_tokens_are_shuffled_to_be_encoded(spark):
    rows = [(1, "b a a c"), (None, "a d"), (None, "d b"), (2, "d e"), (1, "a e"), (3, "x"), (4, None), (5, "a " + "z" * 100)]
    dt = P.tokenize_docs(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    vocab = P.vocabulary(dt).filter("token <> 'c'").cache()
    ids = {r.token: r.token_id for r in vocab.collect()}
    want = {}
    for doc, text in rows:
        toks = (text or "").split()
        if len(toks) > 1:
            want.setdefault(doc, []).extend((i, ids.get(t, -1)) for i, t in enumerate(toks))
    want = sorted((repr(doc), [i for _, i in sorted(x)]) for doc, x in want.items())
    for common in (0, 2, 1000):
        got = P.encode(dt, vocab, common=common)
        assert sorted((repr(r.doc_id), r.ids) for r in got.collect()) == want
    # texts are dealt once, by document; what goes to the vocabulary and back is filtered first
    plan = P.encode(dt, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [token" in plan and "LeftAnti" in plan
    assert plan.count("hashpartitioning(_doc") - plan.count("REPARTITION_BY_NUM") == 1
