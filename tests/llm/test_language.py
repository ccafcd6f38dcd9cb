"""Language ID by a conditional random field (5)."""

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import crf

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="module")
def model(docs):
    return crf.train(docs, sample_rows=40)


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    for n, k in ((1, 2), (4, 3), (5, 2)):
        e, t = r.normal(size=(n, k)), r.normal(size=(k, k))
        want, total = np.zeros((n, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            first = sum(np.exp(t[i, path[0]]) for i in range(k))
            w = first * np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(crf.forward_backward(e, np.array([n]), t), want / total)


def test_chunks_do_not_change_probabilities(monkeypatch):
    r = np.random.default_rng(1)
    lengths = np.array([1, 200, 3, 64, 65, 500])
    e, t = r.normal(size=(lengths.sum(), 3)), r.normal(size=(3, 3))
    a = crf.forward_backward(e, lengths, t)
    monkeypatch.setattr(crf, "CHUNK", 10_000)
    assert np.allclose(a, crf.forward_backward(e, lengths, t))


def test_expected_transitions_equal_enumeration():
    r = np.random.default_rng(2)
    e, t = r.normal(size=(4, 2)), r.normal(size=(2, 2))
    want, total = np.zeros((2, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        w = sum(np.exp(t[i, path[0]]) for i in range(2)) * np.exp(
            sum(e[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        total += w
        for a, b in zip(path, path[1:]):
            want[a, b] += w
    p = crf.forward_backward(e, np.array([4]), t)
    assert np.allclose(crf.pair_counts(e, p, np.array([4]), t, np.arange(3)), want / total)


def test_held_out_accuracy(docs, model):
    got = {r.doc_id: r for r in crf.label_documents(docs, model).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    marks = {r.doc_id: r.held_out for r in docs.select("doc_id", crf.held_out("doc_id").alias("held_out")).collect()}
    assert {k for k, v in marks.items() if v} == {r.doc_id for r in held}


def test_code_switching_and_odd_texts(spark, model):
    rows = [(1, "And the thand hea thing of the on. Und der die einheit verkeit ung schein der. Los de la cióndo que mente"),
            (2, "1234 $$ --"), (3, None), (4, ""), (5, "the " * 50000), (None, "und der die"), (5, "der"), (6, "日本")]
    df = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = crf.label_documents(df, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert [x.lang for x in by_id[1].runs] == ["en", "de", "es"] and [x.n for x in by_id[1].runs] == [8, 8, 6]
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 and by_id[k].runs == [] for k in (2, 3, 4))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by_id[None].lang_pred == "de" and by_id[6].lang_pred in model.langs


def test_no_labels_empty_table_and_filter(spark, docs):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in crf.identify(df).collect()] == ["und", "und"]
    assert crf.identify(df.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "12", "en"), (3, None, None)], df.schema)
    assert [r.doc_id for r in crf.keep_identified(one).collect()] == [1]
    assert crf.keep_identified(one).columns == one.columns


def test_training_ignores_held_out_and_sample_is_bounded(docs):
    rows = crf.training_rows(docs, "doc_id", "text", "lang")
    assert all(zlib.crc32(str(r.id).encode()) % 4 != 2 for r in rows.select("id").collect())
    chosen = crf.sample(rows, ["de", "en", "es", "fr"], 5)
    assert len(chosen) == 20
    again = crf.sample(rows.repartition(7), ["de", "en", "es", "fr"], 5)
    assert [r.id for r in chosen] == [r.id for r in again]


def test_lexicon_counts_all_words(spark):
    df = spark.createDataFrame([(1, "a b a", "x"), (2, "b", "y")], "id long, text string, lang string")
    t = crf.count_lexicon(df, ["x", "y"])
    w = crf.Words(pa.array(["a b"]))
    a, b = w.buckets()[w.which]
    assert t.sum() == 4 and t[a].tolist() == [2, 0] and t[b].tolist() == [1, 1]
