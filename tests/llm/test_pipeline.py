"""The corpus pipeline against its stages' definitions on a small table."""

import random
import re
from collections import Counter

import corpus_pipeline
import __spark_entry__
from conftest import SF001
from test_duplicates import brute

from tessera.llm import mixing, pieces
from tessera.llm.common import load, stored


def test_names_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_pipeline_on_planted_rows(spark, tmp_path):
    docs = load(spark, SF001, "documents")
    one = docs.filter("doc_id = 3").first()
    words = one.text.split(" ")
    near = " ".join(words[:40] + ["changed"] + words[41:])
    planted = [(900001, one.text, "en", "src0", 1), (900002, near, "en", "src0", 1), (900003, "12 34 ..", "en", "src0", 1),
               (900004, None, "en", "src0", 1), (900005, "", None, None, None)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "piece_ids"]
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {900003, 900004, 900005}

    # brute force of the stages that have one: equal texts keep the largest id, near copies the smallest
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    by_text = {}
    for i, t in texts.items():
        by_text[t] = max(i, by_text.get(t, i))
    component = brute([(i, t) for t, i in by_text.items()], 80)
    kept = {i for i, (_, c) in component.items() if c == i}
    assert ids <= kept
    mixed = docs.filter(docs.doc_id.isin(list(kept)))
    times = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.taken(mixed).collect() if r.size}
    found = Counter(r.doc_id for r in rows)
    assert found == {i: n for i, n in times.items() if n}
    decoded = pieces.decode_pieces(out, __import__("public_tokenizers").path("piece_bpe_32k.model")).collect()
    assert all(r.decoded == r.text for r in decoded)


def test_pipeline_on_odd_tables(spark, tmp_path):
    r = random.Random(2)
    words = {"en": ["the", "house", "water", "green", "with", "people"], "fr": ["maison", "avec", "verte", "les", "gens", "eau"],
             "de": ["haus", "mit", "wasser", "das", "leute", "und"]}
    text = lambda langs, n: " ".join(r.choice(words[langs[k % len(langs)]]) for k in range(n))
    rows = [(i, text([g], 40), g, "s1", i) for i, g in enumerate(["en", "fr", "de"] * 8)]
    rows += [(100, text(["en", "fr", "de"], 60), "en", "s1", 1), (101, text(["en", "fr", "de"], 45), None, "s2", 1),    # evenly mixed
             (102, text(["en"], 30), "en", None, 1), (102, text(["fr"], 30), "fr", None, 1), (None, text(["de"], 30), "de", "s2", None),
             (103, text(["en"], 30000), "en", "s2", 1), (104, None, None, None, None), (105, "", "en", "s2", 0), (106, "12 !", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece_ids string, slot long, kept long, size string"
    docs = spark.createDataFrame([(*x, "own", 1, 2, "3") for x in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = load(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        table = stored(stage(spark, table, str(tmp_path)), f"test-{name}")
        assert table.columns == docs.columns
        assert {x.text for x in table.collect()} == {x[1] for x in rows[:-3]}, name      # clean rows all stay
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(docs.columns)
    assert out.where("text is null").count() == 0

    none = tmp_path / "none"
    docs.limit(0).write.parquet(str(none / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(none)).collect() == []
