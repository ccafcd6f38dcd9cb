"""BPE encoding and decoding (12) against the library."""

import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF001
from tokenizers import Tokenizer

from tessera.llm import bpe, queries

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Words, marks, white space of both kinds, letters that change length or order, special strings and near misses.
BITS = ["a", "b", "the", "in", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", " ", "é", "é", "́", "Å", "Σ", "ς",
        "İ", "ǅ", "ﬁ", "가", "한", "日本", "😀", "‍", "̈́", "ͅ", "߀", "Ⅷ", "THE", "'s", "'", "'ll", "'D", "1", "23",
        "½", "²", ".", "!?", ",", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "<", "x" * 20, "aaaa"]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(WORD_BPE)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def blob():
    with open(WORD_BPE, "rb") as f:
        return f.read()


def same(enc, library, texts):
    ids = enc.encode(pa.array(texts, pa.string()))
    for t, got, text in zip(texts, ids.to_pylist(), enc.decode(ids).to_pylist()):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got == want, t
        assert text == library.decode(want, skip_special_tokens=False)


def test_random_texts_match_library(blob, library, monkeypatch):
    rng = random.Random(5)
    enc = bpe.WordEncoder(blob)
    for turn in range(60):
        if turn == 30:
            monkeypatch.setattr(bpe, "CACHE_PARTS", 20)         # tables turn over
        same(enc, library, [None, "", " "] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(40)])


def test_every_character_below_the_plain_limit(blob, library):
    enc = bpe.WordEncoder(blob)
    same(enc, library, [f"a{chr(c)}b {chr(c)} {chr(c)}1 .{chr(c)}, a{chr(c)}" for c in range(0x340)])


def test_very_long_words(blob, library):
    rng = random.Random(1)
    same(bpe.WordEncoder(blob), library, ["a" * 20001, "ab" * 20000, "".join(rng.choice("etaoinshr") for _ in range(20000)),
                                          "word " * 20000, "ñ" * 5000])


def test_one_merge_at_a_time_gives_the_same_symbols(blob):
    m = bpe.WordEncoder(blob).merges
    ranks = dict(zip(m.keys[:-1].tolist(), m.ranks[:-1].tolist()))
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("aabnt") for _ in range(rng.randint(1, 25))).encode() for _ in range(5)]
        expected = []
        for w in words:
            sym = [int(m.inner[b]) for b in w[:-1]] + [int(m.final[w[-1]])]
            while True:
                known = [(ranks[k], i) for i, k in enumerate(a * m.base + b for a, b in zip(sym, sym[1:])) if k in ranks]
                if not known:
                    break
                r, i = min(known)
                sym[i:i + 2] = [int(m.made[r])]
            expected.append(sym)
        sym, sizes = m.encode(words)
        assert sizes.tolist() == [len(x) for x in expected]
        assert sym.tolist() == sum(expected, [])


def test_other_models_are_refused(blob):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        with pytest.raises(ValueError):
            bpe.WordEncoder(f.read())
    spec = json.loads(blob)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.WordEncoder(json.dumps(spec).encode())


def test_table_with_edge_cases(spark, library):
    rows = [(1, None, "clash", 1), (2, "", "clash", 1), (None, "Hello  World", "clash", 1), (3, "same text", "clash", 1),
            (3, "same text", "clash", 1), (4, "long text, " * 5000, "clash", 1), (5, " \n\t ", "clash", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded int")
    out = bpe.decode_words(bpe.encode_words(docs, WORD_BPE), WORD_BPE)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.token_ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.decode_words(bpe.encode_words(docs.limit(0), WORD_BPE), WORD_BPE).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert bpe.decode_words(null, WORD_BPE).first().decoded == ""


def test_query_on_a_whole_table(spark, library):
    got = {r.doc_id: r for r in queries.op12(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
