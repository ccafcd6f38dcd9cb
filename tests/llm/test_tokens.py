"""Token counts (7), token files (1), range coder and pieces (8)."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import pieces, rangecoder, tokenfile, tokens
from tessera.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = ["Hello world", "", None, "a  b\n\n c\t d", "<|endoftext|> in <|endoftext|>", "日本語 текст é " * 30, " lead", "trail ",
         "x" * 5000, "word " * 4000, "it's  ' s x \x85y \x1c z", "Hello world", "line one\nline two\r\nthree"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")


@pytest.fixture(scope="module")
def expected():
    tok = Tokenizer.from_file(BPE)
    return {i * 3: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_counts_match_library(docs, expected):
    got = {r.doc_id: r for r in tokens.count_tokens(docs, BPE, limit=1000).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(v) for k, v in expected.items()}
    assert all(r.n_bytes == len((TEXTS[k // 3] or "").encode()) and r.over_limit == (r.n_tokens > 1000) for k, r in got.items())


def test_counts_of_small_batches_and_turned_over_table(docs, expected, monkeypatch):
    enc = tokens.PartEncoder(open(BPE, "rb").read(), lengths_only=False)
    monkeypatch.setattr(tokens, "CACHE_PARTS", 5)
    for _ in range(2):
        for k, ids in expected.items():
            assert np.frombuffer(enc.encode([TEXTS[k // 3]])[0], "<u2").tolist() == ids


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert tokens.count_tokens(none, BPE).collect() == []
    at = scratch_path(spark, "t")
    tokenfile.write_tokens(none, at, BPE)
    assert tokenfile.read_tokens(spark, at).collect() == []
    assert pieces.encode_pieces(none, SP).collect() == []


@pytest.mark.parametrize("frame_ids", [1, 700, 1 << 22])
def test_token_file_round_trip(spark, docs, expected, frame_ids):
    at = scratch_path(spark, "t")
    tokenfile.write_tokens(docs, at, BPE, partitions=3, frame_ids=frame_ids)
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, at).collect()}
    start = 0
    for k in sorted(expected):
        ids = expected[k] + [0]
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert (got[k].start, got[k].n_tokens) == (start, len(ids))
        start += len(ids)


def test_token_file_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "b"), (5, "a"), (5, "a"), (5, None)], "doc_id long, text string")
    at = scratch_path(spark, "t")
    tokenfile.write_tokens(df, at, BPE)
    rows = sorted(tokenfile.read_tokens(spark, at).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 5, 5, 5] and [r.n_tokens for r in rows] == [2, 1, 2, 2]


@pytest.mark.parametrize("kind", ["random", "constant", "zipf", "extremes", "periodic"])
def test_range_coder_round_trip(kind):
    r = np.random.default_rng(1)
    ids = {"random": r.integers(0, 65536, 9000), "constant": np.full(9000, 7), "zipf": r.zipf(1.3, 20000) % 50257,
           "extremes": np.where(r.random(9000) < 0.5, 0, 65535), "periodic": np.arange(9000) % 37}[kind].astype(np.uint16)
    for n in (0, 1, 2, 513, len(ids)):
        assert (rangecoder.unpack(rangecoder.pack(ids[:n])) == ids[:n]).all()
    if kind in ("constant", "periodic"):
        assert len(rangecoder.pack(ids)) < len(ids) * 2 / 5


def test_blocks_are_independent_and_checked():
    ids = (np.random.default_rng(2).zipf(1.2, 30000) % 50257).astype(np.uint16)
    frame = bytearray(rangecoder.pack(ids))
    blocks = [ids[i:i + 512] for i in range(0, 2048, 512)]
    alone = [rangecoder.encode_blocks([b])[0] for b in blocks]
    assert alone == rangecoder.encode_blocks(blocks)     # a block's code does not depend on its neighbours
    frame[-100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.unpack(bytes(frame))
    with pytest.raises(ValueError, match="not a token frame"):
        rangecoder.unpack(b"X" * 40)


# --- pieces -------------------------------------------------------------------

def whole_viterbi(v, marked):
    """Plain dynamic programme over the whole text."""
    best, back = [0] + [None] * len(marked), [None] * (len(marked) + 1)
    for start in range(len(marked)):
        for end in range(start + 1, min(len(marked), start + v.longest) + 1):
            hit = v.score.get(marked[start:end])
            options = [(hit[0], (start, [hit[1]]))] if hit else []
            if end == start + 1 and not hit:
                options.append((v.unknown_score, (start, v.fallback(marked[start]))))
            for s, b in options:
                if best[end] is None or best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, b
    ids, at = [], len(marked)
    while at:
        start, part = back[at]
        ids = part + ids
        at = start
    return ids


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(open(SP, "rb").read())


PIECE_TEXTS = [t for t in TEXTS if t] + ["  two  spaces   three", "😀 \x00 ok", "a" * 300 + " " * 50]


def test_viterbi_equals_whole_text_programme(coder):
    for t in PIECE_TEXTS:
        t = t[:600]
        want = whole_viterbi(coder.v, pieces.MARK + t.replace(" ", pieces.MARK))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == want


def test_window_is_bounded_and_feeding_in_parts_changes_nothing(coder):
    text = pieces.MARK + "thesecharactershavenospaceatall" * 400
    s, ids = pieces.StreamingViterbi(coder.v), []
    for i in range(0, len(text), 11):
        ids += s.feed(text[i:i + 11])
    assert len(ids) > 100 and s.peak < 10 * coder.v.longest
    ids += s.finish()
    assert ids == np.frombuffer(coder.word(text), "<u4").tolist()


def test_pieces_round_trip_and_columns(spark, docs, coder):
    df = pieces.decode_pieces(pieces.encode_pieces(docs.withColumn("piece_ids", F.lit(1)), SP), SP)
    rows = df.collect()
    assert df.columns == ["doc_id", "text", "n_tokens", "id", "piece_ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(TEXTS)
    assert all(zlib.crc32(r.piece_ids) == zlib.crc32(coder.encode(r.text)) for r in rows)


def test_words_without_marks_agree_with_library(coder):
    """On words whose best path is unique, the library run as a unigram model agrees."""
    import sentencepiece

    blob = open(SP, "rb").read()
    at = blob.rindex(b"tok_v0\x18\x02")
    sp = sentencepiece.SentencePieceProcessor(model_proto=blob[:at] + b"tok_v0\x18\x01" + blob[at + 8:])
    total = lambda ids: sum(coder.v.score[coder.v.piece[i]][0] for i in ids)
    for w in ["the", "information", "segmentation", "unbelievable", "streaming", "window"]:
        ours, theirs = np.frombuffer(coder.encode(w), "<u4").tolist(), sp.encode(w)
        assert total(ours) >= total(theirs)
