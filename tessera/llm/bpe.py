"""BPE encoding and decoding in batched merge rounds (12).

All words of a batch that have not been seen before lie in one flat array of
symbols.  A round looks up the rank of each new pair by binary search over the
sorted pair keys, takes the lowest rank of each word and merges that pair
wherever the word holds it, from left to right.  A word is done when it has no
pair with a rank.  Merge lists in which a pair comes before its own parts are
refused, so a merge never makes a pair that should have come before it, and
one pair per word and round gives the same symbols as one merge at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.llm.common import text_batches
from tessera.llm.tokens import broadcast_file

BATCH_BYTES = 2 << 20
#: Parts of texts a worker keeps; at twice as many the older half goes.
CACHE_PARTS = 300_000
CACHE_PART_CHARS = 48
#: Below this character, NFC leaves each text as it is and no case depends on a neighbour.
PLAIN_BELOW = "\u0300"
#: Marks that are neither letters nor numbers nor start a word pattern of their own.
MARKS = ".,;:!?"
_NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i]`` to ``starts[i] + sizes[i]`` of all i, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Merges:
    """Symbols and merges of a BPE model; ``encode`` is the batch of rounds."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        alphabet = byte_alphabet()
        missing = [c for c in alphabet if c not in vocab or c + suffix not in vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} bytes")
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.base = max(vocab.values()) + 1
        known = {*alphabet, *(c + suffix for c in alphabet)}
        keys, made = [], []
        for pair in merges:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a not in known or b not in known:
                raise ValueError(f"merge of {a!r} and {b!r} comes before its parts")
            known.add(a + b)
            keys.append(vocab[a] * self.base + vocab[b])
            made.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[by], np.iinfo(np.int64).max), np.append(by, _NO_RANK).astype(np.int32)
        self.made = np.array(made, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and their number per word
        (no word may be empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _NO_RANK, np.int32)            # of the pair that starts at each symbol
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.append(first, len(sym))))
            open_ = low != _NO_RANK
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, low = sym[open_], word[open_], rank[open_], low[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            # overlapping places (the pair of a symbol with itself): every other one of a chain
            chain = np.append(True, np.diff(at) != 1)
            head = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            again = np.zeros(len(sym) + 1, bool)
            again[at] = again[at - 1] = True                    # at - 1 may be -1, the spare last place
            again = np.flatnonzero(again[:-1])
            rank[again] = _NO_RANK
            pair = again[again < len(sym) - 1]
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self.rank(sym[pair], sym[pair + 1])
        word = np.concatenate(done_word)
        return np.concatenate(done_sym)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class WordEncoder:
    """Encodes whole texts with a word-level BPE of a ``tokenizers`` file.

    White space always ends a word and belongs to none, so the text is cut at
    ASCII white space and each new part is normalised, cut into words and
    merged once.  Parts with characters from U+0300 on go through the
    library's own normaliser and splitter, whose Unicode tables they need.
    """

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        model = spec["model"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split, letters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        fits = (model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"]
                and not model["dropout"] and not model.get("ignore_merges") and steps == ["NFC", "Replace", "Lowercase"]
                and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
                and letters.get("type") == "ByteLevel" and not letters["add_prefix_space"] and not letters["use_regex"]
                and spec["decoder"] is None and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
                and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                        and not re.search(r"\s", t["content"]) for t in spec["added_tokens"]))
        if not fits:
            raise ValueError("not a lower-casing word BPE with a word-end suffix over bytes")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.library = Tokenizer.from_str(blob.decode("utf-8"))
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        tokens = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        #: ids per part, as little-endian bytes; the table before the last turn-over
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[bytes]:
        """Words of a part without special strings, in UTF-8."""
        if text.isascii() or max(text) < PLAIN_BELOW:
            return [w.encode() for w in self.words.findall(text.lower())]
        plain = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _fill(self, parts: list[str]) -> None:
        """Encode parts that are not in the table."""
        index: dict[bytes, int] = {}                            # distinct words of these parts
        place = index.setdefault
        of_part = []                                            # per part: a word's place, or -1 - id of a special string
        for p in parts:
            low = p.lower()
            stem = low.rstrip(MARKS)
            if stem.isalpha() and (p.isascii() or max(p) < PLAIN_BELOW):     # letters, then marks: one word, or two
                word = place(stem.encode(), len(index))
                of_part.append((word,) if stem == low else (word, place(low[len(stem):].encode(), len(index))))
                continue
            pieces, at = [], 0
            for m in [*(self.cut.finditer(p) if "<" in p else ()), None]:
                between = p[at:m.start() if m else len(p)]
                if between:
                    pieces += [place(w, len(index)) for w in self._words(between)]
                if m:
                    pieces.append(-1 - self.special[m.group()])
                    at = m.end()
            of_part.append(pieces)
        if index:
            sym, sizes = self.merges.encode(list(index))
            raw, ends = sym.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            begins = [0, *ends]
            coded = [raw[a:b] for a, b in zip(begins, ends)]
        for p, pieces in zip(parts, of_part):
            self.seen[p] = (coded[pieces[0]] if len(pieces) == 1 and pieces[0] >= 0 else
                            b"".join([coded[i] if i >= 0 else (-1 - i).to_bytes(4, "little") for i in pieces]))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids per text (null: none)."""
        if len(self.seen) > CACHE_PARTS:
            self.older, self.seen = self.seen, {}
        self.seen[""] = b""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.seen.get, distinct))
        missing = [i for i, known in enumerate(ids) if known is None]
        if self.older:
            for i in missing:
                if (known := self.older.get(distinct[i])) is not None:
                    self.seen[distinct[i]] = ids[i] = known
            missing = [i for i in missing if ids[i] is None]
        self._fill([distinct[i] for i in missing])
        for i in missing:
            ids[i] = self.seen[distinct[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<i4")
        index = coded.indices.to_numpy()
        of_part = sizes[index]
        out = flat[ragged((np.cumsum(sizes) - sizes)[index], of_part)]
        edges = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
        edges = np.append(0, np.cumsum(of_part))[edges]
        long = pc.greater(pc.utf8_length(coded.dictionary), CACHE_PART_CHARS)
        for p in coded.dictionary.filter(long).to_pylist():    # long parts hardly repeat
            del self.seen[p]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(out, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text per list of ids: its tokens joined by a space, as the file names no decoder."""
        flat = ids.flatten()
        text = self.tokens.take(flat)
        edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), text), " ")


_ENCODERS: dict = {}


def encoder(blob: bytes) -> WordEncoder:
    """One encoder per worker process; workers are reused by tasks."""
    key = (len(blob), hash(blob))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(blob)
    return _ENCODERS[key]


def encode_words(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the ids of each whole text.

    ``tokenizer`` is a ``tokenizers`` file with a lower-casing word BPE over
    bytes (others raise ValueError); special strings inside texts count as the
    library counts them, no start or end id is added, nothing is cut or
    padded.  Null, empty and blank texts have no ids.  Repeated rows are
    treated one by one; a column named ``ids_col`` is replaced, all others are
    kept.  Memory follows a batch of ``BATCH_BYTES`` of text (or one longer
    text) and a bounded table of parts.
    """
    blob = broadcast_file(docs.sparkSession, tokenizer)
    kept = docs.drop(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value)
        for b in text_batches(batches, text_col, BATCH_BYTES):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, enc.encode(b.column(text_col))], names=[*b.schema.names, ids_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode_words(df: DataFrame, tokenizer: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the text of the ids in ``ids_col`` as the
    library decodes them, special tokens included (null or no ids: empty)."""
    blob = broadcast_file(df.sparkSession, tokenizer)
    kept = df.drop(out_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value)
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column(ids_col)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:                              # runs of about BATCH_BYTES ids
                done = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_BYTES)))
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, enc.decode(part.column(ids_col))], names=[*b.schema.names, out_col])
                at = end

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out_col, StringType())]))
