"""SentencePiece encoding and decoding by streaming Viterbi (8).

The segmentation of a text is the path of pieces with the highest sum of
scores.  ``StreamingViterbi`` reads characters one by one and keeps only a
window as long as the longest piece: every later path goes through it.  When
the back pointers of all positions in the window meet in one boundary, the
ids up to it can no longer change and are committed.

Where no piece of the vocabulary holds a space mark behind another
character, all paths meet in front of each run of marks.  Texts are cut there
and each task keeps a bounded table of the words it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tessera.llm.common import text_batches
from tessera.llm.tokens import broadcast_file

#: Fixed values of the SentencePiece model format: the space mark and the extra cost of an unknown character.
MARK = "▁"
UNKNOWN_COST = 10
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_WORDS = 300_000
CACHE_WORD_CHARS = 48
BATCH_BYTES = 2 << 20


class Vocabulary:
    """Pieces, scores and special ids of a model file."""

    def __init__(self, blob: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.sp, n = sp, sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.piece[i]: (int(s) if (s := sp.get_score(i)).is_integer() else s, i) for i in normal}
        self.longest = max(map(len, self.score))
        self.suffixes = {p[k:] for p in self.score for k in range(len(p))}
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: bytes([v]) for v, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.unknown_score = min(s for s, _ in self.score.values()) - UNKNOWN_COST
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.raw = [self.byte_of[i] if i in self.byte_of else
                    b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in char.encode("utf-8")]


class StreamingViterbi:
    """Feed characters; committed ids come out as soon as they are certain.

    Equal scores: the path whose last piece starts first wins.  Memory is a
    window of ``longest`` characters plus what is not committed yet.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.tail = ""                      # characters behind the last committed boundary
        self.base = 0                       # that boundary
        self.best = [0]                     # score of the best path to each position from base on
        self.back: list = [None]            # (start, ids) of its last piece
        self.peak = 0                       # most positions held at once

    def feed(self, chars: str) -> list[int]:
        """Read characters; the ids they make certain."""
        out: list[int] = []
        step = self.v.longest
        while chars:     # up to the next multiple of the window
            n = step - len(self.tail) % step
            self._extend(chars[:n])
            chars = chars[n:]
            if len(self.tail) % step == 0:
                out += self._commit()
        return out

    def _extend(self, chars: str) -> None:
        """Best paths to the boundaries behind each of ``chars``."""
        score, suffixes, unknown = self.v.score, self.v.suffixes, self.v.unknown_score
        best, back, old = self.best, self.back, len(self.tail)
        self.tail = tail = self.tail + chars
        for end in range(old + 1, len(tail) + 1):
            # pieces that end here; of equal totals the longest piece wins
            top, link = None, None
            start = end - 1
            piece = tail[start]
            while piece in suffixes:
                hit = score.get(piece)
                if hit is not None:
                    total = best[start] + hit[0]
                    if top is None or total >= top:
                        top, link = total, (start, hit[1])
                if not start:
                    break
                start -= 1
                piece = tail[start:end]
            if tail[end - 1] not in score:
                total = best[end - 1] + unknown
                if top is None or total > top:
                    top, link = total, (end - 1, None)
            best.append(top)
            back.append(link)
        self.peak = max(self.peak, len(tail) + 1)

    def _commit(self) -> list[int]:
        """Commit up to the boundary that all paths in the window share."""
        end = len(self.tail)
        alive = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self.back[top][0])
        at = alive.pop()
        if at == 0:
            return []
        ids = self._path(at)
        self.base += at
        self.tail = self.tail[at:]
        self.best = self.best[at:]
        self.back = [None] + [(s - at, i) for s, i in self.back[at + 1:]]
        return ids

    def _path(self, at: int) -> list[int]:
        ids = []
        while at:
            start, piece = self.back[at]
            if piece is not None:
                ids.append(piece)
            else:
                ids += reversed(self.v.fallback(self.tail[start:at]))
            at = start
        ids.reverse()
        return ids

    def finish(self) -> list[int]:
        """The ids that are left."""
        ids = self._path(len(self.tail))
        self.base += len(self.tail)
        self.tail, self.best, self.back = "", [0], [None]
        return ids


class PieceCoder:
    def __init__(self, blob: bytes):
        self.v = Vocabulary(blob)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, unit: str) -> bytes:
        """Ids of a run of characters that is segmented on its own."""
        s = StreamingViterbi(self.v)
        return b"".join(map(self.v.packed.__getitem__, s.feed(unit) + s.finish()))

    def _lookup(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.word(unit)
        if len(unit) <= CACHE_WORD_CHARS:
            self.seen[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.seen) > CACHE_WORDS:
            self.older, self.seen = self.seen, {}
        marked = (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.v.words_apart:
            return self.word(marked)
        get, look = self.seen.get, self._lookup
        return b"".join([get(u) or look(u) for u in _UNITS.findall(marked)])

    def decode(self, raw: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        parts = self.v.raw
        text = b"".join([parts[i] for i in np.frombuffer(raw or b"", "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


_CODERS: dict = {}


def coder(blob: bytes) -> PieceCoder:
    key = (len(blob), hash(blob))
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(blob)
    return _CODERS[key]


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with ``ids_col`` (binary, little-endian unsigned 32-bit ids).

    ``model`` is a SentencePiece file with the identity normaliser.  Null and
    empty texts have no ids.  A column of the same name is replaced.
    """
    blob = broadcast_file(docs.sparkSession, model)
    kept = docs.drop(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(blob.value)
        for b in text_batches(batches, text_col, BATCH_BYTES):
            ids = pa.array([c.encode(t) for t in b.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, ids_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(ids_col, BinaryType())]))


def decode_pieces(df: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the text of the ids in ``ids_col`` (null: empty)."""
    blob = broadcast_file(df.sparkSession, model)
    kept = df.drop(out_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(blob.value)
        for b in text_batches(batches, ids_col, 2 * BATCH_BYTES):
            text = pa.array([c.decode(r) for r in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, out_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out_col, StringType())]))
