"""Batch tokenisation in Arrow functions, and token counts (7).

A byte-level BPE splits a text into pre-tokens before any merge.  A single
space between two non-space characters always starts a new pre-token and no
special string holds a space, so a text may be cut in front of such a space
and its parts encoded apart: the ids are those of the whole text.  Parts
repeat, so each task keeps a bounded table of parts it has seen and the
library encodes each new part once, in batches of about equal bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_batches

#: A space between two non-space characters.  Python's ``\\S`` leaves out at
#: least all that the tokenizer's ``\\s`` holds, so each cut is safe.
SAFE_CUT = re.compile(r" (?<=\S )(?=\S)")
BATCH_BYTES = 2 << 20
#: Parts a task keeps; at twice as many the older half goes.
CACHE_PARTS = 350_000
JOINED_CHARS = 1000
JOINED_AT_ONCE = 64
CACHE_PART_CHARS = 48


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file (a few MB, a fixed size) for the tasks, so that its
    path only has to exist on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def runs(parts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive parts of about ``chars`` characters together."""
    at, size = 0, 0
    for i, p in enumerate(parts):
        if size and size + len(p) > chars:
            yield parts[at:i]
            at, size = i, 0
        size += len(p) + 2
    if at < len(parts):
        yield parts[at:]


class PartEncoder:
    """Encodes texts part by part through the tokenizers library."""

    def __init__(self, blob: bytes, lengths_only: bool, width: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(blob.decode("utf-8"))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lengths_only = lengths_only
        self.dtype = np.dtype("<u2") if width == 2 else np.dtype("<u4")
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids[0]
        #: Parts that follow a space, kept without it; the table before the last turn-over.
        self.later: dict = {}
        self.older: dict = {}

    def _value(self, ids):
        return len(ids) if self.lengths_only else np.asarray(ids, self.dtype).tobytes()

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            yield e.ids

    def _fill(self, parts: set) -> None:
        """Encode the parts not seen yet.  Those without a line feed go many
        to a string, joined by one: in front of a space it is always a token
        of its own, so the ids between two of them are those of a part."""
        todo = []
        for p in parts:
            if p not in self.later:
                if p in self.older:
                    self.later[p] = self.older[p]
                else:
                    todo.append(p)
        plain = [p for p in todo if "\n" not in p]
        joined = list(runs(plain, JOINED_CHARS))
        coded = (ids for some in (joined[i:i + JOINED_AT_ONCE] for i in range(0, len(joined), JOINED_AT_ONCE))
                 for ids in self._encode([" " + "\n ".join(batch) for batch in some]))
        for batch, ids in zip(joined, coded):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == self.feed)
            starts, ends = np.append(0, at + 1).tolist(), np.append(at, len(ids)).tolist()
            if self.lengths_only:
                self.later.update(zip(batch, (e - s for s, e in zip(starts, ends))))
            else:
                raw, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                self.later.update(zip(batch, (raw[s * w:e * w] for s, e in zip(starts, ends))))
        for batch in runs([p for p in todo if "\n" in p], JOINED_CHARS * JOINED_AT_ONCE):
            for p, ids in zip(batch, self._encode([" " + p for p in batch])):
                self.later[p] = self._value(ids)

    def encode(self, texts: list[str | None]) -> list:
        """Per text: its number of tokens, or its ids as little-endian bytes."""
        if len(self.later) > CACHE_PARTS:
            self.older, self.later = self.later, {}
        split = [SAFE_CUT.split(t) if t else [] for t in texts]
        self._fill(set().union(*(p[1:] for p in split)))
        head = [p[0] for p in split if p]
        first = (self._value(ids) for batch in runs(head, JOINED_CHARS * JOINED_AT_ONCE) for ids in self._encode(batch))
        get, empty = self.later.__getitem__, 0 if self.lengths_only else b""
        total = sum if self.lengths_only else b"".join
        out = [next(first) + total(map(get, p[1:])) if p else empty for p in split]
        for k in [k for p in split for k in p if len(k) > CACHE_PART_CHARS]:   # long parts hardly repeat
            self.later.pop(k, None)
        return out


_ENCODERS: dict = {}


def encoder(blob: bytes, lengths_only: bool, width: int = 2) -> PartEncoder:
    """One encoder per worker process and use; workers are reused by tasks."""
    key = (len(blob), hash(blob), lengths_only, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(blob, lengths_only, width)
    return _ENCODERS[key]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Token counts of whole texts; one row per row of ``docs``.

    ``tokenizer`` is a ``tokenizers`` JSON file with a byte-level BPE.  Only
    lengths leave the Python workers.  Null and empty texts have no tokens; a
    null id stays null; other columns of ``docs`` are ignored.  Special
    strings in texts count as the library counts them by default.
    """
    blob = broadcast_file(docs.sparkSession, tokenizer)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value, lengths_only=True)
        for b in text_batches(batches, "text", batch_bytes):
            n = enc.encode(b.column("text").to_pylist())
            size = pc.fill_null(pc.binary_length(b.column("text")), 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), size.cast(pa.int64()), pa.array(n, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
