"""Periodic run detection (11).

A run is a maximal stretch of words that repeats itself with a smallest
period q.  Its rightmost square (two copies of q words) is *branching*: the
word after the second copy differs from the one after the first.  Both copies
start in one LCP interval of depth q of the suffix array, in two of its child
intervals, so the copy in the smaller child finds the other one with a look
into the inverse suffix array.  Rotating the square to the left as far as the
words agree gives the run; squares of a multiple of the period give the same
stretch and are merged into it.

No tree is built.  A batch of whole documents is one array of word codes, and
each step is a numpy pass over it: prefix doubling keeps the ranks of all
stretches of 1, 2, 4, ... words, from which common prefixes, and rotations to
the left, follow by binary lifting; intervals come from the nearest smaller
values on both sides of an LCP entry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_batches, words

BATCH_BYTES = 1 << 20
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _leaders(fresh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place, ``at`` of the last place marked in ``fresh``."""
    return np.maximum.accumulate(np.where(fresh, at, 0))


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and, per k, the rank of the 2^k codes that start at each
    place.  Every document must end with a code of its own, so equal ranks
    never reach over the end of one.  The last ranks are all different."""
    n = len(codes)
    every = np.arange(n)
    order = np.argsort(codes, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = _leaders(fresh, every)
    ranks, step = [rank], 1
    while not fresh.all():
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))     # in groups of two and more
        at = order[open_]
        key = rank[at].astype(np.int64) * n + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        order[open_], fresh[open_] = at, first
        rank = rank.copy()
        rank[at] = _leaders(first, open_)
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Codes that the suffixes at ``order[j - 1]`` and ``order[j]`` share."""
    out = np.zeros(len(order), np.int64)
    j = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[j - 1].copy(), order[j].copy()
    start = a.copy()
    for k in range(len(ranks) - 2, -1, -1):
        step = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
        a += step
        b += step
    out[j] = a - start
    return out


def nearest_smaller(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest places left and right with a smaller value.
    ``v[0]`` must be the least value; the right one of the last may be ``len(v)``."""
    n = len(v)
    least = [np.append(v, -1)]                                            # least[k][i]: of v[i : i + 2^k]
    zeros = np.flatnonzero(v == v[0])
    longest = int(np.diff(np.append(zeros, n)).max())
    while (1 << len(least)) <= longest:
        low, half = least[-1], 1 << (len(least) - 1)
        up = np.full(n + 1, -1, low.dtype)
        up[:max(n + 1 - half, 0)] = np.minimum(low[:n + 1 - half], low[half:])
        least.append(up)
    right = np.arange(1, n + 1)
    left = np.arange(n) - 1
    for k in range(len(least) - 1, -1, -1):
        right += (least[k][right] >= v).astype(np.int64) << k
        begin = left - (1 << k) + 1
        left -= ((begin >= 0) & (least[k][np.maximum(begin, 0)] >= v)).astype(np.int64) << k
    return left, right


def branching_squares(codes: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], room: np.ndarray,
                      copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of branching squares whose root occurs ``copies`` times
    or more.  ``room[i]`` is the greatest period looked for at place i."""
    none = np.empty(0, np.int64)
    lcp = common_prefixes(order, ranks)
    keep = np.flatnonzero((lcp > 0) | (np.append(lcp[1:], 0) > 0))        # each stretch of entries, and the 0 before it
    if not len(keep):
        return none, none
    depth = lcp[keep]
    left, right = nearest_smaller(depth)
    j = np.flatnonzero((depth > 0) & (right - left >= copies) & (depth <= room[order[keep]]))
    if not len(j):
        return none, none
    lo, hi = keep[left[j]], keep[right[j] - 1] + 1                        # suffixes order[lo:hi] share depth codes
    by = np.argsort(lo * (len(codes) + 1) + hi, kind="stable")
    lo, hi, cut, depth = lo[by], hi[by], keep[j[by]], depth[j[by]]
    # children of an interval: from lo to its first entry of that depth, between entries, from the last one to hi
    first = np.ones(len(lo), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(first) - 1
    begin = np.concatenate([lo[first], cut])
    child_group = np.concatenate([np.arange(group[-1] + 1), group])
    by = np.lexsort([begin, child_group])
    begin, child_group = begin[by], child_group[by]
    lo, hi, depth = lo[first][child_group], hi[first][child_group], depth[first][child_group]
    end = np.append(begin[1:], 0)
    last = np.append(child_group[1:] != child_group[:-1], True)
    end[last] = hi[last]
    size = end - begin
    # all children but a largest one
    by = np.lexsort([-size, child_group])
    largest = by[np.append(True, child_group[by][1:] != child_group[by][:-1])]
    small = np.ones(len(size), bool)
    small[largest] = False
    lo, hi, depth, begin, size = lo[small], hi[small], depth[small], begin[small], size[small]
    own = np.repeat(np.arange(len(size)), size)
    at = order[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + begin[own]]
    lo, hi, depth = lo[own], hi[own], depth[own]
    place = ranks[-1]                                                     # the inverse suffix array

    def inside(other):
        return (place[other] >= lo) & (place[other] < hi)

    ahead = inside(at + depth)
    ahead &= codes[at + depth] != codes[np.where(ahead, at + 2 * depth, 0)]
    before = at - depth
    behind = (before >= 0) & inside(np.maximum(before, 0))
    behind &= codes[at] != codes[at + depth]
    return np.concatenate([at[ahead], before[behind]]), np.concatenate([depth[ahead], depth[behind]])


def runs_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int,
            min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.  Document d
    has the codes ``starts[d]`` to ``ends[d]`` and, there, a code of its own."""
    order, ranks = suffix_ranks(codes)
    room = np.zeros(len(codes), np.int64)
    sizes = ends - starts
    room[:] = np.repeat(sizes // min_exponent, sizes + 1)
    at, period = branching_squares(codes, order, ranks, room, min_exponent)
    end = at + 2 * period
    for k in range(len(ranks) - 2, -1, -1):                               # rotate to the left
        prior = at - (1 << k)
        same = (prior >= 0) & (ranks[k][prior] == ranks[k][prior + period])
        at = np.where(same, prior, at)
    length = end - at
    good = length >= np.maximum(min_length, min_exponent * period)
    at, length, period = at[good], length[good], period[good]
    by = np.lexsort([period, length, at])
    at, length, period = at[by], length[by], period[by]
    least = np.ones(len(at), bool)                                        # multiples of a period give the same stretch
    least[1:] = (at[1:] != at[:-1]) | (length[1:] != length[:-1])
    at, length, period = at[least], length[least], period[least]
    by = np.lexsort([period, at])
    return at[by], length[by], period[by]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and the words per text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    edges = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
    sums = np.append(0, np.cumsum(real))
    return flat.filter(pa.array(real)), np.diff(sums[edges])


def _batch_runs(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    flat, sizes = split_words(texts)
    n, docs = len(flat), len(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    coded = flat.dictionary_encode()
    codes = np.empty(n + docs, np.int64)
    inner = np.ones(n + docs, bool)
    inner[ends] = False
    doc = np.repeat(np.arange(docs), sizes)
    codes[inner] = doc * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
    codes[ends] = np.arange(docs) * (len(coded.dictionary) + 1) + len(coded.dictionary)
    at, length, period = runs_of(codes, starts, ends, min_length, min_exponent)
    own = np.searchsorted(starts, at, side="right") - 1
    # words after the first period of any run go
    change = np.zeros(n + docs + 1, np.int64)
    np.add.at(change, at + period, 1)
    np.add.at(change, at + length, -1)
    kept = (np.cumsum(change)[:-1] == 0)[inner]
    edges = np.append(0, np.cumsum(np.bincount(doc[kept], minlength=docs)))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat.filter(pa.array(kept))), " ")
    rows = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (at - starts[own], length, period)], fields=list(_RUN))
    edges = np.append(0, np.cumsum(np.bincount(own, minlength=docs)))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows), collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  min_exponent: int = 4, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Runs of whole texts and the texts without them; one row per row of ``docs``.

    Returns ``id_col``, ``runs`` (array of start, length and period in words,
    by start and period: all stretches that repeat with a smallest period q,
    that no neighbouring word extends, of ``max(min_length, min_exponent * q)``
    words or more) and ``collapsed`` (the words joined by one space, without
    those that a run holds after its first q words).  A run of fewer than
    ``min_exponent`` copies is never looked for: roots that occur less often
    in their document are left out before the test.

    Null, empty and blank texts have no run and collapse to an empty string.
    A null id stays null; repeated rows are treated one by one; other columns
    are ignored.  Documents are never cut: memory follows the batch (or one
    longer document), about 250 bytes a word.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be 2 or more, min_length 1 or more")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", batch_bytes):
            if b.num_rows:
                found, collapsed = _batch_runs(b.column("text"), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([b.column("id"), found, collapsed], names=["id", "runs", "collapsed"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(find, f"id {kind}, runs {RUN_TYPE}, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (then the smallest
    start, then period); null where there is none."""
    def better(a, r):
        left, right = r["length"].cast("decimal(19,0)") * a["period"], a["length"].cast("decimal(19,0)") * r["period"]
        return F.when(a["period"].isNull() | (left > right), r).otherwise(a)   # runs come by start and period
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by the checksum of its id) made
    periodic from some word on; the rest of the texts is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    a, p, n = F.col("g") % F.col("n"), 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)), F.size("w").cast("bigint")
    turned = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return (docs.select("doc_id", "text", F.when(h % 10 == 0, words("text")).alias("w"), F.floor(h / 10).cast("bigint").alias("g"))
            .withColumn("n", F.when(n > 0, n)).withColumn("a", a).withColumn("p", p)
            .select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(turned, " ")).alias("text")))
