"""Adaptive context-mixing range coder for token ids (the file format of 1).

Ids are cut into blocks of up to ``BLOCK`` ids.  Each block is coded on its own:
models start anew, so a block decodes without any other, and its ids carry a
checksum.  Per id the coder asks up to three predictors:

- order 2: the id that last followed the two ids before, with a confidence;
- order 1: the id that last followed the id before, with a confidence;
- order 0: adaptive distributions over the four hexadecimal digits of an id,
  each in the context of the digits before it.

The chance that the order-2 (or, failing it, the order-1) prediction holds is
mixed from two adaptive estimates, one by the confidence of either order,
with a weight that moves towards the estimate that did better.  An id that
neither predicts is coded digit by digit from order 0.  All arithmetic is on
integers, so any machine decodes what another has coded.

The blocks of a frame run in step: one numpy operation advances all of them
by one id, which keeps the per-id cost of Python small.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
MAGIC = b"TIDS"
VERSION = 1
BLOCK = 4096          # ids of a block at most; small frames take smaller blocks, down to
LEAST_BLOCK = 512
LANES = 512           # so that about so many blocks run in step
HEADER = struct.Struct("<4sHHIII")   # magic, version, block ids, ids, blocks, unused
ENTRY = struct.Struct("<III")        # per block: ids, payload words of 16 bits, crc32 of the ids

U = np.uint64
TOP, LOW = U(1 << 48), U(1 << 32)
MASK = U((1 << 32) - 1)
S1, S15, S16, S48 = U(1), U(15), U(16), U(48)
SLOTS = 2048          # contexts of orders 1 and 2, per block
LAST = 512            # hashed contexts of the last digit, per block
DIGITS = 1 + 16 + 256 + LAST
TOTAL = 1 << 15       # of a digit's distribution
RATE = 4
MAX_CONF = 15

_START = (np.arange(16) * (TOTAL // 16)).astype(np.int16)
#: Towards what a digit's cumulative distribution moves: nearly all mass on the digit seen.
_GOAL = np.array([[i * 32 if i <= s else TOTAL - (16 - i) * 32 for i in range(16)] for s in range(16)], np.int16)


class _Coder:
    """``n`` range coders and their models, run in step.  ``ids`` are coded
    where given; otherwise ``data`` (16-bit words by block) is decoded."""

    def __init__(self, n: int, steps: int, ids: np.ndarray | None, data: np.ndarray | None = None):
        self.encoding = data is None
        self.ids = ids if self.encoding else np.zeros((steps, n), np.uint16)
        self.low, self.rng, self.code = np.zeros(n, U), np.full(n, ~U(0)), np.zeros(n, U)
        self.data = np.zeros((n, 5 * steps + 16), np.uint16) if self.encoding else data
        self.width = self.data.shape[1]
        self.flat = self.data.reshape(-1)
        self.used = np.arange(n) * self.width
        if not self.encoding:
            for k in range(4):
                self.code = self.code << S16 | data[:, k].astype(U)
            self.used += 4
        self.rows = np.arange(n)
        self.guess = [np.zeros(n * SLOTS, np.uint16) for _ in range(2)]   # by order 1 and 2
        self.conf = [np.zeros(n * SLOTS, np.uint8) for _ in range(2)]
        self.digits = np.tile(_START, (n * DIGITS, 1))
        #: Chances of a hit, by flag: one by order 1's confidence and agreement, one by order 2's.
        self.p = [[np.full(n * 32, 1 << 15, np.int32) for _ in range(2)] for _ in range(2)]
        self.w = [np.full(n, 1 << 15, np.int32) for _ in range(2)]

    def shift(self, rows, low, rng):
        """Settled words leave (or enter); ``low`` and ``rng`` belong to ``rows``."""
        todo = None
        while True:
            lo, rg = (low, rng) if todo is None else (low[todo], rng[todo])
            done = (lo ^ (lo + rg)) < TOP
            tight = rg < LOW
            if tight.any():
                tight &= ~done
                rg = np.where(tight, (~lo + S1) & MASK, rg)
                done |= tight
            hit = np.flatnonzero(done)
            if not len(hit):
                return
            todo = hit if todo is None else todo[hit]
            at, lo = rows[todo], lo[hit]
            pos = self.used[at]
            if self.encoding:
                self.flat[pos] = lo >> S48
            else:
                self.code[at] = self.code[at] << S16 | self.flat[pos].astype(U)
            self.used[at] = pos + 1
            low[todo] = lo << S16
            rng[todo] = rg[hit] << S16

    def flag(self, which, rows, a, b, low, rng, hit):
        """Code (or find out) whether a prediction holds; learns from it."""
        pa_all, pb_all = self.p[which]
        pa, pb = pa_all[a], pb_all[b]
        w = self.w[which][rows]
        p = (w * (pa >> 1) + (65536 - w) * (pb >> 1)) >> 15
        np.maximum(p, 64, out=p)
        np.minimum(p, 65472, out=p)
        bound = (rng >> S16) * p.astype(U)
        if not self.encoding:
            hit = self.code[rows] - low < bound
        low += np.where(hit, U(0), bound)
        rng[:] = np.where(hit, bound, rng - bound)
        goal = np.where(hit, 65535, 0).astype(np.int32)
        da, db = goal - pa, goal - pb
        pa_all[a] = pa + (da >> 4)
        pb_all[b] = pb + (db >> 4)
        w += (np.abs(db) - np.abs(da)) >> 8
        np.maximum(w, 2048, out=w)
        self.w[which][rows] = np.minimum(w, 63488)
        return hit

    def escape(self, rows, ids):
        """Code (or read) ids that no prediction gave, digit by digit."""
        low, rng, k16 = self.low[rows], self.rng[rows], np.arange(len(rows)) * 16
        base, v = rows * DIGITS, ids.astype(np.int64) if self.encoding else np.zeros(len(rows), np.int64)
        got = np.zeros(len(rows), np.int64)
        for level, first in enumerate((0, 1, 17, 273)):
            at = base + first + (got if level < 3 else got * 181 >> 3 & (LAST - 1))
            cdf = self.digits.take(at, axis=0)
            if level == 2:     # two digits use up to 22 bits of the 32 or more that are left
                self.shift(rows, low, rng)
            r = rng >> S15
            if self.encoding:
                s = v >> (12 - 4 * level) & 15
            else:
                q = np.minimum((self.code[rows] - low) // r, U(TOTAL - 1)).astype(np.int16)
                s = (cdf <= q[:, None]).sum(1) - 1
            flat = cdf.reshape(-1)
            start = flat.take(k16 + s).astype(np.int64)
            end = np.where(s < 15, flat.take(np.minimum(k16 + s + 1, len(flat) - 1)).astype(np.int64), TOTAL)
            low += r * start.astype(U)
            rng = r * (end - start).astype(U)
            self.digits[at] = cdf + ((_GOAL.take(s, axis=0) - cdf) >> RATE)
            got = got * 16 + s
        self.shift(rows, low, rng)
        self.low[rows], self.rng[rows] = low, rng
        return got

    def remember(self, order, slot, g, c, x):
        same = g == x
        self.conf[order][slot] = np.where(same, np.minimum(c + 1, MAX_CONF), c >> 1)
        self.guess[order][slot] = np.where(c < 2, x, g)

    def run(self, running: np.ndarray) -> None:
        """``running[t]``: how many blocks (the first ones) have an id ``t``."""
        n = len(self.rows)
        last = before = np.zeros(n, np.int64)
        for t, m in enumerate(running.tolist()):
            rows, x, low, rng = self.rows[:m], self.ids[t, :m], self.low[:m], self.rng[:m]
            last, before, base = last[:m], before[:m], rows * SLOTS
            s1 = base + ((last * 40503 >> 5) & (SLOTS - 1))
            s2 = base + ((last * 31153 + before * 48271 >> 4) & (SLOTS - 1))
            g1, g2, c1, c2 = self.guess[0][s1], self.guess[1][s2], self.conf[0][s1], self.conf[1][s2]
            differ = g1 != g2
            a, b = rows * 32 + c1 * 2 + differ, rows * 32 + c2
            hit = self.flag(0, rows, a, b, low, rng, x == g2 if self.encoding else None)
            miss = np.flatnonzero(~hit)
            ask = miss[differ[miss]]
            if not self.encoding:
                x[:] = g2
            lo, rg = low[ask], rng[ask]
            hit1 = self.flag(1, ask, a[ask], b[ask], lo, rg, x[ask] == g1[ask] if self.encoding else None)
            low[ask], rng[ask] = lo, rg
            if not self.encoding:
                x[ask] = g1[ask]
            held = hit.copy()
            held[ask] = hit1
            miss = np.flatnonzero(~held)
            self.shift(rows, low, rng)
            if len(miss):
                x[miss] = self.escape(miss, x[miss])
            self.remember(0, s1, g1, c1, x)
            self.remember(1, s2, g2, c2, x)
            last, before = x.astype(np.int64), last

    def flush(self) -> None:
        for _ in range(4):
            self.flat[self.used] = self.low >> S48
            self.used += 1
            self.low <<= S16


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Blocks by falling size, the number of steps, and how many run at each."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, steps, np.searchsorted(-sizes[order], -np.arange(steps), side="left")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of 16-bit ids."""
    order, steps, running = _lanes(np.array([len(b) for b in blocks], np.int64))
    ids = np.zeros((steps, len(blocks)), np.uint16)
    for k, i in enumerate(order):
        ids[:len(blocks[i]), k] = blocks[i]
    c = _Coder(len(blocks), steps, ids)
    c.run(running)
    c.flush()
    coded = [b""] * len(blocks)
    for k, i in enumerate(order):
        coded[i] = c.flat[k * c.width:c.used[k]].astype("<u2").tobytes()
    return coded


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    order, steps, running = _lanes(np.array(lengths, np.int64))
    data = np.zeros((len(payloads), max(map(len, payloads), default=0) // 2 + 8), np.uint16)
    for k, i in enumerate(order):
        data[k, :len(payloads[i]) // 2] = np.frombuffer(payloads[i], "<u2")
    c = _Coder(len(payloads), steps, None, data)
    c.run(running)
    out: list = [None] * len(payloads)
    for k, i in enumerate(order):
        out[i] = c.ids[:lengths[i], k].copy()
    return out


def pack(ids: np.ndarray) -> bytes:
    """One frame: header, block directory, payloads."""
    size = min(BLOCK, max(LEAST_BLOCK, len(ids) // LANES))
    blocks = [ids[i:i + size] for i in range(0, len(ids), size)]
    coded = encode_blocks(blocks) if blocks else []
    head = HEADER.pack(MAGIC, VERSION, size, len(ids), len(blocks), 0)
    entries = b"".join(ENTRY.pack(len(b), len(c) // 2, zlib.crc32(b.astype("<u4").tobytes()))
                       for b, c in zip(blocks, coded))
    return head + entries + b"".join(coded)


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises on a wrong header or checksum."""
    magic, version, _, total, n, _ = HEADER.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token frame of this version")
    entries = [ENTRY.unpack_from(frame, HEADER.size + ENTRY.size * i) for i in range(n)]
    at, payloads = HEADER.size + ENTRY.size * n, []
    for _, size, _ in entries:
        payloads.append(frame[at:at + 2 * size])
        at += 2 * size
    blocks = decode_blocks(payloads, [e[0] for e in entries]) if n else []
    for k, (b, e) in enumerate(zip(blocks, entries)):
        if zlib.crc32(b.astype("<u4").tobytes()) != e[2]:
            raise ValueError(f"checksum of block {k} differs")
    out = np.concatenate(blocks) if blocks else np.zeros(0, np.uint16)
    if len(out) != total:
        raise ValueError("length of the frame differs")
    return out
