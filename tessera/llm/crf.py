"""Language ID by a linear-chain conditional random field over words (5).

Every word of a text is labelled with a language.  A label's score for a word
comes from affixes and byte n-grams (hashed features with learned weights)
and from a lexicon (how often each language's training documents hold the
word, counted over all of them); learned transitions join neighbours.
Forward-backward gives each word its label probabilities, so a text may
switch language; a document's language is the one with the largest sum.

Weights are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` per
language); lexicon and predictions cover everything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.common import fresh, text_batches

#: Labelled rows per language that the weights are fitted on, by hash order of their ids.
SAMPLE_ROWS = 100
FEATURES = 1 << 18
LEXICON = 1 << 17
GRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3, 4)
CHUNK = 64
BATCH_BYTES = 2 << 20
EPOCHS, RATE, DECAY = 25, 0.3, 1e-4
#: Words of a made-up code-switched sequence, and of a stretch of one language in it.
SEQUENCE, STRETCH = 64, 12
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # features by languages
    lexicon: np.ndarray      # lexicon buckets by languages, log odds
    scale: np.ndarray        # of the lexicon, by language
    bias: np.ndarray
    transitions: np.ndarray  # from, to


class Words:
    """The words of a batch of texts: unique ones and where each stands."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = S.utf8(column)
        starts, ends, self.row = S.word_spans(raw, self.offsets)
        hashes = S.word_hashes(raw, starts, ends)
        self.hashes, at, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.low, self.starts, self.ends = S._LOWER[raw], starts[at], ends[at]
        self.n_rows = len(self.offsets) - 1

    def lettered(self) -> np.ndarray:
        """Which unique words hold a letter (any byte beyond ASCII counts)."""
        letter = np.concatenate([[0], np.cumsum(((self.low >= 97) & (self.low <= 122)) | (self.low >= 128))])
        return letter[self.ends] > letter[self.starts]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed affixes and n-grams of the unique words: (word, feature)."""
        size = self.ends - self.starts
        padded = size + 2
        first = np.cumsum(padded) - padded
        text = np.empty(int(padded.sum()), np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(first + 1, size) + inner] = self.low[np.repeat(self.starts, size) + inner]
        text[first], text[first + padded - 1] = 1, 2          # word borders
        word, feature = [], []
        t = text.astype(S.U)
        owner = np.repeat(np.arange(len(size)), padded)
        for n in GRAMS:
            if len(t) < n:
                continue
            h = np.zeros(len(t) - n + 1, S.U)
            for k in range(n):
                h = h * S.U(257) + t[k:len(t) - n + 1 + k]
            inside = np.flatnonzero(owner[:len(h)] == owner[n - 1:])
            word.append(owner[inside])
            feature.append(S.mix(h[inside] + S.U(n << 40)) % S.U(FEATURES))
        for n in AFFIXES:
            some = np.flatnonzero(size >= n)
            for side, begin in ((0, first[some] + 1), (1, first[some] + 1 + size[some] - n)):
                h = np.zeros(len(some), S.U)
                for k in range(n):
                    h = h * S.U(257) + t[begin + k]
                word.append(some)
                feature.append(S.mix(h + S.U((8 + 2 * n + side) << 40)) % S.U(FEATURES))
        return np.concatenate(word), np.concatenate(feature).astype(np.int64)

    def buckets(self) -> np.ndarray:
        return (S.mix(self.hashes) % S.U(LEXICON)).astype(np.int64)


def mean_weights(weights: np.ndarray, word: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(word, minlength=n), 1)
    return np.stack([np.bincount(word, weights[feature, k], n) for k in range(weights.shape[1])], 1) / count[:, None]


def emissions(m: Model, words: Words) -> np.ndarray:
    """Label scores of the unique words; words without a letter say nothing."""
    if not len(words.hashes):
        return np.zeros((0, len(m.langs)))
    e = mean_weights(m.weights, *words.features(), len(words.hashes)) + m.lexicon[words.buckets()] * m.scale + m.bias
    return np.where(words.lettered()[:, None], e, 0.0)


def forward_backward(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of all words of sequences that stand one behind
    the other.  Sequences are cut into chunks that run in step: first each
    chunk's transfer matrix, then the messages at chunk borders, then the
    words inside.  Exact; steps do not grow with the longest sequence alone."""
    n, k = e.shape
    if not n:
        return np.zeros((0, k))
    p = np.exp(e - e.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    per = -(-lengths // CHUNK)
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + nth * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, per) - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    back_to = np.empty(len(order), np.int64)
    back_to[order] = np.arange(len(order))          # chunk number -> place in order
    steps = [int(np.searchsorted(-size, -s, side="left")) for s in range(int(size[0]))]

    alpha, beta = np.full((len(order), k), 1.0 / k), np.full((len(order), k), 1.0 / k)
    if per.max() > 1:
        m = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        for s, c in enumerate(steps):
            x = (m[:c].reshape(-1, k) @ t).reshape(c, k, k) * p[start[:c] + s][:, None, :]
            m[:c] = x / x.sum((1, 2), keepdims=True)
        first = np.cumsum(per) - per
        for j in range(1, int(per.max())):
            some = np.flatnonzero(per > j)
            a, b = back_to[first[some] + j - 1], back_to[first[some] + j]
            x = np.einsum("ni,nij->nj", alpha[a], m[a])
            alpha[b] = x / x.sum(1, keepdims=True)
        for j in range(int(per.max()) - 1, 0, -1):
            some = np.flatnonzero(per > j)
            a, b = back_to[first[some] + j - 1], back_to[first[some] + j]
            x = np.einsum("nij,nj->ni", m[b], beta[b])
            beta[a] = x / x.sum(1, keepdims=True)
    out = np.empty((n, k))
    for s, c in enumerate(steps):
        x = (alpha[:c] @ t) * p[start[:c] + s]
        alpha[:c] = out[start[:c] + s] = x / x.sum(1, keepdims=True)
    for s in range(len(steps) - 1, -1, -1):
        c = steps[s]
        at = start[:c] + s
        x = out[at] * beta[:c]
        out[at] = x / x.sum(1, keepdims=True)
        y = (p[at] * beta[:c]) @ t.T
        beta[:c] = y / y.sum(1, keepdims=True)
    return out


# --- learning -----------------------------------------------------------------

def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()) \
               .select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))


def count_lexicon(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Words by lexicon bucket and language, over all training rows.  Tasks
    send one row per bucket and language they met; the table has a fixed size."""
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEXICON * len(langs), np.int64)
        for b in text_batches(batches, "text", BATCH_BYTES):
            w = Words(b.column("text"))
            lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            total += np.bincount(w.buckets()[w.which] * len(langs) + lang[w.row], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "n"])

    table = np.zeros(LEXICON * len(langs), np.int64)
    sums = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = sums.toArrow()          # at most LEXICON * languages rows
    table[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(LEXICON, len(langs))


def log_odds(counts: np.ndarray) -> np.ndarray:
    share = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
    seen = counts.sum(1, keepdims=True) > 0
    return np.where(seen, np.clip(share - share.mean(1, keepdims=True), -4, 4), 0.0).astype(np.float32)


def sample(rows: DataFrame, langs: list[str], per_lang: int) -> list:
    """At most ``per_lang`` training rows a language, the first in hash order."""
    best = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("id", "lang").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_lang)
    chosen = [r.id for r in ids.select("id").collect()]        # per_lang * languages at most
    return rows.filter(F.col("id").isin(chosen)).dropDuplicates(["id"]).orderBy("id").collect()


def switched(rows: list, langs: list[str], which: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences that switch language: the words of all rows, dealt in
    stretches of random length.  Returns word positions, labels, lengths."""
    r = np.random.Generator(np.random.PCG64(7))
    lang = np.array([langs.index(x.lang) for x in rows])
    pieces = []
    for i in range(len(rows)):
        at = np.flatnonzero(row_of == i)
        while len(at):
            n = int(r.integers(1, 2 * STRETCH))
            pieces.append((at[:n], lang[i]))
            at = at[n:]
    words, labels = [], []
    for i in r.permutation(len(pieces)):
        words.append(pieces[i][0])
        labels.append(np.full(len(pieces[i][0]), pieces[i][1]))
    words, labels = np.concatenate(words), np.concatenate(labels)
    lengths = np.full(-(-len(words) // SEQUENCE), SEQUENCE)
    lengths[-1] = len(words) - SEQUENCE * (len(lengths) - 1)
    return words, labels, lengths


def fit(rows: list, langs: list[str], lexicon: np.ndarray) -> Model:
    """Maximum likelihood by Adam on the sampled rows, all at once."""
    k = len(langs)
    m = Model(langs, np.zeros((FEATURES, k), np.float64), lexicon, np.full(k, 0.5), np.zeros(k), np.zeros((k, k)))
    words = Words(pa.array([r.text for r in rows], pa.string()))
    if not len(words.which) or k < 2:
        return m
    at, labels, lengths = switched(rows, langs, words.which, words.row)
    u = words.which[at]
    word, feature = words.features()
    used, feature = np.unique(feature, return_inverse=True)
    n = len(words.hashes)
    share = 1.0 / np.maximum(np.bincount(word, minlength=n), 1)
    letters, lex = words.lettered()[:, None], lexicon[words.buckets()].astype(np.float64)
    params = {"w": np.zeros((len(used), k)), "scale": m.scale, "bias": m.bias, "t": m.transitions}
    moment = {x: (np.zeros_like(v), np.zeros_like(v)) for x, v in params.items()}
    inside = np.ones(len(u), bool)
    inside[np.cumsum(lengths) - 1] = False
    pairs = np.flatnonzero(inside)
    for epoch in range(1, EPOCHS + 1):
        e_u = mean_weights(params["w"], word, feature, n) + lex * params["scale"] + params["bias"]
        e = np.where(letters, e_u, 0.0)[u]
        p = forward_backward(e, lengths, params["t"])
        error = p.copy()
        error[np.arange(len(u)), labels] -= 1
        by_word = np.where(letters, np.stack([np.bincount(u, error[:, j], n) for j in range(k)], 1), 0.0)
        spread = by_word * share[:, None]
        grad = {"w": np.stack([np.bincount(feature, spread[word, j], len(used)) for j in range(k)], 1),
                "scale": (by_word * lex).sum(0), "bias": by_word.sum(0)}
        # expected less seen transitions; a pair's joint chance from its ends' marginals and messages
        grad["t"] = pair_counts(e, p, lengths, params["t"], pairs) - np.bincount(
            labels[pairs] * k + labels[pairs + 1], minlength=k * k).reshape(k, k)
        for x, v in params.items():
            g = grad[x] / len(u) + DECAY * v / max(1, len(used))
            a, b = moment[x]
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.99 * b + 0.01 * g * g
            v -= RATE * (a / (1 - 0.9 ** epoch)) / (np.sqrt(b / (1 - 0.99 ** epoch)) + 1e-8)
    m.weights = np.zeros((FEATURES, k), np.float32)
    m.weights[used] = params["w"]
    return m


def pair_counts(e, p, lengths, transitions, pairs) -> np.ndarray:
    """Expected number of each transition.  P(i, j) at a pair is proportional
    to f(i) t(i, j) g(j); f follows from the forward pass, g from the marginal."""
    k = e.shape[1]
    t = np.exp(transitions - transitions.max())
    pot = np.exp(e - e.max(1, keepdims=True))
    f = np.empty_like(pot)
    starts = np.cumsum(lengths) - lengths
    for s in range(int(lengths.max())):
        at = starts[lengths > s] + s
        x = (f[at - 1] if s else np.full((len(at), k), 1.0 / k)) @ t * pot[at]
        f[at] = x / x.sum(1, keepdims=True)
    into = f[pairs] @ t                                    # chance of j before its own evidence
    back = p[pairs + 1] / np.maximum(into, 1e-300)         # the rest of what makes the marginal
    joint = f[pairs][:, :, None] * t[None] * back[:, None, :]
    return joint.sum(0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from the rows whose crc32(id as text) mod 4 is not 2 and whose
    language is known; None where there are none."""
    rows = training_rows(docs, id_col, text_col, lang_col)
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    return fit(sample(rows, langs, sample_rows), langs, log_odds(count_lexicon(rows, langs)))


# --- prediction ---------------------------------------------------------------

def label_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``lang_pred``, ``score`` (its share of all label
    probability), and ``runs``: (first word, words, lang) of each stretch of
    words with the same most likely language.

    Null texts, and texts without a letter, are ``und`` with score 0 and no
    runs.  Only the text is read.  Equal scores: the first language by name."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                         F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    if model is None:
        return narrow.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                             F.expr("CAST(array() AS array<struct<first: long, n: long, lang: string>>)").alias("runs"))
    sent = docs.sparkSession.sparkContext.broadcast(model)      # a fixed size per language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("id"), *judge(sent.value, b.column("text"), b.column("known"))],
                                             names=["id", "lang_pred", "score", "runs"])

    out = narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double, runs array<struct<first: long, n: long, lang: string>>")
    return out.withColumnRenamed("id", id_col)


def judge(m: Model, texts: pa.Array, known: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and runs of each text; ``known`` tells those with a letter."""
    langs = np.array(m.langs, dtype=object)
    w = Words(texts)
    lengths = np.bincount(w.row, minlength=w.n_rows)
    p = forward_backward(emissions(m, w)[w.which], lengths[lengths > 0], m.transitions)
    weight = w.lettered()[w.which].astype(float)
    sums = np.stack([np.bincount(w.row, p[:, j] * weight, w.n_rows) for j in range(len(langs))], 1)
    known = np.array(known.to_pylist(), bool) & (sums.sum(1) > 0)
    share = sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)
    best = np.round(share, 9).argmax(1)
    pred = np.where(known, langs[best], UNKNOWN)
    score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
    # stretches of one label
    top = p.argmax(1)
    new = np.ones(len(top), bool)
    new[1:] = (top[1:] != top[:-1]) | (w.row[1:] != w.row[:-1])
    at = np.flatnonzero(new & known[w.row]) if len(top) else np.zeros(0, np.int64)
    breaks = np.append(np.flatnonzero(new), len(top))
    size = breaks[np.searchsorted(breaks, at, side="right")] - at if len(at) else at
    first = at - (np.cumsum(lengths) - lengths)[w.row[at]]
    per = np.concatenate([[0], np.cumsum(np.bincount(w.row[at], minlength=w.n_rows))])
    runs = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(langs[top[at]].tolist(), pa.string())],
        names=["first", "n", "lang"]))
    return pa.array(pred.tolist(), pa.string()), pa.array(score), runs


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``label_documents`` with a model learned from ``docs``, and ``held_out``."""
    model = train(docs, id_col, text_col, lang_col, sample_rows)
    return label_documents(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all columns.  Only
    ``und`` goes: null texts and those without a letter.  Each row is judged
    by its own text, so evenly mixed texts, repeated ids and null ids stay.
    Without any labelled row nothing can be told and all rows go."""
    model = train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name, = fresh(docs, "_known")
    known = docs.withColumn(name, F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, text_col, BATCH_BYTES):
            pred, _, _ = judge(sent.value, b.column(text_col), b.column(name))
            yield b.drop_columns([name]).filter(pc.not_equal(pred, UNKNOWN))

    return known.mapInArrow(run, docs.schema)
