"""Phrase collocation mining over a weighted de Bruijn graph (13).

Nodes are stretches of three words, edges stretches of four, weighted by how
often they occur in the pieces of all texts of a language.  Only edges, and
what is left at the end of a piece, are counted; the count of a shorter
phrase is the flow through it: the weights of the edges that start with it,
plus the piece ends that start with it.

Phrases below ``min_count`` are never asked for, so pieces may also end at a
pair of words that is rarer.  Three passes over the texts follow from that:
words are counted, then pairs of frequent words by a 48-bit hash, then the
edges along frequent pairs.  What is frequent goes to the tasks as a bitmap of
a fixed size; a false hit only lets a rare edge through.  Every pass counts
inside the task first, so a frequent word or passage is one row a batch.

Edges that only lead on to one other edge of the same weight make unary paths
(a licence line is one); pointer doubling over the links compacts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, release, text_batches
from tessera.session import remove_path, scratch_path

BATCH_BYTES = 2 << 20
#: Bits of a bitmap of frequent words or pairs (8 MB at any size of the corpus).
FILTER_BITS = 1 << 26
#: Rows counted inside a task before they go to Spark.
COUNT_ROWS = 2 << 20
#: Edges of a unary path in one row; longer paths take several rows.
PATH_EDGES = 1024
SEED = 42
#: Bits of a pair's hash that are counted; pairs that share them only let rare edges through.
PAIR_HASH = np.uint64((1 << 48) - 1)
#: Odd 64-bit multipliers that mix the hashes of two words.
MIX_LEFT, MIX_RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: A-Z to a-z, a tab to a space, the marks that end a piece to a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class Words:
    """The words of a batch: ``code[i]`` in ``names``, its language, and the
    words from i to the end of its piece."""

    def __init__(self, batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        folded = (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b"").translate(_FOLD)
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(folded)])
        pieces = pc.split_pattern(texts, "\n")
        of_doc = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        parts = pc.ascii_split_whitespace(pieces.flatten())
        flat = parts.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        edges = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))]
        sizes = np.diff(edges)                                  # words per piece
        coded = flat.filter(pa.array(real)).dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.langs = langs.dictionary
        self.lang = np.repeat(np.repeat(langs.indices.to_numpy().astype(np.int64), of_doc), sizes)
        self.left = np.repeat(edges[1:], sizes) - np.arange(len(self.code))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Spark's ``xxhash64`` of the names and of the languages."""
        def digest(names):
            raw = names.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
            return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in raw), np.uint64, len(raw))
        return digest(self.names), digest(self.langs)

    def frequent(self, bits: np.ndarray, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return hit(bits, word[self.code] ^ lang[self.lang])

    def pairs(self, known: np.ndarray, word: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where two frequent words follow each other in a piece, and the hashes of the pairs."""
        at = np.flatnonzero(known[:-1] & known[1:] & (self.left[:-1] > 1)) if len(known) else np.empty(0, np.int64)
        a, b = word[self.code[at]], word[self.code[at + 1]]
        h = (a ^ (a >> np.uint64(29))) * MIX_LEFT + (b ^ (b >> np.uint64(31))) * MIX_RIGHT + lang[self.lang[at]]
        return at, (h ^ (h >> np.uint64(32))) & PAIR_HASH


def hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_bits(df: DataFrame, h: Column) -> Broadcast:
    """Bitmap of the low bits of the hashes ``h``: built in the tasks in parts
    of 4 KB, at most ``FILTER_BITS`` bits together, for all tasks."""
    part = 32768
    at = h.bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = (df.select((at / part).cast("int").alias("part"), (at % part).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits[r.part * part // 8:(r.part + 1) * part // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits.tobytes())


def _over_words(docs: DataFrame, schema: str, rows: Callable[[Words], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH_BYTES):
            if b.num_rows:
                yield rows(Words(b))
    return docs.mapInArrow(run, schema)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all single words."""
    def rows(w: Words) -> pa.RecordBatch:
        key, f = np.unique(w.lang * len(w.names) + w.code, return_counts=True)
        lang, code = np.divmod(key, max(len(w.names), 1))
        return pa.RecordBatch.from_arrays([w.langs.take(pa.array(lang)), w.names.take(pa.array(code)), pa.array(f, pa.int64())],
                                          names=["lang", "phrase", "f"])
    return (_over_words(texts, "lang string, phrase string, f long", rows)
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


def pair_counts(texts: DataFrame, words: Broadcast) -> DataFrame:
    """(h, f): how often the pairs of frequent words with the hash ``h`` occur."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(words.value, np.uint8)
        held, n = [], 0

        def counted():
            h, f = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f, pa.int64())], names=["h", "f"])

        for b in text_batches(batches, "text", BATCH_BYTES):
            w = Words(b)
            word, lang = w.hashes()
            held.append(w.pairs(w.frequent(bits, word, lang), word, lang)[1])
            n += len(held[-1])
            if n > COUNT_ROWS:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def edge_counts(texts: DataFrame, words: Broadcast, pairs: Broadcast) -> DataFrame:
    """(lang, phrase, n_words, weight): stretches of four words along frequent
    pairs, and shorter ones where no frequent pair goes on."""
    def rows(w: Words) -> pa.RecordBatch:
        word, lang = w.hashes()
        at, h = w.pairs(w.frequent(np.frombuffer(words.value, np.uint8), word, lang), word, lang)
        at = at[hit(np.frombuffer(pairs.value, np.uint8), h)]
        on = np.zeros(len(w.code) + 3, bool)                    # a frequent pair starts here
        on[at] = True
        code = np.append(w.code, [0, 0, 0])
        third, fourth = on[at + 1], on[at + 1] & on[at + 2]
        n = max(len(w.names), 1)
        head = (w.lang[at] * n + code[at]) * n + code[at + 1]
        tail = np.where(third, code[at + 2] + 1, 0) * (n + 1) + np.where(fourth, code[at + 3] + 1, 0)
        by = np.lexsort([tail, head])
        head, tail = head[by], tail[by]
        first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))) if len(head) else by
        weight = np.diff(np.append(first, len(head)))
        head, tail = head[first], tail[first]
        c, d = np.divmod(tail, n + 1)
        columns = [w.names.take(pa.array(head // n % n)), w.names.take(pa.array(head % n))]
        columns += [w.names.take(pa.array(x - 1, mask=x == 0)) for x in (c, d)]
        return pa.RecordBatch.from_arrays(
            [w.langs.take(pa.array(head // n // n)), pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="skip"),
             pa.array(2 + (c > 0) + (d > 0), pa.int32()), pa.array(weight, pa.int64())], names=["lang", "phrase", "n_words", "weight"])

    return (_over_words(texts, "lang string, phrase string, n_words int, weight long", rows)
            .groupBy("lang", "phrase", "n_words").agg(F.sum("weight").alias("weight")))


def _node(words: Column, at: int) -> Column:
    return F.array_join(F.slice(words, at, 3), " ")


def _steps(links: DataFrame) -> DataFrame:
    """For each edge with an edge before it: the farthest edge back along the
    links (``back``), the steps to it (``d``) and the least edge passed
    (``low``).  Each round doubles the steps.  Only edges of a cycle are still
    ``open`` after more steps than there are links."""
    jump = links.select("lang", "phrase", F.col("prev").alias("back"), F.lit(1).cast("bigint").alias("d"),
                        F.least("phrase", "prev").alias("low"), F.lit(True).alias("open"))
    jump = cut(jump)
    rounds = max(jump.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if jump.where("open").isEmpty():
            break
        on = jump.select("lang", F.col("phrase").alias("back"), F.col("back").alias("to"), F.col("d").alias("more"), F.col("low").alias("lower"))
        jump = cut(jump.join(on, ["lang", "back"], "left").select(
            "lang", "phrase", F.coalesce("to", "back").alias("back"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"),
            F.least("low", "lower").alias("low"), F.col("to").isNotNull().alias("open")))
    return jump


def unary_paths(edges: DataFrame) -> DataFrame:
    """Edges (lang, phrase of four words, weight) compacted into paths:
    (lang, head, part, path, n_edges, weight).

    Two edges join where the node between them has no other edge and both
    have one weight; ``path`` has the words of ``n_edges`` overlapping edges.
    A path of more than ``PATH_EDGES`` edges takes several rows (``part``).  A
    cycle starts at its least edge.  Every edge is in exactly one path.
    """
    words = F.split("phrase", " ")
    edges = edges.select("lang", "phrase", "weight", _node(words, 1).alias("src"), _node(words, 2).alias("dst"))
    out = edges.groupBy("lang", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("weight").alias("w_out"), F.min("phrase").alias("phrase"))
    into = edges.groupBy("lang", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.max("weight").alias("w_in"), F.min("phrase").alias("prev"))
    links = (out.where("n_out = 1").join(into.where("n_in = 1"), ["lang", "node"])
             .where("w_out = w_in and phrase != prev").select("lang", "phrase", "prev"))
    links = cut(links)
    steps = _steps(links)
    cycles = steps.where("open")
    if not cycles.isEmpty():
        opened = links.join(cycles.where("phrase != low").select("lang", "phrase"), ["lang", "phrase"], "left_semi")
        steps = steps.where("not open").unionByName(_steps(opened))
    placed = edges.join(steps.select("lang", "phrase", "back", "d"), ["lang", "phrase"], "left").select(
        "lang", F.coalesce("back", "phrase").alias("head"), F.coalesce("d", F.lit(0)).alias("d"), "phrase", "weight")
    run = F.sort_array(F.collect_list(F.struct("d", "phrase")))
    return (placed.groupBy("lang", "head", F.expr(f"cast(d div {PATH_EDGES} as int)").alias("part"))
            .agg(run.alias("run"), F.count("*").alias("n_edges"), F.min("weight").alias("weight"))
            .select("lang", "head", "part", F.array_join(F.concat(
                F.array(F.col("run")[0]["phrase"]),
                F.transform(F.slice("run", 2, F.size("run")), lambda r: F.substring_index(r["phrase"], " ", -1))), " ").alias("path"),
                "n_edges", "weight"))


def phrase_counts(edges: DataFrame, paths: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f, n_words) of all phrases of two to four words that
    occur ``min_count`` times: flows out of the nodes of compacted paths, of
    the lighter edges, and of piece ends."""
    w = F.split("path", " ")
    starts = paths.select("lang", "weight", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_edges").cast("int"))).alias("at"))
    heavy = starts.select("lang", F.col("weight").alias("f"), F.explode(F.array(*[
        F.struct(F.array_join(F.slice("w", F.col("at"), k), " ").alias("phrase"), F.lit(k).alias("n_words")) for k in (2, 3, 4)])).alias("g"))
    light = (edges.where((F.col("n_words") < 4) | (F.col("weight") < min_count))
             .select("lang", F.col("weight").alias("f"), F.explode(F.filter(F.array(*[
                 F.struct(F.substring_index("phrase", " ", k).alias("phrase"), F.lit(k).alias("n_words"), F.col("n_words").alias("all")) for k in (2, 3)]),
                 lambda g: g["n_words"] <= g["all"])).alias("g")))
    flows = heavy.select("lang", "f", "g.phrase", "g.n_words").unionByName(light.select("lang", "f", "g.phrase", "g.n_words"))
    return flows.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def scored(counts: DataFrame, singles: DataFrame, covered_percent: int) -> DataFrame:
    """Candidates with the cut of the lowest score, without those that a
    longer candidate covers.  A phrase inside a longer candidate is also
    inside one that has one word more and occurs at least as often, so one
    word more on either side is all that is looked at."""
    f = counts.select("lang", "phrase", "f").unionByName(singles.select("lang", "phrase", "f"))
    parts = counts.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k")) \
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    parts = (parts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
             .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr("cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)")
    lowest = (parts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
              .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    inner = (counts.where("n_words > 2").select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring_index(phrase, ' ', 1 - n_words)"))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    keep = F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < covered_percent * F.col("a").cast("decimal(20,0)"))
    return lowest.join(inner, ["lang", "phrase"], "left").where(keep).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30,
                 covered_percent: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line
    ends, pieces into words at spaces and tabs.  A phrase of two to four words
    that occurs ``a >= min_count`` times within pieces is cut into a first
    part (``l`` occurrences) and a rest (``r``) where
    ``floor(2000000 * a / (l + r))`` is lowest (ties: the shorter first part).
    Phrases inside a longer one with ``covered_percent`` of their occurrences
    go.  ``n`` counts all words of the language.

    Null and empty texts have no words; a null language counts as ``und``;
    repeated rows count each time; other columns are ignored; an empty table
    gives no rows.  ``min_count`` below 2 is not supported.  Scratch tables
    are removed; the result (``top`` rows a language) is a written table.
    """
    if min_count < 2:
        raise ValueError("min_count must be 2 or more")
    spark = docs.sparkSession
    used = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, f"phrases-{name}")
        schema = df.schema
        df.write.parquet(at)
        used.append(at)
        del df                                                  # its shuffle files may go
        release(spark)
        return spark.read.schema(schema).parquet(at)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = kept(word_counts(texts), "words")
    singles = words.where(F.col("f") >= min_count)
    word_bits = filter_bits(singles, F.xxhash64("phrase").bitwiseXOR(F.xxhash64("lang")))
    pair_bits = filter_bits(pair_counts(texts, word_bits).where(F.col("f") >= min_count), F.col("h"))
    release(spark)
    edges = kept(edge_counts(texts, word_bits, pair_bits), "edges")
    paths = kept(unary_paths(edges.where((F.col("n_words") == 4) & (F.col("weight") >= min_count))), "paths")
    counts = kept(phrase_counts(edges, paths, min_count), "counts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts, singles, covered_percent).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    best = best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    at = scratch_path(spark, "phrases")
    best.write.parquet(at)
    for path in used:
        remove_path(spark, path)
    word_bits.destroy()
    pair_bits.destroy()
    return spark.read.schema(best.schema).parquet(at)
