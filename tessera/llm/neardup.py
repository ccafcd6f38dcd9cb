"""MinHash near-duplicates (10).

1. Each document gives the minima of ``HASHES`` universal hashes of its
   shingle set, and a 128-bit digest of the set.  Documents with equal sets
   collapse to the one with the smallest id, by partial aggregation, so a
   huge group of copies never meets in one task.
2. Band keys put the rest into buckets.  A bucket links its members to two
   pivots: the member that shares most buckets with others, and the smallest
   id.  Pairs whose signatures agree well enough are confirmed on full sets.
3. Components by alternating large-star and small-star.
4. Buckets that still hold different components are compared in blocks of
   bounded size, whatever their number: an inverted index gives the exact
   overlap of every pair, and only links that join two components leave a
   block.  The components are then taken again.  A pair is thus only skipped
   where both ends are connected already, which no component depends on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.common import cut, fresh, stored, text_batches

HASHES = 125
#: Bands are cut so that a pair at the threshold misses all of them less often than this.
MISS = 1e-6
#: Equal minima that a pair at the threshold falls short of once in 100 million: six deviations.
SLACK = 6
WIDTH = 5
#: A block of an open bucket: so many rows, and so many shingles together, at most in the mean.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
#: Postings walked at a time.
SLICE = 1 << 18
#: Bytes of text hashed at a time: each takes about a hundred bytes of arrays.
BATCH_BYTES = 1 << 19
CHUNK = 1 << 15

_MASK = (1 << 63) - 1


def layout(percent: int) -> tuple[int, int]:
    """(bands, minima a band) for a threshold: the longest bands that keep to
    ``MISS``.  25 of 5 at 85 percent, 31 of 4 at 80."""
    for rows in range(HASHES, 0, -1):
        bands = HASHES // rows
        if (1 - (percent / 100) ** rows) ** bands < MISS:
            return bands, rows
    return HASHES, 1


def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of the hash family, the same everywhere."""
    r = np.random.Generator(np.random.PCG64(20240229))
    a = r.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the shingles of each row: rows by
    functions, 32 bits.  Rows without shingles are left at zero."""
    a, b = _universal()
    n = len(begin) - 1
    out = np.zeros((n, HASHES), np.uint32)
    rows = np.flatnonzero(np.diff(begin))
    at = 0
    while at < len(rows):     # runs of rows that fit the processor's cache
        to = int(np.searchsorted(begin[rows], begin[rows[at]] + CHUNK, side="right"))
        to = max(to, at + 1)
        some = rows[at:to]
        part, cuts = h[begin[some[0]]:begin[some[-1] + 1]], begin[some] - begin[some[0]]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((part * a[k] + b[k]) >> S.U(32), cuts)
        at = to
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 63-bit key per document and band; the band is part of the key."""
    factors = S.mix(np.arange(1, rows + 1, dtype=S.U) * S.U(7919)) | S.U(1)
    parts = (sig[:, :bands * rows].reshape(len(sig), bands, rows).astype(S.U) * factors).sum(2, dtype=S.U)
    return (S.mix(parts + S.mix(np.arange(bands, dtype=S.U) + S.U(1))) & S.U(_MASK)).astype(np.int64)


def _distinct(h: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        yield np.unique(h[s:e])


def _features(bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH_BYTES):
            h, begin = S.shingles(b.column("text"), WIDTH)
            sig = minima(h, begin)
            sets = list(_distinct(h, begin))
            size = [len(x) for x in sets]
            k1 = [int(x.sum(dtype=S.U)) & _MASK for x in sets]
            k2 = [int(S.mix(x + S.U(0x1234567)).sum(dtype=S.U)) & _MASK for x in sets]
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sig, bands, rows).reshape(-1)), bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 keys.cast(pa.list_(pa.int64())), pa.array([r.tobytes() for r in sig.astype("<u2")], pa.binary())],
                names=["id", "n", "k1", "k2", "keys", "sig"])
    return run


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row: id, set size, set digest (k1, k2), band keys, signature (16 bits a minimum)."""
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                .mapInArrow(_features(*layout(percent)), "id long, n long, k1 long, k2 long, keys array<long>, sig binary"))


def _close(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            ok = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])
    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches, "text", BATCH_BYTES):
        h, begin = S.shingles(b.column("text"), WIDTH)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([x.tobytes() for x in _distinct(h, begin)], pa.binary())], names=["id", "members"])


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), S.U), np.frombuffer(y.as_buffer(), S.U)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])
    return run


def _links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold: signatures first, then full shingle sets."""
    mean = HASHES * percent / 100
    least = int(mean - SLACK * (mean * (1 - percent / 100)) ** 0.5)
    near = (pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
                 .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b"))
    near = near.select("a", "b", "sig_a", "sig_b").mapInArrow(_close(least), "a long, b long")
    both = (near.join(sets.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b"))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as links (a, b), for
    nodes with a link to another; component is its smallest node.

    Large-star joins each node's larger neighbours to the smallest node near
    it, small-star its smaller ones; both alternate until nothing changes.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = (both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .filter("u <> v").distinct())
        large = cut(large)
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))     # here u > v in every row
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def spanning_links(ids, component, left, right, sets, percent: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` rows that join rows not connected
    yet.  The rows' shingles form an inverted index, so each row's exact
    overlap with all others takes one pass over its postings."""
    n = len(ids)
    size = np.array([len(x) for x in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    by_term = np.argsort(term, kind="stable")
    posting = owner[by_term]
    ends = np.cumsum(np.bincount(term))
    begin = np.cumsum(size) - size
    root: dict = {}

    def find(c):
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    out = []
    group = np.array([find(c) for c in component])
    for r in np.flatnonzero(left):
        if not (right & (group != group[r])).any():
            continue
        mine = term[begin[r]:begin[r] + size[r]]
        first, last = ends[mine - 1] * (mine > 0), ends[mine]
        width = last - first
        total = np.cumsum(width)
        both, at = np.zeros(n, np.int64), 0
        while at < len(mine):                                   # a bounded number of postings at a time
            to = max(at + 1, int(np.searchsorted(total, total[at] - width[at] + SLICE, side="right")))
            some = width[at:to]
            place = np.arange(int(some.sum())) + np.repeat(first[at:to] - np.cumsum(some) + some, some)
            both += np.bincount(posting[place], minlength=n)
            at = to
        linked = right & (group != group[r]) & (100 * both >= percent * (size + size[r] - both))
        for c in np.flatnonzero(linked):
            x, y = find(component[r]), find(component[c])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[r], ids[c]), max(ids[r], ids[c])))
        if linked.any():
            group = np.array([find(c) for c in component])
    return out


def _cross_links(percent: int):
    """``spanning_links`` of each run of rows with equal (key, i, j)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def flush() -> list:
            if len(rows) < 2:
                return []
            (_, i, j), blk = held, np.array([r[2] for r in rows])
            return spanning_links([r[0] for r in rows], [r[1] for r in rows], blk == i, blk == j, [r[3] for r in rows], percent)

        for b in batches:
            out = []
            names = ("key", "i", "j", "id", "component", "blk")
            for k, (key, i, j, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in names))):
                if held != (key, i, j):
                    out += flush()
                    held, rows = (key, i, j), []
                rows.append((*row, np.frombuffer(b.column("members")[k].as_py(), S.U)))
            yield _pair_batch(set(out))
        yield _pair_batch(set(flush()))
    return run


def _pair_batch(out: set) -> pa.RecordBatch:
    out = sorted(out)
    return pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in out], pa.int64()),
                                       pa.array([int(p[1]) for p in out], pa.int64())], names=["a", "b"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, bool]:
    """``docs`` with a column (its name is returned) that tells rows of
    different texts apart: the id, or a number from 2^62 on for rows that
    share their id or have none.  Also whether there are such rows."""
    name, other = fresh(docs, "_key", "_again")
    ident = F.col(id_col).cast("long")
    again = stored(docs.select(ident.alias(other)).groupBy(other).agg(F.count("*").alias("n"))
                       .filter(f"n > 1 OR {other} IS NULL").select(other), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn(name, ident), name, False
    number = F.xxhash64(ident, F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    again = again.select(other, F.lit(True).alias(name))
    out = docs.join(again, ident.eqNullSafe(F.col(other)), "left")
    return out.withColumn(name, F.when(F.col(name), number).otherwise(ident)).drop(other), name, True


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are lower-cased (A-Z) and cut into words; a document's set is its
    distinct 5-word shingles, or its whole sequence where it has fewer words.
    Two documents are linked where 100 * intersection >= ``percent`` * union.
    Null, empty and blank texts have no set and are linked with nothing.  The
    smallest id of a component stays.  Other columns are ignored.

    Rows that share an id, or have none, are documents of their own, each
    judged by its own text; rows equal in id and text count as one.  Of rows
    with the smallest id of a component one text stays; a component without
    any id has a null ``component_id``, and one of its texts stays.
    """
    rows, key, again = keyed(docs, id_col, text_col)
    if not again:
        return _near_duplicates(docs, id_col, text_col, percent)
    return _by_key(rows, key, id_col, text_col, percent).drop("_key")


def _by_key(rows: DataFrame, key: str, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``near_duplicates`` where ids repeat: the graph is that of the keys, and
    each component is named by its smallest id.  Also returns ``_key``."""
    narrow = stored(rows.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"),
                                F.col(text_col).cast("string").alias("text")), "keyed")
    found = _near_duplicates(narrow, "key", "text", percent).select("key", "n_shingles", F.col("component_id").alias("c")).distinct()
    placed = stored(narrow.select("id", "key").join(found, "key"), "by-key")
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("order"), "key", "id")
    heads = placed.groupBy("c").agg(F.min(order).alias("low")).select("c", "low.id", F.col("low.key").alias("stays"))
    return placed.join(heads.withColumnRenamed("id", "component_id"), "c").select(
        F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("key") == F.col("stays")).alias("kept"), F.col("key").alias("_key"))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``near_duplicates`` of rows with an id that differ by it."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    f = stored(features(docs, id_col, text_col, percent), "minhash")
    classes = stored(f.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "set-classes")
    reps = stored(f.join(classes.select("n", "k1", "k2", F.col("rep").alias("id")), ["id", "n", "k1", "k2"], "left_semi")
                      .dropDuplicates(["id", "k1", "k2"]).select("id", "n", "keys", "sig"), "set-reps")
    rows = reps.select("id", "n", F.explode("keys").alias("key"))

    buckets = stored(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
                         .filter("low < high"), "buckets")
    members = stored(rows.join(buckets.select("key", "size", "low").hint("merge"), "key"), "bucket-members")
    central = stored(members.groupBy("id").agg(F.sum("size").alias("shared")), "bucket-shares")
    middle = stored(members.join(central, "id").groupBy("key")
                           .agg(F.max(F.struct("shared", (-F.col("id")).alias("neg"))).alias("m"))
                           .select("key", (-F.col("m.neg")).alias("mid")), "bucket-middles")
    pairs = members.join(middle, "key").select("id", F.explode(F.array("low", "mid")).alias("to")).filter("id <> `to`")
    pairs = pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    # a merge join at any size: what is shuffled follows the input
    inside = members.select("id").distinct().hint("merge")
    sets = stored(texts.join(inside, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets, "id long, members binary"),
                  "shingle-sets")
    links = stored(_links(pairs, reps, sets, percent), "links")
    comp = components(links)

    # members that are not connected yet, within each bucket
    placed = members.join(comp, F.col("id") == F.col("node"), "left") \
                    .select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "placed")
    open_keys = stored(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                                 F.count("*").alias("rows"), F.sum("n").alias("shingles"))
                             .filter("x < y").select("key", "rows", "shingles"), "open-buckets")
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    spread = (placed.join(open_keys, "key").withColumn("nb", blocks)
                    .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
                    .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
                    .select("key", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "blk", "id", "component"))
    spread = spread.join(sets, "id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = (spread.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
                  .mapInArrow(_cross_links(percent), "a long, b long").distinct())
    found = stored(more, "open-links")
    if not found.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))

    grouped = classes.join(comp, F.col("rep") == F.col("node"), "left") \
                     .select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    grouped = stored(grouped, "class-components")
    out = f.select("id", "n", "k1", "k2").join(grouped, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all columns.

    Rows equal in id and text stay or go together."""
    rows, key, again = keyed(docs, id_col, text_col)
    if again:
        judged = _by_key(rows, key, id_col, text_col, percent).select(F.col("_key").alias("key"), "kept")
    else:
        judged = _near_duplicates(docs, id_col, text_col, percent).select(F.col(id_col).alias("key"), "kept")
    name, = fresh(rows, "_gone")
    gone = judged.filter("NOT kept").select(F.col("key").alias(name)).distinct()
    return rows.join(gone, F.col(key) == F.col(name), "left_anti").select(*docs.columns)
