"""Pattern extraction and the pattern store (tokenise -> explode -> count).

Row model
---------
``occurrences(doc_id, position, resolution, pattern, next)``
    one row per (window of ``resolution`` tokens -> following token); the
    pattern key is the space-joined token window (tokens never hold spaces).
``continuations(pattern, resolution, next, cnt)``
    counts per (pattern, next) -- the normalised long form of the store.
``store(pattern, resolution, cnt, n_next, top_next, top_cnt)``
    one row per pattern.

Scale notes: all counting is a hash aggregate with a map-side partial
aggregate, so a hot key ("the" may be a third of all rows) is absorbed
before the shuffle; distributions divide by totals that come from a second
small aggregate joined back (AQE splits skewed join partitions), never from a
window that would pull a whole hot group into one task.

Whole stores are counted in *parts* (``dealt_patterns``): single tokens by the
aggregate above, longer patterns from one shuffled row per position that all
resolutions share.  Rows for a few contexts are counted from the occurrences
that end like one of them (``asked_occurrences``).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions import text as T
from tessera.session import release, scratch_path

#: Bytes of (Parquet) input behind one task that counts windows.
DEAL_BYTES = 1 << 20
#: Bytes of input behind one portion of the patterns, and the most portions.
PORTION_BYTES = 128 << 20
PORTIONS = 4

#: Tokens whose ids ``encode`` sends to all tasks, and the most characters of one.
COMMON_TOKENS = 1 << 17
COMMON_LENGTH = 64
#: Bytes of (Parquet) input behind one task that encodes documents.
ENCODE_BYTES = 8 << 20


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give a small input enough tasks.

    Tables that make at least ``defaultParallelism`` file splits are returned
    untouched -- no shuffle of the raw text.  Smaller ones are a few splits
    at most, so hashing them on ``key`` across the cores is cheap and lets
    tokenisation and the explode run in parallel.  The size comes from the
    statistics of the scans below; no job runs, and rows do not depend on it.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if input_bytes(df) >= want * split else df.repartition(want, key)


def input_bytes(df: DataFrame) -> int:
    """Size of the scans below, from their statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def deal_tasks(df: DataFrame, bytes_each: int | None = None) -> int:
    """Tasks that share the windows of ``df``: one per ``DEAL_BYTES`` (or
    ``bytes_each``) of input, and at least one per core.  A table that is no file (its size is not
    known) takes the session's number of shuffle partitions."""
    spark = df.sparkSession
    size = input_bytes(df)
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // (bytes_each or DEAL_BYTES)))


def token_split(c, lowercase: bool = True):
    """Tokens in one regex pass: EOT -> space, (lower), collapse, trim, split.

    Blank text gives ``['']``; callers filter with ``has_two_tokens``.
    """
    x = F.replace(F.col(c) if isinstance(c, str) else c, F.lit(T.EOT), F.lit(" "))
    if lowercase:
        x = F.lower(x)
    return F.split(F.trim(F.regexp_replace(x, f"{T.WS}+", " ")), " ")


def has_two_tokens(c) -> Column:
    """C8 on the raw text (a cheap early-exit regex find), so the filter does
    not re-evaluate the tokeniser when Catalyst pushes it below the projection."""
    x = F.replace(F.col(c) if isinstance(c, str) else c, F.lit(T.EOT), F.lit(" "))
    nws = r"[^\t\n\x0B\f\r ]"
    return x.rlike(f"{nws}{T.WS}+{nws}")


def tokenize_docs(docs: DataFrame, cfg: Config = DEFAULT, text_col: str = "text",
                  keep: tuple = (), balance: bool = True) -> DataFrame:
    """B1 + B5/B6 + C8: ``(doc_id, tokens)`` for documents with >= 2 tokens."""
    d = spread(docs) if balance else docs
    if cfg.tokenizer == "ws":
        d = d.filter(has_two_tokens(text_col))
        return d.select("doc_id", *keep, token_split(text_col, cfg.lowercase).alias("tokens"))
    toks = T.tokens(T.normalize(text_col), cfg.tokenizer, cfg.lowercase)
    return d.select("doc_id", *keep, toks.alias("tokens")).filter(F.size("tokens") >= 2)


def extract_patterns(docs_tok: DataFrame, resolutions=(1, 2, 3, 5, 8), stride: int = 1,
                     keep: tuple = ()) -> DataFrame:
    """Multi-resolution (window -> next token) rows.

    For every r and every start i with i % stride == 0 and i + r < n:
    pattern = tokens[i:i+r], next = tokens[i+r].  One ``posexplode`` per
    document and one ``inline`` of |resolutions| structs per position; all
    expressions are codegen'd built-ins.
    """
    x = docs_tok.select("doc_id", *keep, "tokens",
                        F.posexplode("tokens").alias("position", "_tok"))
    if stride > 1:
        x = x.filter(F.col("position") % stride == 0)
    pos = F.col("position")
    structs = []
    for r in sorted({int(r) for r in resolutions}):
        pat = F.col("_tok") if r == 1 else F.array_join(F.slice("tokens", pos + 1, F.lit(r)), " ")
        structs.append(F.struct(F.lit(r).alias("resolution"), pat.alias("pattern"),
                                F.get("tokens", pos + r).alias("next")))
    return (x.select("doc_id", *keep, "position", F.inline(F.array(*structs)))
             .filter(F.col("next").isNotNull()))


def ngrams(docs_tok: DataFrame, ns=(1, 2, 3), keep: tuple = ()) -> DataFrame:
    """N-gram rows ``(doc_id, n, position, gram)`` without continuation."""
    x = docs_tok.select("doc_id", *keep, "tokens", F.posexplode("tokens").alias("position", "_tok"))
    pos = F.col("position")
    structs = [F.struct(F.lit(n).alias("n"),
                        F.when(pos + n <= F.size("tokens"),
                               F.col("_tok") if n == 1 else
                               F.array_join(F.slice("tokens", pos + 1, F.lit(n)), " ")).alias("gram"))
               for n in ns]
    return (x.select("doc_id", *keep, "position", F.inline(F.array(*structs)))
             .filter(F.col("gram").isNotNull()))


def patterns_from_docs(docs: DataFrame, cfg: Config = DEFAULT, keep: tuple = ()) -> DataFrame:
    return extract_patterns(tokenize_docs(docs, cfg, keep=keep), cfg.resolutions,
                            cfg.pattern_stride, keep=keep)


def dealt_patterns(docs_tok: DataFrame, resolutions=(1, 2, 3, 5, 8), stride: int = 1,
                   keep: tuple = (), tasks: int | None = None, least: int = 1, portion: tuple | None = None) -> list[DataFrame]:
    """D1 in parts that share no pattern, with a column ``head``: the rows of
    ``extract_patterns``, dealt so that counting shuffles little.

    All windows that start at one position share their first two tokens.  One
    row per position (these two, and the tokens after them) is shuffled by the
    two, and the patterns of all resolutions are made from it on the other
    side: grouping or joining patterns of two tokens and more by (head,
    pattern, ...) needs no further shuffle.  The head of a single token is the
    token; its rows are dealt by it and its continuation (``deal``), so its
    continuations are counted without a shuffle, and only they are shuffled.

    ``portion`` (i, n) are the patterns whose first token's hash is i of n.

    From ``least`` 2 on, patterns that occur once, which are most of the long
    ones, need not be made: rows are sorted behind the shuffle, where equal
    beginnings lie side by side, and a window is made only of a beginning that
    a neighbour shares.  Those that occur twice are all there, some others too."""
    rs = sorted({int(r) for r in resolutions})
    short, long = [r for r in rs if r < 2], [r for r in rs if r >= 2]
    # joins by (head, pattern) take tables dealt by head as they are
    docs_tok.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    x = docs_tok.select("doc_id", *keep, "tokens", F.posexplode("tokens").alias("position", "_tok"))
    pos = F.col("position")
    x = x.filter(pos + (1 if short else 2) < F.size("tokens"))
    if stride > 1:
        x = x.filter(pos % stride == 0)
    if portion:
        x = x.filter(F.pmod(F.xxhash64("_tok"), F.lit(portion[1])) == portion[0])
    x = x.select("doc_id", *keep, "position", F.concat_ws(" ", "_tok", F.get("tokens", pos + 1)).alias("deal"),
                 F.array_join(F.slice("tokens", pos + 3, F.lit(rs[-1] - 1 if long else 0)), " ").alias("_rest"))
    x = x.repartition(tasks or deal_tasks(docs_tok), "deal")
    parts = []
    if short:
        # reads _rest (never null), so that both parts take one and the same shuffle
        tok = F.coalesce(F.when(F.length("_rest") >= 0, F.substring_index("deal", " ", 1)), F.lit(""))
        parts.append(x.select("doc_id", *keep, "position", "deal", tok.alias("head"), F.lit(1).alias("resolution"),
                              tok.alias("pattern"), F.substring_index("deal", " ", -1).alias("next")))
    if long:
        # not a filter: one below the shuffle would make it another than that of single tokens
        rest = F.when(F.col("_rest") != "", F.split("_rest", " "))
        y, shared = x, {}
        if least > 1:
            w = Window.partitionBy("deal").orderBy("_key")
            y = x.withColumn("_key", F.concat("_rest", F.lit(" "))).withColumns(
                {"_before": F.lag("_key").over(w), "_after": F.lead("_key").over(w)})
            for r in long:
                start = F.concat(F.substring_index("_rest", " ", r - 2), F.lit(" ")) if r > 2 else F.lit("")
                shared[r] = F.coalesce(F.startswith("_before", start), F.lit(False)) | F.coalesce(F.startswith("_after", start), F.lit(False))
        y = y.select("doc_id", *keep, "position", F.col("deal").alias("head"), rest.alias("_rest"),
                     *[on.alias(f"_s{r}") for r, on in shared.items()])
        structs = []
        for r in long:
            pat = F.col("head") if r == 2 else F.concat_ws(" ", "head", F.slice("_rest", 1, r - 2))
            after = F.get("_rest", F.lit(r - 2))
            structs.append(F.struct(F.lit(r).alias("resolution"), pat.alias("pattern"),
                                    (F.when(F.col(f"_s{r}"), after) if shared else after).alias("next")))
        parts.append(y.select("doc_id", *keep, "position", "head", F.inline(F.array(*structs)))
                      .filter(F.col("next").isNotNull()))
    return parts


def parts_from_docs(docs: DataFrame, cfg: Config = DEFAULT, keep: tuple = (),
                    tasks: int | None = None, least: int = 1, portion: tuple | None = None) -> list[DataFrame]:
    return dealt_patterns(tokenize_docs(docs, cfg, keep=keep), cfg.resolutions, cfg.pattern_stride, keep,
                          tasks or deal_tasks(docs), least, portion)


def portions(docs: DataFrame, most: int | None = None) -> int:
    """Portions in which the patterns of ``docs`` are counted."""
    size = input_bytes(docs)
    return 1 if size >= 1 << 60 else min(most or PORTIONS, max(1, -(-size // PORTION_BYTES)))


def by_portion(docs: DataFrame, work) -> DataFrame:
    """The rows of ``work(tasks, (i, n))`` for each of the ``n`` portions of the
    patterns of ``docs``.  With more than one, each one's rows are written to
    the shared checkpoint folder, and its shuffle files go before the next begins."""
    spark, n = docs.sparkSession, portions(docs)
    if n == 1:
        return work(deal_tasks(docs), None)
    tasks = max(spark.sparkContext.defaultParallelism, -(-deal_tasks(docs) // n))
    paths = []
    for i in range(n):
        paths.append(scratch_path(spark, "patterns"))
        work(tasks, (i, n)).write.option("compression", "zstd").parquet(paths[-1])
        release(spark)
    return spark.read.parquet(*paths)


def in_portions(docs: DataFrame, work, cfg: Config = DEFAULT, keep: tuple = (), least: int = 1,
                more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``work`` (parts -> rows by pattern) over the patterns of ``docs``, on
    large tables portion by portion (``by_portion``): all patterns with the same
    first token are in one.  For work whose rows are far fewer than the
    patterns, or sorted; every portion tokenises the documents again, so
    there are at most ``PORTIONS``.  The patterns of ``more`` tables, dealt
    alike, are further arguments of ``work``."""
    return by_portion(docs, lambda tasks, portion: work(*[
        parts_from_docs(d, cfg, keep, tasks, least, portion) for d in (docs, *more)]))


def asked_occurrences(docs_tok: DataFrame, asked: DataFrame, resolutions=(1, 2, 3, 5, 8),
                      stride: int = 1) -> DataFrame:
    """D1 for the patterns of ``asked`` (``pattern``; the caller has counted
    that they fit a broadcast): only positions whose token ends one of them
    make windows, and only those patterns leave the scan.

    Windows that end at one position are made from the shortest to the longest,
    and none once one of them ends no asked pattern.  The endings are as many
    rows as the patterns where each comes with its own shorter endings, as the
    suffixes of contexts do; at most one more per resolution otherwise."""
    rs = sorted({int(r) for r in resolutions})
    levels = sorted({1, *rs})
    ends = F.array_distinct(F.array(*[F.substring_index("pattern", " ", -r) for r in levels], "pattern"))
    known = (asked.select("pattern").distinct().select("pattern", F.explode(ends).alias("_tail"))
                  .groupBy("_tail").agg(F.max(F.col("_tail") == F.col("pattern")).alias("_asked")))
    x = docs_tok.select("doc_id", "tokens", F.posexplode("tokens").alias("_end", "_w1"))
    end = F.col("_end")
    x = x.filter(end + 1 < F.size("tokens"))
    for shorter, r in zip([None, *levels], levels):
        if shorter:
            start = end - (r - 1)
            window = F.array_join(F.slice("tokens", start + 1, F.lit(r)), " ")
            x = x.withColumn(f"_w{r}", F.when(F.col(f"_a{shorter}").isNotNull() & (start >= 0), window))
        table = known.select(F.col("_tail").alias(f"_w{r}"), F.col("_asked").alias(f"_a{r}"))
        x = x.join(F.broadcast(table), f"_w{r}", "left" if shorter else "inner")
    structs = []
    for r in rs:
        start = end - (r - 1)
        on = F.col(f"_a{r}") & (start % stride == 0) if stride > 1 else F.col(f"_a{r}")
        structs.append(F.struct(start.alias("position"), F.lit(r).alias("resolution"), F.when(on, F.col(f"_w{r}")).alias("pattern")))
    x = x.select("doc_id", F.get("tokens", end + 1).alias("next"), F.inline(F.array(*structs)))
    return x.filter(F.col("pattern").isNotNull()).select("doc_id", "position", "resolution", "pattern", "next")


def count_parts(parts: list[DataFrame], count=None) -> list[DataFrame]:
    """F1 (long form; or another ``count`` by pattern and continuation) of
    each part, with ``head``."""
    count = count or continuation_counts
    return [count(p, tuple(c for c in ("deal", "head") if c in p.columns)).drop("deal") for p in parts]


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, without ``head``."""
    parts = [p.drop("head", "deal") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_columns(*frames: DataFrame) -> list[str]:
    """What joins a pattern: (head, pattern) where all sides are dealt by head."""
    return ["head", "pattern"] if all("head" in f.columns for f in frames) else ["pattern"]


def dealt_side(df: DataFrame) -> DataFrame:
    """A side of a join by ``key_columns``: tables dealt by head are merged
    where they are.  Statistics of the scan say nothing of the number of
    patterns, so they must not choose a broadcast."""
    return df.hint("merge") if "head" in df.columns else df


# ---------------------------------------------------------------- counting


def continuation_counts(occ: DataFrame, keys: tuple = ()) -> DataFrame:
    """F1 (long form): ``(pattern, resolution, next, cnt)``."""
    return (occ.groupBy(*keys, "pattern", "resolution", "next")
               .agg(F.count(F.lit(1)).alias("cnt")))


def build_store(cont: DataFrame, min_frequency: int = 1, keys: tuple = ()) -> DataFrame:
    """F1 + F8 + C3: one row per pattern, HAVING cnt >= min_frequency.

    ``top_next`` is the mode continuation, ties to the smallest token
    (``min_by`` over (-cnt, next) -- a partial aggregate, skew-safe).
    """
    store = (cont.groupBy(*keys, "pattern", "resolution")
                 .agg(F.sum("cnt").alias("cnt"),
                      F.count(F.lit(1)).alias("n_next"),
                      F.min_by("next", F.struct(-F.col("cnt"), F.col("next"))).alias("top_next"),
                      F.max("cnt").alias("top_cnt")))
    if min_frequency > 1:
        store = store.filter(F.col("cnt") >= min_frequency)
    return store


def pattern_store(docs: DataFrame, cfg: Config = DEFAULT, keys: tuple = ()) -> DataFrame:
    return build_store(continuation_counts(patterns_from_docs(docs, cfg, keep=keys), keys),
                       cfg.min_pattern_frequency, keys)


def continuation_map(cont: DataFrame) -> DataFrame:
    """Presentation form of the store: ``MAP<next, cnt>`` per pattern (bounded
    by the number of distinct continuations of a pattern; joins use the long form)."""
    return (cont.groupBy("pattern", "resolution")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("next", "cnt"))))
                     .alias("continuations")))


def distribution(cont: DataFrame, store: DataFrame | None = None, keys: tuple = ()) -> DataFrame:
    """``prob = cnt / total`` per pattern (only patterns present in ``store``).

    Totals come from the store (already one row per pattern); the join keeps
    a hot pattern streaming through one side with a single matching row.
    """
    if store is None:
        store = build_store(cont, 1, keys)
    tot = dealt_side(store.select(*keys, "pattern", F.col("cnt").alias("_total")))
    return (cont.join(tot, [*keys, "pattern"], "inner")
                .select(*keys, "pattern", "resolution", "next", "cnt",
                        (F.col("cnt") / F.col("_total")).alias("prob")))


def frequent_occurrences(occ: DataFrame, store: DataFrame) -> DataFrame:
    """Occurrences whose pattern survived the frequency filter (semi join)."""
    on = key_columns(occ, store)
    if "head" in on:         # a semi join would be pushed below the counts, onto every occurrence
        return occ.join(dealt_side(store.select(*on).distinct()), on)
    return occ.join(store.select(*on), on, "left_semi")


def unseen_patterns(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Patterns of a new batch not yet in the store, deduplicated by key."""
    return (batch.join(store.select("pattern"), "pattern", "left_anti")
                 .select("pattern", "resolution").distinct())


def lookup(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Exact key lookup; absent keys keep the query row with null store fields."""
    return queries.join(store, "pattern", "left")


def merge_counts(*conts: DataFrame, keys: tuple = ()) -> DataFrame:
    """Append batches of continuation counts and re-aggregate; tables
    dealt alike by ``keys`` are merged where they are."""
    u = conts[0]
    for c in conts[1:]:
        u = u.unionByName(c)
    return (u.groupBy(*keys, "pattern", "resolution", "next")
             .agg(F.sum("cnt").alias("cnt")))


def store_sizes(store: DataFrame) -> DataFrame:
    """How many (``n``) patterns of a resolution have the same counts: few rows
    that say all that ``store_statistics`` asks of a store."""
    return store.groupBy("resolution", "cnt", "n_next").agg(F.count(F.lit(1)).alias("n"))


def store_statistics(store_unfiltered: DataFrame, min_frequency: int = 1) -> DataFrame:
    """totals overall (resolution NULL) and per resolution via ROLLUP.

    ``total_patterns`` counts every extracted occurrence (before the
    frequency filter); ``unique_patterns`` and ``avg_continuations`` are over
    the kept patterns.  Takes a store, or its ``store_sizes``.
    """
    s = store_unfiltered
    kept, n = F.col("cnt") >= min_frequency, F.col("n") if "n" in s.columns else F.lit(1).cast("bigint")
    return (s.rollup("resolution")
            .agg(F.sum(F.col("cnt") * n).alias("total_patterns"),
                 F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).alias("unique_patterns"),
                 (F.sum(F.when(kept, F.col("n_next") * n)) / F.sum(F.when(kept, n))).alias("avg_continuations")))


def first_places(occ: DataFrame, keys: tuple = ()) -> DataFrame:
    """Continuation counts with the first place (doc, position) of each.  The
    count reads both columns, so that counts alone take the same shuffle."""
    seen = F.when((F.col("position") >= 0) | F.col("doc_id").isNotNull(), 1)
    return (occ.groupBy(*keys, "pattern", "resolution", "next")
               .agg(F.count(seen).alias("cnt"), F.min(F.struct("doc_id", "position")).alias("_at"))
               .select(*keys, "pattern", "resolution", "next", "cnt", "_at.doc_id", "_at.position"))


def first_continuation(occ: DataFrame, keys: tuple = ()) -> DataFrame:
    """first continuation per pattern in corpus order (doc, position)."""
    return (occ.groupBy(*keys, "pattern", "resolution")
               .agg(F.min_by("next", F.struct("doc_id", "position")).alias("first_next")))


def pattern_frequency(occ: DataFrame, keys: tuple = ()) -> DataFrame:
    """F10."""
    return occ.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("cnt"))


def pattern_sizes(parts: list[DataFrame]) -> DataFrame:
    """How many (``_k``) patterns of a resolution occur how often (``_n``)."""
    # a pattern has one resolution
    return union_parts([p.groupBy(*key_columns(p)).agg(F.count(F.lit(1)).alias("_n"), F.min("resolution").alias("_r"))
                        for p in parts]).groupBy("_n", "_r").agg(F.count("pattern").alias("_k"))


def pattern_profile(occ: DataFrame | list[DataFrame], exact: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """diversity profile; ``exact=False`` swaps in HyperLogLog++ counts.

    Exact counts take one row per pattern (parts share none; ``sizes`` are
    those of the parts where they are counted already) and one per
    continuation token, so no row is shuffled once for each count."""
    parts = occ if isinstance(occ, list) else [occ]
    if exact:
        pats = pattern_sizes(parts) if sizes is None else sizes
        n_next = union_parts([p.select("next") for p in parts]).distinct().select(F.count("next")).scalar()
        total = F.coalesce(F.sum(F.col("_n") * F.col("_k")), F.lit(0))
        x = pats.agg(total.alias("total_patterns"), F.coalesce(F.sum("_k"), F.lit(0)).alias("unique_patterns"),
                     n_next.alias("unique_continuations"),
                     (F.sum(F.col("_r") * F.col("_n") * F.col("_k")) / F.sum(F.col("_n") * F.col("_k"))).alias("avg_pattern_length"),
                     F.max("_r").alias("max_pattern_length"), F.min("_r").alias("min_pattern_length"))
    else:
        x = union_parts(parts).agg(F.count(F.lit(1)).alias("total_patterns"),
                                   F.approx_count_distinct("pattern").alias("unique_patterns"),
                                   F.approx_count_distinct("next").alias("unique_continuations"),
                                   F.avg("resolution").alias("avg_pattern_length"),
                                   F.max("resolution").alias("max_pattern_length"),
                                   F.min("resolution").alias("min_pattern_length"))
    return (x.withColumn("pattern_diversity", F.col("unique_patterns") / F.col("total_patterns"))
             .withColumn("continuation_diversity", F.col("unique_continuations") / F.col("total_patterns")))


def top_continuations(occ: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` most frequent continuation tokens (ties by token)."""
    return (occ.groupBy("next").agg(F.count(F.lit(1)).alias("cnt"))
               .orderBy(F.desc("cnt"), F.asc("next")).limit(n))


def length_histogram(occ: DataFrame, bins: int = 20, length_col: str = "resolution") -> DataFrame:
    """equal-width histogram of pattern lengths between min and max.

    min/max come from a one-row scalar subquery (no shuffle of the rows)."""
    lo = occ.select(F.min(length_col)).scalar()
    hi = occ.select(F.max(length_col)).scalar()
    width = (hi - lo).cast("double")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(length_col) - lo) / width * bins), F.lit(bins - 1)))
    return (occ.select(b.cast("int").alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")))


def distinct_patterns(occ: DataFrame, keys: tuple = ()) -> DataFrame:
    """I2."""
    return occ.select(*keys, "pattern", "resolution").distinct()


def level_sizes(store: DataFrame, min_size: int = 100) -> DataFrame:
    """Resolutions holding more than ``min_size`` patterns, and those patterns."""
    big = (store.groupBy("resolution").agg(F.count(F.lit(1)).alias("level_size"))
                .filter(F.col("level_size") > min_size))
    # one row per resolution
    return store.join(F.broadcast(big.select("resolution")), "resolution", "left_semi")


def higher_level_patterns(occ: DataFrame) -> DataFrame:
    """Pairs of adjacent lower-level patterns (b starts where a ends).

    Equi-join on (doc_id, start) so each occurrence meets only its
    successors at the same offset -- no pair enumeration per document.
    """
    a = occ.select("doc_id", F.col("position").alias("a_pos"), F.col("resolution").alias("a_res"),
                   F.col("pattern").alias("a_pattern"),
                   (F.col("position") + F.col("resolution")).alias("_start"))
    b = occ.select("doc_id", F.col("position").alias("_start"), F.col("resolution").alias("b_res"),
                   F.col("pattern").alias("b_pattern"))
    return (a.join(b, ["doc_id", "_start"], "inner")
             .select("doc_id", F.col("a_pos").alias("position"),
                     (F.col("a_res") + F.col("b_res")).alias("resolution"),
                     "a_pattern", "b_pattern",
                     F.concat_ws(" ", "a_pattern", "b_pattern").alias("pattern")))


def higher_level_counts(docs_tok: DataFrame, resolutions=(1, 2, 3, 5, 8), tasks: int | None = None,
                        portion: tuple | None = None) -> DataFrame:
    """``higher_level_patterns`` counted by the lengths of both: (a_res, b_res,
    n_pairs, n_distinct).

    All pairs that begin at one position are beginnings of one window.  One row
    per position is shuffled by its first two tokens and sorted there, so equal
    beginnings lie side by side, and a pattern is new where the row before does
    not begin alike.  Documents that share an id pair with each other: each
    length of the first pattern then makes a window of its own.  ``portion`` as
    in ``dealt_patterns``."""
    rs = sorted({int(r) for r in resolutions})
    d = docs_tok.filter(F.col("doc_id").isNotNull()).select("doc_id", "tokens")
    pairs = [(a, b) for a in rs for b in rs]
    if d.select("doc_id").groupBy("doc_id").count().filter("count > 1").isEmpty():
        x, rows = d.select("tokens", F.lit(1).alias("_times"), F.posexplode("tokens").alias("position", "_tok")), [None]
        longest = {None: F.slice("tokens", F.col("position") + 1, F.least(F.lit(2 * rs[-1]), F.size("tokens") - F.col("position") - 1))}
        x = x.filter(F.col("position") + 2 * rs[0] < F.size("tokens"))
    else:
        texts = d.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("_n"))
        x = texts.join(texts.select("doc_id", F.col("tokens").alias("_b"), F.col("_n").alias("_m")), "doc_id")
        x = x.select("tokens", "_b", (F.col("_n") * F.col("_m")).alias("_times"), F.posexplode("tokens").alias("position", "_tok"))
        rows, longest = rs, {}
        for r in rs:
            end = F.col("position") + r
            room = F.least(F.lit(rs[-1]), F.size("_b") - end - 1)
            both = F.concat(F.slice("tokens", F.col("position") + 1, F.lit(r)), F.slice("_b", end + 1, F.greatest(room, F.lit(0))))
            longest[r] = F.when((end < F.size("tokens")) & (room > 0), both)
    if portion:
        x = x.filter(F.pmod(F.xxhash64("_tok"), F.lit(portion[1])) == portion[0])
    window = F.array(*[F.struct(F.lit(r).cast("int").alias("_r"), longest[r].alias("_w")) for r in rows])
    x = x.select("_times", F.inline(window)).filter(F.col("_w").isNotNull())
    x = x.select("_times", "_r", F.concat_ws(" ", F.slice("_w", 1, 2)).alias("deal"), F.size("_w").alias("_n"),
                 F.concat(F.array_join("_w", " "), F.lit(" ")).alias("_key"))
    x = x.repartition(tasks or deal_tasks(docs_tok), "deal")
    w = Window.partitionBy("deal", "_r").orderBy("_key")
    x = x.withColumn("_before", F.lag("_key").over(w))
    sums = []
    for length in sorted({a + b for a, b in pairs}):
        # a shorter row before is returned whole, with a space at its end
        new = F.col("_before").isNull() | (F.substring_index("_before", " ", length) != F.substring_index("_key", " ", length))
        there = F.col("_n") >= length
        sums += [F.sum(F.when(there, F.col("_times"))).alias(f"p{length}"), F.count(F.when(there & new, 1)).alias(f"d{length}")]
    x = x.groupBy("_r").agg(*sums)
    one = [F.struct(F.lit(a).alias("a_res"), F.lit(b).alias("b_res"), F.col(f"p{a + b}").alias("n_pairs"), F.col(f"d{a + b}").alias("n_distinct"))
           for a, b in pairs]
    return x.select("_r", F.inline(F.array(*one))).filter((F.col("_r").isNull() | (F.col("_r") == F.col("a_res"))) & (F.col("n_pairs") > 0)).drop("_r")


def position_records(docs: DataFrame) -> DataFrame:
    """Per token of the whole text: absolute position, position from the
    end, document length, sentence index (sentence ends -- tokens ending in
    . ! ? -- before it) and paragraph index (its line).  Windows are keyed by
    document, so a group is one document."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("para", "line"))
    toks = lines.select("doc_id", "para",
                        F.posexplode(F.split(F.trim(F.regexp_replace("line", f"{T.WS}+", " ")), " ")).alias("i", "tok"))
    toks = toks.filter(F.col("tok") != "")
    w = Window.partitionBy("doc_id").orderBy("para", "i")
    ends = F.col("tok").rlike("[.!?]$").cast("int")
    x = (toks.withColumn("abs", F.row_number().over(w) - 1)
             .withColumn("sent", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))))
    return x.select("doc_id", F.col("abs").cast("bigint").alias("abs"),
                    (F.col("len") - F.col("abs") - 1).cast("bigint").alias("rel"), F.col("len").cast("bigint").alias("len"),
                    F.col("sent").cast("bigint").alias("sent"), F.col("para").cast("bigint").alias("para"), "tok")


def vocabulary(docs_tok: DataFrame) -> DataFrame:
    """``(token, cnt, token_id)``, ids by (count desc, token)."""
    v = docs_tok.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt"))
    from tessera.operators.corpus import grouped_index
    return grouped_index(v, [], [F.desc("cnt"), F.asc("token")], id_col="token_id")


def deal_docs(docs: DataFrame) -> DataFrame:
    """Documents dealt by their id, with the key ``_doc`` that they are dealt
    by: equal for rows without an id, which a join by ``doc_id`` would lose."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # with fewer, Spark deals anew to join
    n = max(least, deal_tasks(docs, ENCODE_BYTES))
    return docs.withColumn("_doc", F.struct("doc_id")).repartition(n, "_doc")


def token_lookup(tokens: list[str], ids: list[int]):
    """A function of arrays (tokens, and the rarer ones among them with their
    ids) to the ids of all tokens, those of ``tokens`` by ``ids``."""
    names, values = pa.array(tokens, pa.string()), pa.array(ids, pa.int64())

    @F.arrow_udf("array<bigint>")
    def lookup(texts: pa.Array, rare: pa.Array, rare_ids: pa.Array) -> pa.Array:
        flat = texts.flatten()
        more, own = rare.flatten(), rare_ids.flatten()
        found = pc.take(values, pc.index_in(flat, value_set=names))
        other = pc.take(own, pc.index_in(flat, value_set=more))
        ends = pc.cumulative_sum(pc.list_value_length(texts).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pc.coalesce(found, other))

    return lookup


def encode(docs_tok: DataFrame, vocab: DataFrame, unk_id: int = -1, common: int = COMMON_TOKENS) -> DataFrame:
    """B7 encode: ``(doc_id, ids ARRAY<BIGINT>)`` in token order; the tokens of
    rows that share an id are merged by their place, then id.

    The first ``common`` ids, which are the most frequent tokens, go to the
    tasks that hold the documents (``deal_docs``).  Of the others, each
    document asks the vocabulary for its distinct ones; only these are
    shuffled.  ``vocab`` has one row per token."""
    d = docs_tok if "_doc" in docs_tok.columns else deal_docs(docs_tok)
    ids = vocab.select("token", "token_id")
    hot = F.coalesce(F.col("token_id").between(0, common - 1) & (F.length("token") <= COMMON_LENGTH), F.lit(False))
    known = ids.filter(hot)                                            # at most ``common`` rows
    x = d.select("_doc", F.explode("tokens").alias("token")).join(F.broadcast(known.select("token")), "token", "left_anti").distinct()
    rare = x.join(ids.filter(~hot), "token", "left").select("_doc", "token", F.coalesce("token_id", F.lit(unk_id)).alias("id"))
    rare = rare.groupBy("_doc").agg(F.collect_list(F.struct("token", "id")).alias("_rare")).hint("shuffle_hash")
    rows = known.toPandas()
    lookup = token_lookup(rows["token"].tolist(), rows["token_id"].tolist())
    y = d.join(rare, "_doc", "left").select(
        "_doc", lookup("tokens", F.coalesce("_rare.token", F.array().cast("array<string>")),
                       F.coalesce("_rare.id", F.array().cast("array<bigint>"))).alias("ids"))
    y = y.groupBy("_doc").agg(F.collect_list("ids").alias("_all"))     # more than one only where rows share an id
    placed = F.flatten(F.transform("_all", lambda a: F.transform(a, lambda v, i: F.struct(i.alias("pos"), v.alias("id")))))
    merged = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(F.sort_array(placed)["id"])
    return y.select("_doc.doc_id", merged.alias("ids"))


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """B7 decode: ids back to text; unknown / special ids (< 0) are skipped."""
    x = ids.select("doc_id", F.posexplode("ids").alias("pos", "token_id")).filter(F.col("token_id") >= 0)
    x = x.join(vocab.select("token", "token_id"), "token_id", "inner")
    return (x.groupBy("doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_s"))
             .select("doc_id", F.array_join(F.col("_s.token"), " ").alias("text")))
