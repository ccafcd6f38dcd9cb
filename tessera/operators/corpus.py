"""Corpus operators: statistics, splits, sampling, interleaving, ids.

Ordering-based operators (splits, samples, round-robin) never use a window
without a partition: row numbers come from ``grouped_index`` which range
partitions on (group, order) -- a hot group spreads over many tasks -- and
adds per-partition offsets computed from a tiny aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import checkpoint_dir


def seeded_key(seed: int, *cols) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed|col...' (same in any engine)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def grouped_index(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                  id_col: str = "rn", start: int = 0, partitions: int | None = None) -> DataFrame:
    """0-based row number per group in a total order, skew-safe.

    Range partitioning on (group, order) splits even a group holding a third
    of all rows across tasks; the in-partition offset comes from
    ``monotonically_increasing_id`` after a sort within partitions, and the
    rows of the same group in earlier partitions are added from a small
    (partition x group) count table.  The sorted table is checkpointed to the
    shared checkpoint folder so both passes read the same rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    first = (s.groupBy("_pid", *group_cols)
              .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    first = first.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # (partition x group) rows: bounded by partitions x groups per partition
    out = s.join(first.select("_pid", *group_cols, "_first", "_before"), ["_pid", *group_cols])
    return (out.withColumn(id_col, (F.col("_before") + F.col("_mid") - F.col("_first") + start).cast("bigint"))
               .drop("_pid", "_mid", "_first", "_before"))


def corpus_info(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """documents, total / avg / min / max characters; zeros when empty."""
    n = F.length(text_col)
    return docs.agg(F.count(F.lit(1)).alias("num_documents"),
                    F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_chars"),
                    F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chars"),
                    F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min_chars"),
                    F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_chars"))


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """samples, tokens, mean / median / min / max words."""
    w = T.n_words(text_col)
    x = docs.select(w.alias("w"))
    return x.agg(F.count(F.lit(1)).alias("num_samples"),
                 F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("total_tokens"),
                 F.avg("w").alias("avg_words"),
                 F.median("w").alias("median_words"),
                 F.min("w").cast("bigint").alias("min_words"),
                 F.max("w").cast("bigint").alias("max_words"))


def source_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """F12 per-source counts (the real source column)."""
    return docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("num_samples"))


def first_n_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """First ``n`` rows per group (``row_number`` gets a WindowGroupLimit
    before the shuffle, so at most n rows per group and partition move)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def interleave(docs: DataFrame, source_col: str = "source", order_col: str = "doc_id",
               max_samples: int | None = None) -> DataFrame:
    """Round-robin over sources (source rank = sorted source name),
    the k-th document of every source before any (k+1)-th; stop at max_samples."""
    x = grouped_index(docs, [source_col], [F.col(order_col)], "rr")
    ranks = grouped_index(docs.select(source_col).distinct(), [], [F.col(source_col)], "source_rank")
    x = x.join(ranks, source_col)  # one row per source; AQE broadcasts it when small
    x = x.orderBy("rr", "source_rank")
    return x.limit(max_samples) if max_samples else x


def assign_ids(new: DataFrame, order: list, existing: DataFrame | None = None,
               id_col: str = "id") -> DataFrame:
    """Dense ids continuing after the current maximum of ``existing``."""
    start = 0
    if existing is not None:
        m = existing.agg(F.max(id_col)).first()[0]
        start = 0 if m is None else int(m) + 1
    return grouped_index(new, [], order, id_col, start=start)


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """H3: exactly ``n`` rows in seeded-hash order (top-n, no global sort)."""
    return df.orderBy(seeded_key(seed, id_col), F.col(id_col)).limit(n)


def shuffle_rows(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """H4: deterministic shuffle (range-partitioned sort on a hash key)."""
    return df.orderBy(seeded_key(seed, id_col), F.col(id_col))


def ratio_split(df: DataFrame, seed: int, id_col: str,
                ratios=(0.8, 0.1, 0.1)) -> DataFrame:
    """H5: exact counts ``int(n*ratio)`` for train/validation, remainder test,
    in seeded-hash order."""
    n = df.count()
    n_train = int(n * ratios[0])
    n_val = int(n * ratios[1])
    x = grouped_index(df.withColumn("_k", seeded_key(seed, id_col)), [], [F.col("_k"), F.col(id_col)], "_i")
    split = (F.when(F.col("_i") < n_train, "train")
              .when(F.col("_i") < n_train + n_val, "validation").otherwise("test"))
    return x.withColumn("split", split).drop("_k", "_i")


def prefix_split(df: DataFrame, ratio: float, id_col: str) -> DataFrame:
    """H6: the first ``int(n*ratio)`` rows by id are validation."""
    n = df.count()
    k = int(n * ratio)
    x = grouped_index(df, [], [F.col(id_col)], "_i")
    return x.withColumn("split", F.when(F.col("_i") < k, "validation").otherwise("train")).drop("_i")


def tail_n(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """H7: the last ``n`` rows by id (hold-out)."""
    return first_rows(df, [F.desc(id_col)], n)


def head_n(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """H8 / A3: the first ``n`` rows by id."""
    return first_rows(df, [F.asc(id_col)], n)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order, however many that are: a
    distributed dense index instead of one task that sorts ``n`` rows."""
    return grouped_index(df, [], order, "_n").filter(F.col("_n") < n).drop("_n")


def bounded_scan(docs: DataFrame, min_chars: int, limit: int, text_col: str = "text") -> DataFrame:
    """A3: keep texts above ``min_chars`` (stripped), stop after ``limit`` kept rows."""
    return head_n(docs.filter(T.min_length(text_col, min_chars)), limit, "doc_id")


def sample_corpus(ids: DataFrame, pool: DataFrame, seed: int = 42,
                  lo: int = 5, hi: int = 15) -> DataFrame:
    """For every id a document of lo..hi sentences drawn from ``pool``
    (``(sent_idx, sentence)``, dense 0-based) by seeded hashes; sentences are
    joined with a space. The pool size comes from a scalar subquery."""
    npool = pool.select(F.count(F.lit(1))).scalar()
    h = lambda *p: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *p)), 1, 8), 16, 10).cast("bigint")
    n_sent = (lo + h(F.col("doc_id").cast("string"), F.lit("n")) % (hi - lo + 1)).cast("int")
    x = ids.select("doc_id", F.posexplode(F.array_repeat(F.lit(0), n_sent)).alias("i", "_z"))
    x = x.withColumn("sent_idx", h(F.col("doc_id").cast("string"), F.col("i").cast("string")) % npool)
    x = x.join(pool, "sent_idx")
    return (x.groupBy("doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("i", "sentence"))).alias("_s"))
             .select("doc_id", F.array_join("_s.sentence", " ").alias("text")))


def vocabulary_health(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """out-of-vocabulary rate of ``tokens`` against ``vocab`` (token, cnt)
    and the coefficient of variation of vocabulary weights."""
    v = vocab.select("token", F.lit(1).alias("_in"))
    oov = tokens.join(v, "token", "left").agg(F.count(F.lit(1)).alias("n_tokens"),
                                               F.avg(F.col("_in").isNull().cast("double")).alias("oov_rate"))
    # one-row statistics of the vocabulary as scalar subqueries
    cv = vocab.select(F.stddev_pop("cnt") / F.avg("cnt")).scalar()
    size = vocab.select(F.count(F.lit(1))).scalar()
    return oov.withColumn("weight_cv", cv).withColumn("vocab_size", size)
