"""Mixing sources to target weights by a low-discrepancy schedule (3).

Slot ``i`` of 2**m slots has the van der Corput point ``reversed bits of i /
2**m``.  The points are mapped through the cumulative targets of the sources,
so every stretch of the schedule holds each source in proportion.  As the
points of all slots are the multiples of 2**-m, a source's slots are a range
of numerators: they are generated from it, in chunks, without a range join.

Each source's documents stand in hash order and form one cyclic run of
words, cut into blocks of equal size.  The slot with rank r among its
source's slots takes block r; the last one closes the source's target.
Running sums are taken per hash prefix and per prefix table, so no task ever
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stored, word_count

BLOCK_WORDS = 256
MOST_REPEATS = 3
WEIGHTS = 3
#: Expected rows of a running-sum group, and slots generated by one row.
GROUP_ROWS = 16_384


def targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size): ``weight`` 1, 2, 3, 1, ... by code point,
    null last; ``target``: shares of all words by weight, none above
    ``repeats`` times its source, the excess shared again by weight; ``quota``
    the target in whole words.  One row per source, the size of the list.

    Sharing until none is above ends at one level L with target =
    min(cap, L * weight); sources in order of cap / weight reach their caps
    first, so L follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", (F.col("sid") - 1) % WEIGHTS + 1)
    s = s.withColumn("cap", repeats * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum(F.col("source_size").cast("double")).over(everything)
                     - (F.sum("cap").over(by_ratio) - F.col("cap")))
    s = s.withColumn("heavy", F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio) - F.col("weight")))
    s = s.withColumn("level", F.col("rest") / F.col("heavy"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    s = s.withColumn("target", F.least("cap", first["level"] * F.col("weight")))
    return s.select("sid", "source", "source_size", "weight", "target", F.round("target").cast("long").alias("quota"))


def _running(df: DataFrame, group: list[str], prefix: str, order: list, value, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of ``group``
    before each row; ``prefix`` (monotone in ``order``) splits a group."""
    per = df.groupBy(*group, prefix).agg(F.sum(value).alias("_sum"))
    per = per.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*group).orderBy(prefix)) - F.col("_sum"))
    inside = F.sum(value).over(Window.partitionBy(*group, prefix).orderBy(*order)
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value
    joined = df.withColumn("_inside", inside).join(per.drop("_sum").hint("merge"), [*group, prefix])
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, h): words of each document and its place in the hash order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"), key.alias("h"))


def grid(total: int, block_words: int) -> tuple[int, int]:
    """(m, block): 2**m slots of ``block`` words, about ``block_words`` or fewer, hold ``total`` words."""
    m = 1
    while (1 << m) * block_words < total:
        m += 1
    return m, max(1, -(-total // (1 << m)))


def schedule(plan: DataFrame, total: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots: ``slot`` (place in the mix), ``sid``, ``rank`` (among the slots of the source)."""
    m, _ = grid(total, block_words)
    chunks = plan.filter("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(GROUP_ROWS))).alias("at"))
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = chunks.repartition(n, "sid", "at").select(
        "sid", F.explode(F.sequence("at", F.least(F.col("at") + GROUP_ROWS, "hi") - 1)).alias("point"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("point"), m, "0")), 2, 10).cast("long")
    slots = points.select("sid", reverse.alias("slot")).withColumn("part", F.floor(F.col("slot") / GROUP_ROWS))
    return _running(slots, ["sid"], "part", ["slot"], F.lit(1), "rank").select("slot", "sid", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
        block_words: int = BLOCK_WORDS, repeats: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (pieces, documents).

    pieces: one row per run of words of a document that a slot takes:
    ``slot``, ``row``, ``id``, ``first`` (its first word in the document), ``n``.
    documents: one row per row of ``docs``: ``row`` (a key), ``id``, ``source``,
    ``size``, ``source_size``, ``target``.

    Null texts have no words, a null source is a source of its own (the
    last), and a source without words has target 0.  The order of documents
    is md5 of (seed, id), equal ids by size, so reruns agree.  An empty table
    gives no rows.  Other columns are ignored.
    """
    rows = stored(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    m, block = grid(total, block_words)
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats)
    order = Window.orderBy("sid")
    share = F.sum("target").over(order) / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1.0))
    plan = plan.withColumn("hi", F.ceil(share * (1 << m)).cast("long")) \
               .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0)))
    # a source below one slot takes one all the same
    plan = plan.withColumn("hi", F.when(F.col("quota") > 0, F.greatest("hi", F.col("lo") + 1)).otherwise(F.col("lo")))
    plan = stored(plan, "mix-plan")

    digits = 0
    while n > GROUP_ROWS * 16 ** digits:
        digits += 1
    rows = rows.join(plan.select(F.col("source").alias("_s"), "sid", "source_size", "target", "quota",
                                 (F.col("hi") - F.col("lo")).alias("n_slots")),
                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = _running(rows.withColumn("prefix", F.substring("h", 1, digits)), ["sid"], "prefix", ["h", "id", "size"],
                    F.col("size"), "start")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")

    # the documents' words in each pass over their source, cut at block borders
    runs = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    runs = runs.withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")) \
               .withColumn("b", F.least(F.col("a") + F.col("size"), "quota")).filter("a < b")
    runs = runs.select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("k"))
    begin, end = F.greatest("a", F.col("k") * block), F.least("b", (F.col("k") + 1) * block)
    runs = runs.select("row", "id", "sid", F.least("k", F.col("n_slots") - 1).alias("rank"),
                       (begin - F.col("a")).alias("first"), (end - begin).alias("n"))
    # slots come from a few rows, so their number shows in no statistic: never broadcast them
    pieces = runs.join(schedule(plan, total, block_words).hint("merge"), ["sid", "rank"]).select("slot", "row", "id", "first", "n")
    return pieces, rows.select("row", "id", "source", "size", "source_size", "target")


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
    pieces, rows = mix(docs, id_col, **options)
    per = pieces.groupBy("row").agg(F.sum("n").alias("taken"))
    return rows.join(per, "row", "left").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words (rounded
    to whole documents, half up); a document taken for less than half goes.
    Rows that share id, source and size share what is taken of them."""
    t = taken(docs, id_col, **options)
    times = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
    i, src, size, n, copy = fresh(docs, "_id", "_source", "_size", "_times", "_copy")
    t = t.groupBy(id_col, "source", "size").agg(times.alias(n)).filter(F.col(n) > 0) \
         .select(F.col(id_col).alias(i), F.col("source").alias(src), F.col("size").alias(size), n)
    text, source = options.get("text_col", "text"), options.get("source_col", "source")
    same = (F.col(id_col).eqNullSafe(F.col(i)) & F.col(source).cast("string").eqNullSafe(F.col(src))
            & (word_count(text) == F.col(size)))
    return docs.join(t, same).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(docs.columns)
