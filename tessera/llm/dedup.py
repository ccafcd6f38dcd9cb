"""Exact deduplication as a stateful stream (4).

A Structured Streaming aggregation keeps one state row per content digest in
RocksDB (on disk), without watermark, so nothing expires.  The state holds
the digest, how many rows had it, and the row that stays: its stable
identifier and the locator of its content (file and row in the file).  Spark
aggregates partially before the shuffle, so a text that makes up a third of
all rows reaches its state row as one partial count per task.

A digest only proposes that texts are equal.  Where it was seen twice the
full bytes of each row are compared with those of the row that stays, found
by its locator; rows that differ are grouped again by their full text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stored
from tessera.session import scratch_path

#: Spark's disk-backed state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def table_glob(path: str) -> str:
    """A pattern that only ``path`` matches: the file source then takes a
    table that is one file as well as one that is a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def _keyed(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = F.struct(F.col(id_col).cast("long").alias("id"), F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.row_index").alias("row"))
    return df.select(text.alias("text"), digest(text).alias("digest"), at.alias("at"))


def digest_groups(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                  digest: Callable[[Column], Column] = sha256, max_files: int | None = None,
                  state: str | None = None) -> DataFrame:
    """Stream the Parquet table at ``path`` through the keyed state.

    Per digest: ``keep`` (id, file, row of the row that stays: the largest id,
    of equal ids the last row) and ``n``, its rows.  ``max_files`` bounds a
    micro-batch.  ``state`` names the checkpoint folder; given again, the
    stream goes on with the files that are new and counts no file twice.
    """
    home = state or scratch_path(spark, "dedup-state")
    out = f"{home}/groups"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = _keyed(reader.parquet(table_glob(path)), id_col, text_col, digest).drop("text")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("keep"))

    def write(batch: DataFrame, batch_id: int) -> None:      # a batch that runs again overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    old = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        (groups.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
               .option("checkpointLocation", f"{home}/checkpoint").start().awaitTermination())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # counts only grow: the last version of a digest has the largest
    parts = spark.read.schema("digest string, n long, keep struct<id: long, file: string, row: long>, batch int").parquet(out)
    return parts.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")) \
                .select("digest", F.col("last.n").alias("n"), F.col("last.keep").alias("keep"))


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[Column], Column] = sha256, max_files: int | None = None,
                     state: str | None = None) -> DataFrame:
    """Per row of the table at ``path``: id, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, and the row's locator ``file`` and ``row``.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest id stays (null ids are the smallest); of rows that
    repeat it with the same id, the last by file and row, so exactly one row
    of a group is ``kept``.  Other columns are ignored.  An empty table gives
    no rows.  The stream needs ``path`` to be a Parquet table.
    """
    if spark.read.parquet(path).isEmpty():
        return spark.range(0).select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.col("id").alias("group_size"),
                                     F.lit(True).alias("kept"), F.lit("").alias("text_sha256"),
                                     F.lit("").alias("file"), F.col("id").alias("row"))
    groups = stored(digest_groups(spark, path, id_col, text_col, digest, max_files, state), "digest-groups")
    hits = groups.filter("n > 1")
    rows = _keyed(spark.read.parquet(path), id_col, text_col, digest)
    # content of the rows that stay, by locator
    kept = (rows.select("text", "at").join(hits.select("digest", "n", F.col("keep").alias("at")), "at")
                .select("digest", "n", F.col("at").alias("keep"), F.col("text").alias("kept_text")))
    kept = stored(kept, "kept-texts")
    # full bytes of every row of a digest seen twice against those of the row that stays
    seen = rows.join(kept, "digest", "left").select(
        "at", "digest", F.col("text"), "keep", "n", (F.col("text") == F.col("kept_text")).alias("same"))
    seen = seen.withColumn("text_sha256", F.sha2("text", 256)) \
               .withColumn("text", F.when(F.expr("NOT same"), F.col("text")))
    seen = stored(seen, "checked-rows")
    clash = seen.filter("NOT same")
    if clash.isEmpty():
        same, other = seen, None
    else:   # equal digests of different texts: group the rest by full text, and count the first group anew
        moved = clash.groupBy("digest").agg(F.count("*").alias("gone"))
        other = clash.groupBy("digest", "text").agg(F.count("*").alias("n2"), F.max("at").alias("keep2"))
        other = clash.select("at", "digest", "text", "text_sha256").join(other, ["digest", "text"]) \
                     .select("at", "text_sha256", F.col("keep2").alias("keep"), F.col("n2").alias("n"))
        same = seen.filter("same IS NULL OR same").join(moved, "digest", "left") \
                   .withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    same = same.select("at", "text_sha256", F.coalesce("keep", "at").alias("keep"), F.coalesce("n", F.lit(1)).alias("n"))
    out = same if other is None else same.union(other)
    return out.select(F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("at") == F.col("keep")).alias("kept"), "text_sha256",
                      F.col("at.file").alias("file"), F.col("at.row").alias("row"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all columns.

    The stream reads tables, so ``docs`` is landed in the scratch folder."""
    spark = docs.sparkSession
    at = scratch_path(spark, "landed")
    docs.write.parquet(at)
    landed = spark.read.schema(docs.schema).parquet(at)
    marks = exact_duplicates(spark, at, id_col, text_col).filter("NOT kept")
    file, row = fresh(docs, "_file", "_row")
    rows = landed.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    return rows.join(marks.select(F.col("file").alias(file), F.col("row").alias(row)), [file, row], "left_anti") \
               .select(docs.columns)
