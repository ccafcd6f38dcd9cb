"""Vocabulary that grows with a stream.

The state is one row a token: static or learned, weight, count and total
energy of its occurrences.  Each micro-batch makes a new version of the table,
``version=N``, from the newest version of an earlier batch, so a batch that
runs again writes the same version again.

An occurrence of a static token has energy 0, of a learned one 0.3, of an
unknown one 1.0; that one adds the token (weight ``1 + 2 * energy`` = 3), and
its further occurrences in the batch count as learned.  Then the weight of
every token that was ever seen moves by ``eta * (mean energy - decay * weight)``,
not below ``floor``.  Counts above ``HALVE_ABOVE`` are halved with their
energy.  Above ``capacity`` the learned tokens with the lowest weights go;
static ones never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.corpus import grouped_index
from tessera.session import path_exists, remove_path

#: Fixed values of the energies and of the weight a token enters with.
UNKNOWN, LEARNED, ENTRY_WEIGHT = 1.0, 0.3, 3.0
HALVE_ABOVE = 1000
#: Versions that stay after a batch.
KEEP_VERSIONS = 3
COLUMNS = ("token", "static", "weight", "count", "energy")


def static_vocabulary(tokens: DataFrame) -> DataFrame:
    """State of the static tokens before the first batch, each of weight 1."""
    return tokens.select("token").distinct().select(
        "token", F.lit(True).alias("static"), F.lit(1.0).alias("weight"), F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("energy"))


def update(state: DataFrame, tokens: DataFrame, capacity: int, eta: float = 0.1, decay: float = 0.01, floor: float = 0.1) -> DataFrame:
    """The state after a batch of ``tokens`` (one row an occurrence)."""
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    more = F.when(F.col("static").isNull(), UNKNOWN + LEARNED * (n - 1)).when(F.col("static"), 0.0).otherwise(LEARNED * n)
    x = state.join(seen, "token", "full_outer").select(
        "token", F.coalesce("static", F.lit(False)).alias("static"), F.coalesce("weight", F.lit(ENTRY_WEIGHT)).alias("weight"),
        (F.coalesce("count", F.lit(0)) + n).alias("count"), (F.coalesce("energy", F.lit(0.0)) + more).alias("energy"))
    moved = F.greatest(F.lit(floor), F.col("weight") + eta * (F.col("energy") / F.col("count") - decay * F.col("weight")))
    big = F.col("count") > HALVE_ABOVE
    x = x.withColumn("weight", F.when(F.col("count") > 0, moved).otherwise(F.col("weight")))
    x = x.withColumns({"count": F.when(big, F.expr("count div 2")).otherwise(F.col("count")),
                       "energy": F.when(big, F.col("energy") / 2).otherwise(F.col("energy"))})
    # static tokens first, then the heaviest; equal weights by token
    ranked = grouped_index(x.withColumn("_w", F.round("weight", 9)), [], [F.desc("static"), F.desc("_w"), F.asc("token")], "_r")
    return ranked.filter(F.col("static") | (F.col("_r") < capacity)).select(*COLUMNS)


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    """Versions that are there: the names of the partition folders."""
    if not path_exists(spark, out_dir):
        return []
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_dir)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(int(x.split("=")[1]) for x in names if x.startswith("version="))


def current(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a batch."""
    known = [v for v in _versions(spark, out_dir) if before is None or v < before]
    return spark.read.parquet(f"{out_dir}/version={known[-1]}").select(*COLUMNS) if known else None


def vocabulary_writer(out_dir: str, static: DataFrame, capacity: int, text_col: str = "text", **rates):
    """``foreachBatch`` sink for documents with ``text_col``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = current(spark, out_dir, int(batch_id))
        tokens = batch.select(F.explode(T.ws_tokens(T.normalize(text_col))).alias("token"))
        update(static if state is None else state, tokens, capacity, **rates) \
            .write.mode("overwrite").parquet(f"{out_dir}/version={int(batch_id)}")
        for old in _versions(spark, out_dir)[:-KEEP_VERSIONS]:
            remove_path(spark, f"{out_dir}/version={old}")
    return write


def run_vocabulary(stream: DataFrame, out_dir: str, checkpoint: str, static: DataFrame, capacity: int, available_now: bool = True, **rates):
    """Start (or resume from ``checkpoint``) the vocabulary of a stream of texts."""
    w = stream.writeStream.foreachBatch(vocabulary_writer(out_dir, static, capacity, **rates)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
