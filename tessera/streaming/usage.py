"""Usage of stored vectors, and eviction by it.

Searches append their hits to a log with the time of the search.  The log is
reduced batch by batch to (vec_id, usage, last); a batch writes its part to
``batch_id=N``, so one that runs again counts once.  ``retained`` keeps the
``max_index_size`` vectors that were used most; equal usage goes by the latest
use, then by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.operators.corpus import grouped_index
from tessera.session import path_exists


def hit_log(hits: DataFrame, at) -> DataFrame:
    """Log rows (vec_id, at) of hits; ``at`` is the time of the search."""
    return hits.select("vec_id", at.cast("timestamp").alias("at"))


def usage_writer(out_dir: str):
    """``foreachBatch`` sink of log rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy("vec_id").agg(F.count(F.lit(1)).alias("usage"), F.max("at").alias("last"))
        (part.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))
    return write


def run_usage(log: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """Start (or resume from ``checkpoint``) counting a stream of log rows."""
    w = log.writeStream.foreachBatch(usage_writer(out_dir)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def usage(spark: SparkSession, out_dir: str) -> DataFrame:
    """(vec_id, usage, last) of all batches so far."""
    if not path_exists(spark, out_dir):
        return spark.createDataFrame([], "vec_id BIGINT, usage BIGINT, last TIMESTAMP")
    return spark.read.parquet(out_dir).groupBy("vec_id").agg(F.sum("usage").alias("usage"), F.max("last").alias("last"))


def retained(ids: DataFrame, used: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(vec_id, usage, last) of the vectors that stay.  The rank is a
    distributed index, so the capacity may be any number of rows."""
    x = ids.select("vec_id").join(used, "vec_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)).cast("bigint"))
    order = [F.desc("usage"), F.desc_nulls_last("last"), F.asc("vec_id")]
    return grouped_index(x, [], order, "_r").filter(F.col("_r") < config.max_index_size).drop("_r")


def evict(index, used: DataFrame, config: Config = DEFAULT) -> int:
    """Shrink a ``VectorIndex`` to ``max_index_size``; returns how many go."""
    ids = index.lists().select("vec_id")
    n = ids.count()
    if n <= config.max_index_size:
        return 0
    index.evict(retained(ids, used, config))
    return n - config.max_index_size
