"""Novelty-gated insert into a growing store.

A new vector is inserted if no stored vector, and no vector inserted before
it, is as similar as ``theta``; vectors of a batch count in the order of their
ids.  Within a batch that is a maximal independent set taken in id order: a
round inserts every candidate without an earlier undecided conflict, then
drops the candidates that conflict with those.  A round only asks each
candidate for its first conflict, so its rows follow the candidates, not the
pairs, however many near-equal vectors a batch holds.

Every micro-batch writes its vectors to ``batch_id=N`` and reads only those of
earlier batches, so a batch that is replayed writes the same rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.session import checkpoint_dir, path_exists


def first_conflict(vecs: DataFrame, others: DataFrame, theta: float, earlier: bool, metric: str = "cosine") -> DataFrame:
    """(vec_id, first): the smallest id of ``others`` that scores ``theta`` or
    more, of those with a smaller id if ``earlier``; vectors without one are
    left out.  ``others`` is scanned once per block of ``vecs`` that may be
    sent to all tasks."""
    size = vecs.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-size[0] * (size[1] or 0) * 8 // K.BROADCAST_BYTES))
    found = None

    def scan(sent):
        def run(batches):
            ids, x = sent.value
            first = np.full(len(ids), np.iinfo(np.int64).max)
            step = max(1, K.SCORE_CELLS // max(1, len(ids)))
            for pdf in batches:
                for at in range(0, len(pdf) if len(ids) else 0, step):
                    some = pdf.iloc[at:at + step]
                    other = some["vec_id"].to_numpy(dtype=np.int64)
                    close = np.round(K._scores(x, K._mat(some["embedding"]), metric), 12) >= theta
                    if earlier:
                        close &= other[None, :] < ids[:, None]
                    first = np.minimum(first, np.where(close, other[None, :], np.iinfo(np.int64).max).min(1))
            hit = first < np.iinfo(np.int64).max
            yield pd.DataFrame({"vec_id": np.asarray(ids, np.int64)[hit], "first": first[hit]})
        return run

    for b in range(blocks):
        some = vecs.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = others.select("vec_id", "embedding").mapInPandas(scan(K._sent(some, "vec_id", "embedding")), "vec_id BIGINT, first BIGINT")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("vec_id").agg(F.min("first").alias("first"))


def novel(batch: DataFrame, store: DataFrame | None, theta: float, metric: str = "cosine") -> DataFrame:
    """The rows of ``batch`` (vec_id, embedding, ...) that are inserted.  Ids
    that are stored already, and a second row of one id, are not."""
    checkpoint_dir(batch.sparkSession)
    left = batch.dropDuplicates(["vec_id"])
    if store is not None:
        left = left.join(store.select("vec_id"), "vec_id", "left_anti").checkpoint()
        left = left.join(first_conflict(left, store, theta, False, metric), "vec_id", "left_anti")
    left, taken = left.checkpoint(), None
    while not left.isEmpty():
        waiting = first_conflict(left, left, theta, True, metric).checkpoint()
        now = left.join(waiting, "vec_id", "left_anti").checkpoint()
        taken = now if taken is None else taken.unionByName(now)
        left = left.join(waiting, "vec_id", "left_semi")
        left = left.join(first_conflict(left, now, theta, False, metric), "vec_id", "left_anti").checkpoint()
    return batch.limit(0) if taken is None else taken


def stored_vectors(spark, out_dir: str, before: int | None = None) -> DataFrame | None:
    """Vectors inserted so far, or by the batches ``before`` one."""
    path = f"{out_dir}/vectors"
    if not path_exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return (rows if before is None else rows.filter(F.col("batch_id") < before)).drop("batch_id")


def novelty_writer(out_dir: str, theta: float, metric: str = "cosine"):
    """``foreachBatch`` sink; a batch that runs again overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = novel(batch, stored_vectors(batch.sparkSession, out_dir, int(batch_id)), theta, metric)
        (rows.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out_dir}/vectors"))
    return write


def run_novelty(stream: DataFrame, out_dir: str, checkpoint: str, theta: float, metric: str = "cosine", available_now: bool = True):
    """Start (or resume from ``checkpoint``) the gated insert of a stream of vectors."""
    w = stream.writeStream.foreachBatch(novelty_writer(out_dir, theta, metric)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
