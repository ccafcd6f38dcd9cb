"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir, scratch_path

#: Fixed value: the white space that separates words in this subpackage.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
NON_WORD = "[^\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts
    the lineage, survives lost executors, and is read by any number of jobs."""
    spark = df.sparkSession
    at = scratch_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any
    more: it does so when the driver's garbage is collected, by itself only
    every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``max_bytes`` of
    ``column`` each (a single longer row is a batch of its own)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < b.num_rows:
            yield b.slice(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def words(text) -> F.Column:
    """Array of words of a text column; empty for null and blank texts."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(t, WORD_GAP), "")


def word_count(text) -> F.Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(t, F.lit(NON_WORD)).cast("bigint")
