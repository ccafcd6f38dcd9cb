"""Sources and sinks (A1-A11): plain Spark readers and writers.

Everything is a distributed read or write; nothing passes through the
driver except the one-row config.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as T
from tessera.session import path_exists

JSONL_SCHEMA = "id BIGINT, text STRING"


def read_text_dir(spark: SparkSession, directory: str, min_chars: int = 50,
                  glob: str = "*.txt") -> DataFrame:
    """A1: one row per ``*.txt`` file (UTF-8), stripped, kept if longer than
    ``min_chars``; unreadable files are skipped (``ignoreCorruptFiles``)."""
    # text() has its own wholetext=False default, so pass it as a keyword
    df = (spark.read.option("ignoreCorruptFiles", True)
          .text(directory, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True))
    df = df.select(F.input_file_name().alias("path"), T.strip("value").alias("text"))
    return df.filter(F.length("text") > min_chars)


def write_text_files(docs: DataFrame, directory: str, key: str = "doc_id") -> None:
    """Companion writer for A1 tests: one ``.txt`` file per key directory."""
    docs.select(key, "text").write.mode("overwrite").partitionBy(key).text(directory)


def read_json_string_array(spark: SparkSession, path: str) -> DataFrame:
    """A4: a JSON file holding one array of strings -> ``(idx, text)`` rows.

    ``read.json`` cannot treat a top-level string array as rows, so the file
    is read whole and exploded (each file is one array)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    arr = F.from_json("value", "array<string>")
    return raw.select(F.input_file_name().alias("path"), F.posexplode(arr).alias("idx", "text"))


def write_json_string_array(df: DataFrame, path: str, order_col: str, text_col: str = "text") -> None:
    """A5: JSON arrays of strings, one element per line, ordered by ``order_col``.

    Rows are range partitioned and each file is one array with the brackets
    and commas in its lines, so no task holds more than its own part; the
    files in order of their names hold the whole set in order."""
    w = Window.partitionBy("_p").orderBy(order_col)
    x = (df.select(order_col, F.col(text_col).alias("_t")).repartitionByRange(order_col).withColumn("_p", F.spark_partition_id()))
    x = x.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("_p"))})
    one = F.to_json(F.array("_t"))                       # ["..."]: quoting as JSON has it
    line = F.concat(F.when(F.col("_i") == 1, "[").otherwise(""), F.substr(one, F.lit(2), F.length(one) - 2),
                    F.when(F.col("_i") == F.col("_n"), "]").otherwise(","))
    x.repartitionByRange("_p").sortWithinPartitions("_p", "_i").select(F.col("_p").alias("part"), line.alias("value")) \
        .write.mode("overwrite").partitionBy("part").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON Lines ``{id, text}`` (one file per partition)."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = JSONL_SCHEMA) -> DataFrame:
    """A6 read-back with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def save_store(store: DataFrame, path: str, cfg: Config | None = None,
               metrics: DataFrame | None = None, partition_col: str | None = "resolution",
               max_records_per_file: int | None = None) -> None:
    """Store + config + metrics under one folder; the store is
    partitioned (per resolution) and sharded by ``maxRecordsPerFile``."""
    w = store.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(os.path.join(path, "store"))
    spark = store.sparkSession
    if cfg is not None:
        cfg.save(spark, os.path.join(path, "config"))
    if metrics is not None:
        metrics.write.mode("overwrite").json(os.path.join(path, "metrics"))


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, Config | None]:
    """The store (partition column restored) and its config."""
    store = spark.read.parquet(os.path.join(path, "store"))
    cfg_path = os.path.join(path, "config")
    cfg = Config.load(spark, cfg_path) if path_exists(spark, cfg_path) else None
    return store, cfg


def save_model(cont: DataFrame, store: DataFrame, path: str, cfg: Config, vectors: DataFrame | None = None,
               metrics: DataFrame | None = None, **options) -> None:
    """All that answers queries: the store, its continuations, the
    vectors of its patterns, config and metrics."""
    save_store(store, path, cfg, metrics, **options)
    cont.write.mode("overwrite").partitionBy("resolution").parquet(os.path.join(path, "continuations"))
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(os.path.join(path, "vectors"))


def load_model(spark: SparkSession, path: str) -> dict:
    """What ``save_model`` wrote: ``store``, ``continuations``, ``config``, and
    ``vectors`` and ``metrics`` (None where they were not saved)."""
    store, cfg = load_store(spark, path)
    part = lambda name: os.path.join(path, name)
    return {"store": store, "config": cfg, "continuations": spark.read.parquet(part("continuations")),
            "vectors": spark.read.parquet(part("vectors")) if path_exists(spark, part("vectors")) else None,
            "metrics": load_metrics(spark, part("metrics")) if path_exists(spark, part("metrics")) else None}


METRICS_SCHEMA = "run_id STRING, step BIGINT, name STRING, value DOUBLE"


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics table ``(run_id, step, name, value)`` as JSON."""
    metrics.write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def stream_table(spark: SparkSession, directory: str, schema: str,
                 max_files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """A streaming text source over a folder of files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .format(fmt).load(directory))
