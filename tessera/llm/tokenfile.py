"""Token-ID files (1): ids of whole documents in ascending id order.

A token file is a Parquet folder whose rows are frames.  A frame holds whole
documents: their ids and lengths as a directory, and one binary value made by
``rangecoder.pack`` (independently reset, checksummed blocks).  Spark's own
writer commits the files, so a lost executor leaves no half-written frame and
any file system that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import rangecoder
from tessera.llm.common import text_batches
from tessera.llm.tokens import broadcast_file, encoder

#: Ids of a frame, reached by whole documents: what one task holds in memory.
FRAME_IDS = 4 << 20
FRAME_SCHEMA = ("part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, frame binary")
OUT_BYTES = 8 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None, frame_ids: int = FRAME_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write a token file.

    Documents are range partitioned and sorted by id (equal ids by text; null
    ids first), so the frames in (part, seq) order hold them in ascending
    order.  Null texts count as empty: their only id is ``end_id``.  Ids must
    fit 16 bits.  Only the id and the text are read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blob = broadcast_file(spark, tokenizer)
    end = np.array([end_id], "<u2").tobytes()

    def frame(part, seq, ids, coded):
        lengths = [len(c) // 2 for c in coded]
        flat = np.frombuffer(b"".join(coded), "<u2")
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([rangecoder.pack(flat)], pa.binary())],
            names=["part", "seq", "n_ids", "doc_ids", "lengths", "frame"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, coded, size = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(blob.value, lengths_only=False)
        for b in text_batches(batches, "text", 2 << 20):
            for i, c in zip(b.column("id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids.append(i)
                coded.append(c + end)
                size += len(c) // 2 + 1
                if size >= frame_ids:
                    yield frame(part, seq, ids, coded)
                    seq, ids, coded, size = seq + 1, [], [], 0
        if ids:
            yield frame(part, seq, ids, coded)

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
         .repartitionByRange(n, "id").sortWithinPartitions("id", "text")
         .mapInArrow(write, FRAME_SCHEMA).write.parquet(path))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read a token file back: one row per document with its id, ``start``
    (ids of all documents before it), ``n_tokens`` and ``ids`` (binary,
    little-endian unsigned 32-bit).  A frame with a wrong checksum raises."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r] for n in ("part", "seq", "doc_ids", "lengths", "frame")}
                flat = rangecoder.unpack(row["frame"].as_py())
                docs, lengths = row["doc_ids"].as_py(), np.array(row["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + OUT_BYTES // 4, side="right")))
                    raw = [flat[s:e].astype("<u4").tobytes() for s, e in zip(starts[at:to], ends[at:to])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["part"].as_py()] * (to - at), pa.int32()),
                        pa.array([row["seq"].as_py()] * (to - at), pa.int32()),
                        pa.array(docs[at:to], pa.int64()), pa.array(starts[at:to]), pa.array(lengths[at:to]),
                        pa.array(raw, pa.binary())], names=["part", "seq", "id", "at", "n_tokens", "ids"])
                    at = to

    rows = frames.mapInArrow(read, "part int, seq int, id long, at long, n_tokens long, ids binary")
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))     # as many rows as tasks wrote
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = (frames.select("part", "seq", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inside"))
                    .join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first")))
    return (rows.join(starts, ["part", "seq"])
                .select(F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids"))
