"""Decayed counter with keyed state.

One state row per key and salt: the decayed weight ``Σ exp(-λ (last - t))``,
the time of the latest event and the number of events.  A micro-batch folds a
key's rows into that row with array arithmetic, in any order of events.  A
key's events are dealt to ``salts`` state rows by a hash of a second column,
so a key with a third of all events is worked on by several tasks; the reader
adds the rows up.

Rows expire, so state follows the live keys and not the stream: a key without
events for ``idle_hours`` of event time is cleared by a timer once the
watermark has passed (``expire="event"``), or after ``idle_hours`` of
processing time by the state's time to live (``expire="ttl"``, which needs no
watermark; Spark then goes on with batches for as long as state may expire,
so such a query runs until it is stopped).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
           "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
OUT = "key STRING, salt INT, weight DOUBLE, last DOUBLE, events BIGINT, live BOOLEAN"
STATE = "weight DOUBLE, last DOUBLE, events BIGINT"


def _folding():
    def fold(state: tuple | None, t: np.ndarray, lam: float) -> tuple[float, float, int]:
        """(weight, last, events) after events at the hours ``t``."""
        weight, last, events = state or (0.0, -np.inf, 0)
        now = max(last, float(t.max()))
        kept = weight * np.exp(-lam * (now - last)) if events else 0.0
        return float(kept + np.exp(-lam * (now - t)).sum()), now, int(events) + len(t)
    return fold


#: Functions and classes made in a function travel by value: the worker that
#: sets up the state on the driver need not be able to import this package.
fold = _folding()


def _processor(lam: float, idle: float, expire: str) -> StatefulProcessor:
    step, state_type = _folding(), STATE

    class Decay(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            ttl = {"ttlDurationMs": int(idle * 3.6e6)} if expire == "ttl" else {}
            self.state = handle.getValueState("decay", state_type, **ttl)

        def _row(self, key, values, live: bool):
            return pd.DataFrame({"key": [key[0]], "salt": [np.int32(key[1])], "weight": [values[0]], "last": [values[1]],
                                 "events": [values[2]], "live": [live]})

        def handleInputRows(self, key, rows, timerValues):
            t = np.concatenate([pdf["t"].to_numpy(dtype=float) for pdf in rows])
            values = step(self.state.get() if self.state.exists() else None, t, lam)
            self.state.update(values)
            if expire == "event":
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(int((values[1] + idle) * 3.6e6))
            yield self._row(key, values, True)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                values = self.state.get()
                self.state.clear()
                yield self._row(key, values, False)

        def close(self) -> None:
            pass

    return Decay()


def decayed_counter(events: DataFrame, key: str, ts: str, lam_per_hour: float, spread_by: str | None = None, salts: int = 8,
                    idle_hours: float = 24 * 30, expire: str = "event", watermark: str = "30 days") -> DataFrame:
    """Stream of the state rows that each batch has changed: key, salt,
    weight, last (hours since the epoch), events, live (false: expired).

    ``spread_by`` deals a key's events to ``salts`` rows; without it there is
    one row a key.  Events later than ``watermark`` are dropped.  The session
    needs ``use_rocksdb``."""
    if expire not in ("ttl", "event"):
        raise ValueError(f"unknown expiry {expire}")
    when = F.col(ts).cast("timestamp")
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)) if spread_by else F.lit(0)
    x = events.select(F.col(key).cast("string").alias("key"), salt.cast("int").alias("salt"), when.alias("when"),
                      (F.unix_micros(when) / 3.6e9).alias("t")).filter("t IS NOT NULL")
    if expire == "event":
        x = x.withWatermark("when", watermark)
    mode = "EventTime" if expire == "event" else "ProcessingTime"
    return x.groupBy("key", "salt").transformWithStateInPandas(_processor(lam_per_hour, idle_hours, expire), OUT, "Update", mode)


def use_rocksdb(spark: SparkSession) -> dict:
    """Set the state store the counter needs; returns the settings before."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    return old


def restore(spark: SparkSession, old: dict) -> None:
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counter_values(changes: DataFrame, lam_per_hour: float) -> DataFrame:
    """Per key: ``Σ exp(-λ (t_last - t_i))`` and the number of events, from the
    newest state row of every salt.  ``changes`` has the rows of the stream
    with the ``batch_id`` that wrote them."""
    newest = changes.groupBy("key", "salt").agg(F.max_by(F.struct("weight", "last", "events", "live"), "batch_id").alias("s"))
    rows = newest.filter("s.live").select("key", "s.weight", "s.last", "s.events")
    top = rows.groupBy("key").agg(F.max("last").alias("top"))
    return rows.join(top, "key").groupBy("key").agg(
        F.sum(F.col("weight") * F.exp(-lam_per_hour * (F.col("top") - F.col("last")))).alias("weight"),
        F.sum("events").alias("events"))


def run_counter(stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """Write the changed rows of each batch to ``batch_id=N``; with
    ``available_now`` until all that is there is read.  A batch that runs again
    overwrites itself; started again with the same ``checkpoint``, the state
    goes on."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))
    w = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()
