"""Observed progress of builds (L4), without a job of its own.

``observed`` adds named sums to a DataFrame; Spark fills them in while the one
job that writes it runs.  A batch job reads them from an ``Observation``, a
stream from the progress of each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.functions import text as T

ROW = "batch_id BIGINT, docs BIGINT, chars BIGINT, words BIGINT"


def text_sums(text_col: str = "text") -> list[Column]:
    """Documents, characters and words so far; null texts have neither."""
    return [F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"),
            F.coalesce(F.sum(T.n_words(text_col)), F.lit(0)).alias("words")]


def write_observed(df: DataFrame, path: str, sums: list[Column], mode: str = "error") -> dict:
    """Write ``df`` as Parquet; returns the sums over what was written."""
    seen = Observation()
    df.observe(seen, *sums).write.mode(mode).parquet(path)
    return seen.get


def observed(stream: DataFrame, name: str, sums: list[Column]) -> DataFrame:
    """``stream`` whose batches report ``sums`` under ``name`` in their progress."""
    return stream.observe(name, *sums)


class ProgressLog(StreamingQueryListener):
    """Rows of one observation, collected while queries run (a query itself
    only remembers its latest batches)."""

    def __init__(self, name: str):
        self.name, self.rows = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        sums = event.progress.observedMetrics.get(self.name)
        if sums is not None and event.progress.numInputRows:
            self.rows[str(event.progress.id), event.progress.batchId] = sums.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch_id, docs, chars, words); a batch that ran again counts once."""
        return spark.createDataFrame([(b, int(s["docs"]), int(s["chars"]), int(s["words"])) for (_, b), s in sorted(self.rows.items())], ROW)


def recent(query, name: str, spark: SparkSession) -> DataFrame:
    """The same rows from the progress that a query still remembers."""
    rows = {}
    for p in query.recentProgress:
        sums = (p["observedMetrics"] or {}).get(name)
        if sums is not None and p["numInputRows"]:
            s = sums.asDict() if hasattr(sums, "asDict") else dict(sums)
            rows[p["batchId"]] = (p["batchId"], int(s["docs"]), int(s["chars"]), int(s["words"]))
    return spark.createDataFrame([rows[b] for b in sorted(rows)], ROW)
