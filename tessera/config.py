"""Typed configuration with validation; round-trips through a one-row table."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

METRICS = ("cosine", "dot", "l2")
TOKENIZERS = ("ws", "word")


def _weights_fit(c) -> bool:
    w = c.resolution_weights
    return w is None or (len(w) == len(c.resolutions) and math.isclose(sum(w), 1.0, abs_tol=1e-6))


#: What a valid configuration fulfils: (field, test, what it must be).
RULES = [
    ("resolutions", lambda c: bool(c.resolutions) and min(map(int, c.resolutions)) >= 1, "one window length or more, each from 1"),
    ("resolution_weights", _weights_fit, "one weight per window length, together 1"),
    *[(name, lambda c, n=name: getattr(c, n) >= 1, "1 or more")
      for name in ("pattern_stride", "min_pattern_frequency", "embedding_dim", "retrieval_k", "beam_size", "pq_m", "pq_ks", "max_index_size")],
    *[(name, lambda c, n=name: getattr(c, n) is None or getattr(c, n) >= 1, "unset, or 1 or more") for name in ("nlist", "nprobe")],
    *[(name, lambda c, n=name: getattr(c, n) >= 0, "0 or more") for name in ("positional_encoding_dim", "temperature", "top_k")],
    ("top_p", lambda c: 0 < c.top_p <= 1, "a share above 0, at most 1"),
    ("repetition_penalty", lambda c: c.repetition_penalty > 0, "above 0"),
    ("tokenizer", lambda c: c.tokenizer in TOKENIZERS, f"one of {TOKENIZERS}"),
    ("similarity_metric", lambda c: c.similarity_metric in METRICS, f"one of {METRICS}"),
]


@dataclass(frozen=True)
class Config:
    # pattern extraction
    resolutions: tuple = (1, 2, 3, 5, 8)
    pattern_stride: int = 1
    min_pattern_frequency: int = 2
    lowercase: bool = True
    tokenizer: str = "ws"
    resolution_weights: tuple | None = None
    # vectors
    embedding_dim: int = 64
    positional_encoding_dim: int = 0
    normalize_embeddings: bool = True
    similarity_metric: str = "cosine"
    # retrieval
    retrieval_k: int = 10
    nlist: int | None = None
    nprobe: int | None = None
    pq_m: int = 8
    pq_ks: int = 256
    max_index_size: int = 10_000_000
    # generation
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 0.95
    repetition_penalty: float = 1.2
    max_generation_length: int = 20
    beam_size: int = 1
    length_penalty: float = 1.0
    seed: int = 42

    def validate(self) -> "Config":
        """Raise ``ValueError`` naming every field whose value is out of range."""
        wrong = [f"{name} = {getattr(self, name)!r}: {what}" for name, holds, what in RULES if not holds(self)]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def replace(self, **kw) -> "Config":
        return dataclasses.replace(self, **kw)

    def to_dict(self) -> dict:
        d = dataclasses.asdict(self)
        return {k: list(v) if isinstance(v, tuple) else v for k, v in d.items()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, d: dict) -> "Config":
        names = {f.name for f in dataclasses.fields(cls)}
        kw = {k: (tuple(v) if isinstance(v, list) else v) for k, v in d.items() if k in names}
        return cls(**kw).validate()

    @classmethod
    def from_json(cls, s: str) -> "Config":
        return cls.from_dict(json.loads(s))

    # Config as a one-row table (written next to the store it describes)
    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.to_json(),)], "config STRING")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Config":
        row = spark.read.schema("config STRING").json(path).first()
        return cls.from_json(row["config"])


DEFAULT = Config()
