"""Next tokens by vector retrieval: embed the stored patterns and the contexts
with the same embedder, find each context's nearest patterns, and let them
vote with their continuations (B12, B13, E5, F4, B15, K1).

An embedder is a function from a column of tokens (ARRAY<STRING>) to a column
of vectors.  ``hashed(dim)`` is the built-in one; ``batch_model`` wraps a
function that embeds a batch of texts with any library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import corpus as C
from tessera.operators import dist as D
from tessera.operators import knn as K
from tessera.operators import retrieval as RT
from tessera.session import checkpoint_dir

Embedder = Callable[[Column], Column]


def hashed(dim: int) -> Embedder:
    """Signed feature hashing of the tokens (``vectors.bucket_of`` and
    ``sign_of``), of length one (all zero where signs cancel out or there is no
    token).  Each distinct token of a batch is hashed once."""
    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
        place = np.array([int(d[:8], 16) % dim for d in digests], np.int64)
        sign = np.array([1.0 if int(d[8], 16) < 8 else -1.0 for d in digests])
        at, row = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        row, at = row[at >= 0], at[at >= 0]
        x = np.bincount(row * dim + place[at], sign[at], len(sizes) * dim).astype(np.float64).reshape(-1, dim)      # of integers if empty
        n = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))
    return lambda tokens: vectors(tokens)


def batch_model(make_predict: Callable, dim: int, batch_size: int = 256) -> Embedder:
    """An embedder around any batch model: ``make_predict()`` runs once per
    worker and returns a function from an array of texts to a matrix."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    udf = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return lambda tokens: udf(F.array_join(tokens, " "))


def embed_store(store: DataFrame, embed: Embedder) -> DataFrame:
    """(vec_id, pattern, embedding): ids are dense, in the order of the patterns."""
    ids = C.grouped_index(store.select("pattern"), [], [F.col("pattern")], "vec_id", start=1)
    return ids.select("vec_id", "pattern", embed(F.split("pattern", " ")).alias("embedding"))


def next_tokens(contexts: DataFrame, vectors: DataFrame, cont: DataFrame, store: DataFrame, embed: Embedder,
                k: int = 10, temperature: float = 1.0, key: str = "query_id") -> DataFrame:
    """(query_id, token, prob) for ``contexts`` (query_id, tokens).

    A neighbour of positive similarity votes with similarity x the share of
    each of its continuations; votes are normalised and tempered.  Contexts
    without such a neighbour have no rows.  ``cont`` may be a function that
    returns the continuations and store rows of the neighbours' patterns
    (``store`` is then None)."""
    q = contexts.select(F.col(key).alias("query_id"), embed(F.col("tokens")).alias("qvec"))
    hits = RT.threshold(K.knn_exact(q, vectors, k), 1e-12)
    hl = K.attach_payload(hits, vectors, ["pattern"])
    if callable(cont):
        checkpoint_dir(hl.sparkSession)
        hl = hl.checkpoint()
        cont, store = cont(hl)
    shares = cont.select("pattern", F.col("next").alias("token"), "cnt").join(
        store.select("pattern", F.col("cnt").alias("total")), "pattern")
    votes = hl.join(shares, "pattern").withColumn("vote", F.col("score") * F.col("cnt") / F.col("total"))
    dist = votes.groupBy("query_id", "token").agg(F.sum("vote").alias("prob"))
    dist = D.renormalize(dist, ["query_id"])
    return dist if temperature == 1.0 else D.temperature(dist, ["query_id"], temperature)
