"""What is done with kNN hits: distributions, attention, re-ranking,
retrieval metrics, and index maintenance.

Hits are ``(query_id, vec_id, score, rank)``; windows are keyed by
``query_id`` and hold at most k rows, so every per-query step is bounded
by the parameter k, not by the data.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import knn as K


def _wq():
    return Window.partitionBy("query_id")


def weighted_distribution(hl: DataFrame, token: str, score: str = "score", metric: str = "cosine") -> DataFrame:
    """``Σ weight per token / Σ weight``; queries with total <= 0 give none.
    Weights: cosine / dot as is, L2 as ``1 / (1 + d)`` (B10)."""
    w = F.col(score) if metric != "l2" else 1.0 / (1.0 - F.col(score))
    x = hl.withColumn("_w", w).withColumn("_tot", F.sum("_w").over(_wq())).filter(F.col("_tot") > 0)
    return x.groupBy("query_id", token).agg((F.sum("_w") / F.max("_tot")).alias("prob"))


def softmax_weights(h: DataFrame, score: str = "score", tau: float = 1.0, out: str = "wt") -> DataFrame:
    """F5 weights ``exp(s/τ) / Σ`` with max subtraction."""
    x = h.withColumn("_e", F.exp((F.col(score) - F.max(score).over(_wq())) / tau))
    return x.withColumn(out, F.col("_e") / F.sum("_e").over(_wq())).drop("_e")


def softmax_distribution(hl: DataFrame, token: str, score: str = "score", tau: float = 1.0) -> DataFrame:
    """kernel-weighted continuation distribution."""
    return softmax_weights(hl, score, tau).groupBy("query_id", token).agg(F.sum("wt").alias("prob"))


def attention(h: DataFrame, store: DataFrame, tau: float = 1.0) -> DataFrame:
    """retrieval as attention -- softmax-weighted mean of neighbour vectors,
    long form ``(query_id, dim, value)``."""
    w = softmax_weights(h, "score", tau).select("query_id", "vec_id", "wt")
    hit = w.join(store.select("vec_id", F.col("embedding").cast("array<double>").alias("_e")), "vec_id")
    return (hit.select("query_id", "wt", F.posexplode("_e").alias("dim", "x"))     # only what was hit is exploded
               .groupBy("query_id", "dim").agg(F.sum(F.col("wt") * F.col("x")).alias("value"))
               .withColumn("dim", F.col("dim").cast("bigint")))


def threshold(h: DataFrame, t: float, score: str = "score") -> DataFrame:
    """C4: keep hits with score >= t."""
    return h.filter(F.col(score) >= t)


def drop_subword(df: DataFrame, token: str = "token") -> DataFrame:
    """Drop continuations that are sub-word artefacts (start with ``##``)."""
    return df.filter(~F.col(token).startswith("##"))


def quality_vote(hl: DataFrame, token: str, length_col: str, min_sim: float = 0.1,
                 mult_col: str | None = None) -> DataFrame:
    """``Σ sim·(1 + min(len/5, 1)) / sqrt(votes)`` per continuation,
    after C4 (score >= min_sim) and C5.  ``mult_col`` lets one row stand for
    that many identical hits (a continuation count)."""
    x = drop_subword(threshold(hl, min_sim), token)
    m = F.col(mult_col) if mult_col else F.lit(1)
    w = F.col("score") * (1 + F.least(F.col(length_col) / 5.0, F.lit(1.0))) * m
    return x.groupBy("query_id", token).agg((F.sum(w) / F.sqrt(F.sum(m))).alias("vote"))


def coverage(h: DataFrame, t: float = 0.8) -> DataFrame:
    """k=1 coverage (share of top scores above t), mean top score and the
    proxy perplexity ``max(10, 100 (1 - coverage))``."""
    top = h.filter(F.col("rank") == 1)
    cov = F.avg(F.when(F.col("score") > t, 1.0).otherwise(0.0))
    return top.agg(cov.alias("coverage"), F.avg("score").alias("retrieval_quality"),
                   F.greatest(F.lit(10.0), 100.0 * (1.0 - cov)).alias("perplexity_proxy"))


def quality_at_k(h: DataFrame, ks: list[int], t: float = 0.7) -> DataFrame:
    """per k, mean top similarity and coverage (top similarity > t); one
    kNN at max k serves every k."""
    top = h.filter(F.col("rank") == 1).withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return top.groupBy("k").agg(F.avg("score").alias("avg_similarity"),
                                F.avg(F.when(F.col("score") > t, 1.0).otherwise(0.0)).alias("coverage_rate"))


def hit_summary(hl: DataFrame, token: str) -> DataFrame:
    """hits, mean similarity and distinct continuations per query."""
    return hl.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.avg("score").alias("mean_similarity"),
                                      F.count_distinct(token).alias("distinct_continuations"))


def retrieval_energy(h: DataFrame, queries: DataFrame) -> DataFrame:
    """``clip(std(scores) / (max + 1e-6), 0, 1)``; 1.0 without hits."""
    a = h.groupBy("query_id").agg(F.stddev_pop("score").alias("_sd"), F.max("score").alias("_mx"))
    e = F.when(F.col("_mx").isNull(), F.lit(1.0)).otherwise(
        F.least(F.greatest(F.col("_sd") / (F.col("_mx") + 1e-6), F.lit(0.0)), F.lit(1.0)))
    return queries.join(a, "query_id", "left").select("query_id", e.alias("energy"))


def bayes_weights(hl: DataFrame, prior: DataFrame, token: str, kappa: float) -> DataFrame:
    """frequency prior x ``exp(κ·score)``, normalised per query (a softmax of
    ``κ·score + ln(cnt)``); the prior table is joined on the continuation."""
    x = hl.join(prior, token).withColumn("_z", kappa * F.col("score") + F.ln("cnt"))
    return softmax_weights(x, "_z", 1.0, "weight").drop("_z")


def size_estimate(e: DataFrame, m: int = 8, bits: int = 8) -> DataFrame:
    """bytes of vectors (float32), +100 B metadata per row, +20 %; PQ code
    bytes ``m·bits/8`` per row; compression ratio ``32·d / (m·bits)``."""
    sz = F.size("embedding")
    return e.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(sz).cast("bigint").alias("dim"),
                 (F.sum(sz) * 4).cast("bigint").alias("vector_bytes"),
                 F.round((F.sum(sz) * 4 + 100 * F.count(F.lit(1))) * 1.2, 1).alias("estimated_bytes"),
                 (F.count(F.lit(1)) * m * bits / 8).cast("bigint").alias("pq_bytes"),
                 F.round(32.0 * F.max(sz) / (m * bits), 6).alias("compression_ratio"))


def mean_pairwise_distance(h: DataFrame, store: DataFrame) -> DataFrame:
    """Per candidate, mean L2 distance to the query's candidates (itself
    included at 0).  A query has at most k candidates, so they are gathered
    into an array and compared with array functions; other columns of ``h``
    are kept."""
    x = h.join(store.select("vec_id", F.col("embedding").cast("array<double>").alias("_e")), "vec_id")
    row = F.struct(*h.columns, "_e")
    g = x.groupBy("query_id").agg(F.collect_list(row).alias("_c"))

    def distance(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d))

    def mean_to_all(c):
        total = F.aggregate("_c", F.lit(0.0), lambda s, o: s + distance(c["_e"], o["_e"]))
        return F.struct(*[c[n].alias(n) for n in h.columns], (total / F.size("_c")).alias("mean_dist"))

    return g.select(F.inline(F.transform("_c", mean_to_all)))


def energy_rerank(hl: DataFrame, store: DataFrame, keep: int = 10, w_sim: float = 1.0,
                  w_div: float = 0.5, w_freq: float = 0.3, freq_col: str = "freq") -> DataFrame:
    """``-w_sim·sim - w_div·mean pairwise distance - w_freq·ln(freq + 1e-6)``,
    ascending, keep ``keep`` per query.  The frequency rides along through the
    distance step, so the search runs once."""
    x = mean_pairwise_distance(hl.select("query_id", "vec_id", "score", freq_col), store)
    en = -w_sim * F.col("score") - w_div * F.col("mean_dist") - w_freq * F.ln(F.col(freq_col) + 1e-6)
    x = x.withColumn("energy", en)
    w = _wq().orderBy(F.round("energy", 12), F.asc("vec_id"))
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def novelty_gate(new: DataFrame, store: DataFrame, theta: float, metric: str = "cosine") -> DataFrame:
    """New vectors whose nearest stored neighbour scores below ``theta``
    (i.e. lies farther away) -- the rows to insert."""
    h = K.knn_exact(new, store, 1, metric).select("query_id", F.col("score").alias("nearest"))
    x = new.join(h, "query_id", "left")
    return x.filter(F.col("nearest").isNull() | (F.col("nearest") < theta))


def evict_least_used(store_ids: DataFrame, hit_ids: DataFrame, capacity: int) -> DataFrame:
    """usage = times retrieved; keep the ``capacity`` most used (ties by id)."""
    use = hit_ids.groupBy("vec_id").agg(F.count(F.lit(1)).alias("usage"))
    x = store_ids.join(use, "vec_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)).cast("bigint"))
    # rank by a distributed dense index, not a single-task global limit:
    # the capacity (max_index_size) can be millions of rows
    from tessera.operators.corpus import grouped_index
    ranked = grouped_index(x, [], [F.desc("usage"), F.asc("vec_id")], "_r")
    return ranked.filter(F.col("_r") < capacity).drop("_r")


def pca(e: DataFrame, k: int) -> DataFrame:
    """MLlib PCA to k dims, with the explained variance per component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(v)
    ev = [float(x) for x in model.explainedVariance]
    return (model.transform(v).select("vec_id", vector_to_array("pc").alias("pc"))
            .withColumn("explained_variance", F.array(*[F.lit(x) for x in ev])))


def random_fourier_features(e: DataFrame, n_features: int = 16, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """``z(x) = sqrt(2/D) cos(ω·x + b)`` approximating the Gaussian kernel
    ``exp(-γ||x-y||²)``: ω ~ N(0, 2γ) by Box-Muller and b ~ U[0, 2π) from
    seeded hashes.  The (D x dim) weights are literals of the plan, so each
    vector becomes its features in one row, without a shuffle."""
    def uniform(*parts) -> float:
        return (int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32

    dim = len(e.select("embedding").first()[0])
    scale = math.sqrt(2.0 * gamma)
    omega = [[math.sqrt(-2.0 * math.log(uniform("w1", i, j))) * math.cos(2 * math.pi * uniform("w2", i, j)) * scale
              for i in range(dim)] for j in range(n_features)]
    rows = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(2 * math.pi * uniform("b", j)).alias("b")) for j, w in enumerate(omega)])
    x = F.col("embedding").cast("array<double>")
    phase = lambda r: F.aggregate(F.zip_with(r["w"], x, lambda w, v: w * v), F.lit(0.0), lambda s, p: s + p) + r["b"]
    return e.select("vec_id", F.transform(rows, lambda r: math.sqrt(2.0 / n_features) * F.cos(phase(r))).alias("features"))


def vote_predictions(hl: DataFrame, token: str, ks: list[int]) -> DataFrame:
    """Score-weighted vote of the top-k hits for every k in ``ks``:
    ``(query_id, k, pred)``, ties to the smallest token."""
    x = hl.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    v = x.groupBy("query_id", "k", token).agg(F.sum("score").alias("_v"))
    return v.groupBy("query_id", "k").agg(F.min_by(token, F.struct(-F.col("_v"), F.col(token))).alias("pred"))


def energy_bin(energy, bins: int = 10):
    return F.least(F.floor(energy * bins), F.lit(bins - 1)).cast("int")


def strategy_table(hl: DataFrame, queries: DataFrame, token: str, truth: str, ks: list[int],
                   bins: int = 10) -> DataFrame:
    """mean reward (prediction == truth) per (energy bin, k) and the best
    k per bin (ties to the smaller k)."""
    e = retrieval_energy(hl, queries.select("query_id")).withColumn("bin", energy_bin(F.col("energy"), bins))
    pred = vote_predictions(hl, token, ks)
    r = (pred.join(queries.select("query_id", truth), "query_id").join(e.select("query_id", "bin"), "query_id")
             .withColumn("reward", (F.col("pred") == F.col(truth)).cast("double")))
    m = r.groupBy("bin", "k").agg(F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("bin").agg(F.min_by("k", F.struct(-F.col("mean_reward"), F.col("k"))).alias("best_k"),
                                F.max("mean_reward").alias("best_reward"))


def adaptive_k(hl: DataFrame, queries: DataFrame, table: DataFrame, default_k: int, bins: int = 10) -> DataFrame:
    """Per-query k from its energy bin (strategy table), hits cut to rank <= k_q."""
    e = retrieval_energy(hl, queries.select("query_id")).withColumn("bin", energy_bin(F.col("energy"), bins))
    kq = e.join(table.select("bin", "best_k"), "bin", "left").select(
        "query_id", F.coalesce("best_k", F.lit(default_k)).alias("k_q"))
    return hl.join(kq, "query_id").filter(F.col("rank") <= F.col("k_q"))


def position_rerank(hits: DataFrame, qpos: DataFrame, spos: DataFrame, keep: int, lam: float = 0.3,
                    length: float = 1.0) -> DataFrame:
    """``(1-λ)·score + λ·exp(-|q_pos - s_pos| / L)`` over the 2k fetched
    hits (score = -squared distance), keep ``keep`` per query."""
    x = hits.join(qpos, "query_id").join(spos, "vec_id")
    ps = F.exp(-F.abs(F.col("qpos") - F.col("spos")) / length)
    x = x.withColumn("rescored", (1 - lam) * F.col("score") + lam * ps)
    w = _wq().orderBy(F.desc(F.round("rescored", 12)), F.asc("vec_id"))
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
