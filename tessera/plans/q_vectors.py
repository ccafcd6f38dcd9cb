"""Queries for vector functions, kNN joins and retrieval metrics.

Evaluation setup on ``embeddings``: an exact seeded 80/10/10 split of
``vec_id``; the train part is the store, validation + test are queries, and
``label`` is the payload (the continuation a hit votes for).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import vectors as V
from tessera.operators import corpus as C
from tessera.operators import heads as H
from tessera.operators import knn as K
from tessera.operators import retrieval as RT
from tessera.operators import vector_index as VI
from tessera.plans.catalog import register
from tessera.session import checkpoint_dir, load_table, scratch_path

SEED = 42
K10 = 10
R6 = 6


def emb(spark, sf):
    return load_table(spark, sf, "embeddings")


def split_sets(spark, sf):
    e = emb(spark, sf)
    sp = C.ratio_split(e.select("vec_id"), SEED, "vec_id")
    store = e.join(sp.filter("split = 'train'"), "vec_id", "left_semi")
    qs = (e.join(sp.filter("split <> 'train'"), "vec_id", "left_semi")
           .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel")))
    return store, qs


def hits10(spark, sf, k=K10):
    store, qs = split_sets(spark, sf)
    return K.knn_exact(qs, store, k), store, qs


def r6(df, *cols):
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


# --------------------------------------------------------------- SQL pieces

ESPLIT = (f"sp AS (SELECT vec_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) "
          f"THEN 'validation' ELSE 'test' END AS split FROM (SELECT vec_id, row_number() OVER (ORDER BY "
          f"md5('{SEED}|' || vec_id::VARCHAR), vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings))")
ELONG = ("el AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), "
         "nr AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM el GROUP BY 1)")
SCORES = ("sc AS (SELECT q.vec_id AS query_id, s.vec_id, round(CASE WHEN any_value(nq.nrm) = 0 OR any_value(ns.nrm) = 0 "
          "THEN 0 ELSE sum(q.x * s.x) / (any_value(nq.nrm) * any_value(ns.nrm)) END, 12) AS score "
          "FROM el q JOIN sp spq ON spq.vec_id = q.vec_id AND spq.split <> 'train' "
          "JOIN el s ON s.i = q.i JOIN sp sps ON sps.vec_id = s.vec_id AND sps.split = 'train' "
          "JOIN nr nq ON nq.vec_id = q.vec_id JOIN nr ns ON ns.vec_id = s.vec_id GROUP BY 1, 2)")


def hits_sql(k: int) -> str:
    return (f"hits AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= {k})")


VBASE = f"WITH {ESPLIT}, {ELONG}, {SCORES}, {hits_sql(K10)}"
LAB = "hl AS (SELECT h.*, e.label FROM hits h JOIN embeddings e USING (vec_id))"


# ------------------------------------------------------------- B: vectors

@register("vec_normalize",
          f"WITH {ELONG} SELECT vec_id, round(nrm, {R6}) AS norm_before, "
          f"round((SELECT sum(x / CASE WHEN nrm = 0 THEN 1 ELSE nrm END) FROM el WHERE el.vec_id = nr.vec_id), {R6}) AS sum_after FROM nr")
def q_vec_normalize(spark, sf):
    e = emb(spark, sf)
    n = V.l2_normalize("embedding")
    return e.select("vec_id", F.round(V.norm2("embedding"), R6).alias("norm_before"),
                    F.round(F.aggregate(n, F.lit(0.0), lambda s, v: s + v), R6).alias("sum_after"))


@register("vec_similarity",
          f"WITH {ELONG}, d AS (SELECT a.vec_id, sum(a.x * b.x) AS dp, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM el a "
          f"JOIN el b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY 1) "
          f"SELECT d.vec_id, round(dp, {R6}) AS dot, round(dp / (na.nrm * nb.nrm), {R6}) AS cosine, round(-d2, {R6}) AS neg_l2, "
          f"round(1.0 / (1.0 + d2), {R6}) AS l2_weight FROM d JOIN nr na ON na.vec_id = d.vec_id JOIN nr nb ON nb.vec_id = d.vec_id + 1")
def q_vec_similarity(spark, sf):
    e = emb(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    x = e.join(b, "vec_id")
    return r6(x.select("vec_id", V.dot("embedding", "b").alias("dot"), V.cosine("embedding", "b").alias("cosine"),
                       V.neg_l2("embedding", "b").alias("neg_l2"),
                       V.distance_weight(V.neg_l2("embedding", "b"), "l2").alias("l2_weight")),
              "dot", "cosine", "neg_l2", "l2_weight")


@register("int8_quantize",
          f"WITH {ELONG}, sc8 AS (SELECT vec_id, CASE WHEN max(abs(x)) = 0 THEN 1.0 ELSE max(abs(x)) / 127.0 END AS scale "
          f"FROM el GROUP BY 1) SELECT vec_id, round(any_value(scale), 9) AS scale, sum(round(x / scale))::BIGINT AS q_sum, "
          f"round(max(abs(round(x / scale) * scale - x)), 9) AS max_err FROM el JOIN sc8 USING (vec_id) GROUP BY 1")
def q_int8_quantize(spark, sf):
    e = emb(spark, sf).withColumn("scale", V.int8_scale("embedding"))
    e = e.withColumn("q", V.int8_quantize("embedding", "scale"))
    deq = V.int8_dequantize("q", "scale")
    err = F.array_max(F.zip_with(deq, V.dvec("embedding"), lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.round("scale", 9).alias("scale"),
                    F.aggregate("q", F.lit(0).cast("bigint"), lambda s, v: s + v.cast("bigint")).alias("q_sum"),
                    F.round(err, 9).alias("max_err"))


# ------------------------------------------------------------------ E5 ...

@register("knn_exact", f"{VBASE} SELECT query_id, vec_id, round(score, {R6}) AS score, rank FROM hits")
def q_knn_exact(spark, sf):
    h = hits10(spark, sf)[0]
    return h.select("query_id", "vec_id", F.round("score", R6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("knn_distribution",
          f"{VBASE}, {LAB}, t AS (SELECT query_id, sum(score) AS tot FROM hl GROUP BY 1) "
          f"SELECT query_id, label, round(sum(score) / any_value(tot), {R6}) AS prob FROM hl JOIN t USING (query_id) "
          f"WHERE tot > 0 GROUP BY 1, 2")
def q_knn_distribution(spark, sf):
    h, store, _ = hits10(spark, sf)
    hl = K.attach_payload(h, store, ["label"])
    return r6(RT.weighted_distribution(hl, "label", "score"), "prob")


@register("knn_softmax_distribution",
          f"{VBASE}, {LAB}, w AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.1) AS ex FROM hl), "
          f"w2 AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id) AS wt FROM w) "
          f"SELECT query_id, label, round(sum(wt), {R6}) AS prob FROM w2 GROUP BY 1, 2")
def q_knn_softmax_distribution(spark, sf):
    h, store, _ = hits10(spark, sf)
    hl = K.attach_payload(h, store, ["label"])
    return r6(RT.softmax_distribution(hl, "label", "score", 0.1), "prob")


@register("knn_attention",
          f"{VBASE}, w AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.1) AS ex FROM hits), "
          f"w2 AS (SELECT query_id, vec_id, ex / sum(ex) OVER (PARTITION BY query_id) AS wt FROM w) "
          f"SELECT query_id, i AS dim, round(sum(wt * x), {R6}) AS value FROM w2 JOIN el USING (vec_id) GROUP BY 1, 2")
def q_knn_attention(spark, sf):
    h, store, _ = hits10(spark, sf)
    return r6(RT.attention(h, store, 0.1), "value")


@register("hits_threshold",
          f"{VBASE} SELECT query_id, count(*) AS n_hits FROM hits WHERE score >= 0.1 GROUP BY 1")
def q_hits_threshold(spark, sf):
    h = hits10(spark, sf)[0]
    return RT.threshold(h, 0.1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))


@register("coverage",
          f"{VBASE} SELECT round(avg(CASE WHEN score > 0.8 THEN 1.0 ELSE 0.0 END), {R6}) AS coverage, "
          f"round(avg(score), {R6}) AS retrieval_quality, "
          f"round(greatest(10.0, 100.0 * (1.0 - avg(CASE WHEN score > 0.8 THEN 1.0 ELSE 0.0 END))), {R6}) AS perplexity_proxy "
          f"FROM hits WHERE rank = 1")
def q_coverage(spark, sf):
    h = hits10(spark, sf, 1)[0]
    return r6(RT.coverage(h, 0.8), "coverage", "retrieval_quality", "perplexity_proxy")


@register("retrieval_quality",
          f"WITH {ESPLIT}, {ELONG}, {SCORES}, {hits_sql(50)}, ks AS (SELECT * FROM (VALUES (1),(5),(10),(20),(50)) v(k)) "
          f"SELECT k, round(avg(score), {R6}) AS avg_similarity, round(avg(CASE WHEN score > 0.7 THEN 1.0 ELSE 0.0 END), {R6}) "
          f"AS coverage_rate FROM hits, ks WHERE rank = 1 GROUP BY k")
def q_retrieval_quality(spark, sf):
    h = hits10(spark, sf, 50)[0]
    return r6(RT.quality_at_k(h, [1, 5, 10, 20, 50], 0.7), "avg_similarity", "coverage_rate")


@register("hit_summary",
          f"{VBASE}, {LAB} SELECT query_id, count(*) AS hits, round(avg(score), {R6}) AS mean_similarity, "
          f"count(DISTINCT label) AS distinct_continuations FROM hl GROUP BY 1")
def q_hit_summary(spark, sf):
    h, store, _ = hits10(spark, sf)
    return r6(RT.hit_summary(K.attach_payload(h, store, ["label"]), "label"), "mean_similarity")


@register("retrieval_energy",
          f"{VBASE}, q AS (SELECT vec_id AS query_id FROM sp WHERE split <> 'train'), "
          f"a AS (SELECT query_id, stddev_pop(score) AS sd, max(score) AS mx FROM hits GROUP BY 1) "
          f"SELECT q.query_id, round(CASE WHEN a.mx IS NULL THEN 1.0 ELSE least(greatest(a.sd / (a.mx + 1e-6), 0.0), 1.0) END, {R6}) "
          f"AS energy FROM q LEFT JOIN a USING (query_id)")
def q_retrieval_energy(spark, sf):
    h, _, qs = hits10(spark, sf)
    return r6(RT.retrieval_energy(h, qs.select("query_id")), "energy")


@register("bayes_weighted",
          f"{VBASE}, {LAB}, lc AS (SELECT label, count(*) AS cnt FROM embeddings e JOIN sp USING (vec_id) "
          f"WHERE split = 'train' GROUP BY 1), z AS (SELECT hl.*, 10.0 * score + ln(cnt) AS z FROM hl JOIN lc USING (label)), "
          f"w AS (SELECT *, exp(z - max(z) OVER (PARTITION BY query_id)) AS ex FROM z) "
          f"SELECT query_id, vec_id, round(ex / sum(ex) OVER (PARTITION BY query_id), {R6}) AS weight FROM w")
def q_bayes_weighted(spark, sf):
    h, store, _ = hits10(spark, sf)
    hl = K.attach_payload(h, store, ["label"])
    prior = store.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return r6(RT.bayes_weights(hl, prior, "label", 10.0).select("query_id", "vec_id", "weight"), "weight")


@register("index_size_estimate",
          f"SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, "
          f"(sum(len(embedding)) * 4)::BIGINT AS vector_bytes, "
          f"round((sum(len(embedding)) * 4 + 100 * count(*)) * 1.2, 1) AS estimated_bytes, "
          f"(count(*) * 8 * 8 / 8)::BIGINT AS pq_bytes, "
          f"round(32.0 * max(len(embedding)) / (8 * 8), {R6}) AS compression_ratio FROM embeddings")
def q_index_size_estimate(spark, sf):
    return RT.size_estimate(emb(spark, sf), m=8, bits=8)


@register("shard_totals",
          "SELECT vec_id // 100 AS shard, count(*) AS n_vectors FROM embeddings GROUP BY ROLLUP (vec_id // 100)")
def q_shard_totals(spark, sf):
    e = emb(spark, sf).withColumn("shard", F.floor(F.col("vec_id") / 100).cast("bigint"))
    return e.rollup("shard").agg(F.count(F.lit(1)).alias("n_vectors"))


@register("knn_sharded", f"{VBASE} SELECT query_id, vec_id, round(score, {R6}) AS score, rank FROM hits")
def q_knn_sharded(spark, sf):
    store, qs = split_sets(spark, sf)
    st = store.withColumn("shard", F.floor(F.col("vec_id") / 100).cast("bigint"))
    h = K.knn_sharded(qs, st, "shard", K10)
    return h.select("query_id", "vec_id", F.round("score", R6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


PAIRS = ("pd AS (SELECT a.query_id, a.vec_id, avg(sqrt(greatest(d.d2, 0))) AS mean_dist FROM hits20 a JOIN hits20 b USING (query_id) "
         "JOIN (SELECT x.vec_id AS va, y.vec_id AS vb, sum((x.x - y.x) * (x.x - y.x)) AS d2 FROM el x JOIN el y ON x.i = y.i "
         "WHERE x.vec_id IN (SELECT vec_id FROM hits20) AND y.vec_id IN (SELECT vec_id FROM hits20) GROUP BY 1, 2) d "
         "ON d.va = a.vec_id AND d.vb = b.vec_id GROUP BY 1, 2)")
H20 = "hits20 AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= 20)"


@register("pairwise_distance",
          f"WITH {ESPLIT}, {ELONG}, {SCORES}, {H20}, {PAIRS} SELECT query_id, vec_id, round(mean_dist, {R6}) AS mean_dist FROM pd")
def q_pairwise_distance(spark, sf):
    store, qs = split_sets(spark, sf)
    h = K.knn_exact(qs, store, 20)
    return r6(RT.mean_pairwise_distance(h, store).select("query_id", "vec_id", "mean_dist"), "mean_dist")


@register("energy_rerank",
          f"WITH {ESPLIT}, {ELONG}, {SCORES}, {H20}, {PAIRS}, "
          f"lc AS (SELECT label, count(*) AS cnt FROM embeddings e JOIN sp USING (vec_id) WHERE split = 'train' GROUP BY 1), "
          f"en AS (SELECT h.query_id, h.vec_id, -1.0 * h.score - 0.5 * pd.mean_dist - 0.3 * ln(lc.cnt + 1e-6) AS energy "
          f"FROM hits20 h JOIN pd USING (query_id, vec_id) JOIN embeddings e ON e.vec_id = h.vec_id JOIN lc ON lc.label = e.label) "
          f"SELECT query_id, vec_id, round(energy, {R6}) AS energy, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
          f"ORDER BY round(energy, 12), vec_id) AS rank FROM en) WHERE rank <= 10")
def q_energy_rerank(spark, sf):
    store, qs = split_sets(spark, sf)
    h = K.knn_exact(qs, store, 20)
    freq = store.groupBy("label").agg(F.count(F.lit(1)).alias("freq"))
    hl = K.attach_payload(h, store, ["label"]).join(freq, "label")
    r = RT.energy_rerank(hl, store, keep=10)
    return r.select("query_id", "vec_id", F.round("energy", R6).alias("energy"), F.col("rank").cast("bigint").alias("rank"))


@register("novelty_insert",
          f"WITH {ESPLIT}, {ELONG}, {SCORES}, {hits_sql(1)} SELECT query_id AS vec_id, round(score, {R6}) AS nearest "
          f"FROM hits WHERE score < 0.5")
def q_novelty_insert(spark, sf):
    store, qs = split_sets(spark, sf)
    return r6(RT.novelty_gate(qs, store, 0.5).select(F.col("query_id").alias("vec_id"), "nearest"), "nearest")


@register("usage_eviction",
          f"{VBASE}, u AS (SELECT s.vec_id, count(h.vec_id) AS usage FROM sp s LEFT JOIN hits h USING (vec_id) "
          f"WHERE s.split = 'train' GROUP BY 1) SELECT vec_id, usage FROM u ORDER BY usage DESC, vec_id LIMIT 100")
def q_usage_eviction(spark, sf):
    h, store, _ = hits10(spark, sf)
    return RT.evict_least_used(store.select("vec_id"), h.select("vec_id"), 100)


# ------------------------------------------------------- approximate (R)

def index_of(spark, store, method):
    """The lasting index of the store, below the shared folder."""
    return VI.build_or_open(store, checkpoint_dir(spark), method, DEFAULT.replace(retrieval_k=K10, seed=SEED))


@register("knn_ivf")
def q_knn_ivf(spark, sf):
    store, qs = split_sets(spark, sf)
    return index_of(spark, store, "ivf").search(qs)


@register("knn_ivfpq")
def q_knn_ivfpq(spark, sf):
    store, qs = split_sets(spark, sf)
    return index_of(spark, store, "ivfpq").search(qs)


@register("vector_index_all_lists", f"{VBASE} SELECT query_id, vec_id, round(score, {R6}) AS score, rank FROM hits")
def q_vector_index_all_lists(spark, sf):
    """I3 on vectors: built from the even ids, the odd ones added (twice, the second time to no effect), every list probed."""
    store, qs = split_sets(spark, sf)
    at = scratch_path(spark, "index-in-two")
    VI.build(store.filter("vec_id % 2 = 0"), at, "ivf", DEFAULT.replace(retrieval_k=K10, seed=SEED))
    index = VI.open_index(spark, at)
    for _ in range(2):
        index.add(store.filter("vec_id % 2 = 1"))
    h = index.search(qs, nprobe=index.settings.nlist)
    return h.select("query_id", "vec_id", F.round("score", R6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    store, qs = split_sets(spark, sf)
    return K.knn_lsh(qs, store, K10, threshold=1.2, bucket_length=0.5, tables=6)


@register("knn_auto",
          f"{VBASE} SELECT query_id, vec_id, round(score, {R6}) AS score, rank, 'exact' AS method, "
          f"(SELECT CASE WHEN count(*) < 10000 THEN 'exact' WHEN count(*) < 1000000 THEN 'ivf' ELSE 'ivfpq' END "
          f"FROM sp WHERE split = 'train') AS suggested FROM hits")
def q_knn_auto(spark, sf):
    """The method is an argument; the suggestion by store size is only reported."""
    store, qs = split_sets(spark, sf)
    h = K.knn(qs, store, K10, method="exact")
    return h.select("query_id", "vec_id", F.round("score", R6).alias("score"), F.col("rank").cast("bigint").alias("rank"),
                    F.lit("exact").alias("method"), F.lit(K.suggest_method(store.count())).alias("suggested"))


@register("kmeans_centroids")
def q_kmeans_centroids(spark, sf):
    store = emb(spark, sf)
    cents = K.train_centroids(store, K.default_nlist(store.count()), SEED)
    sizes = K.assign_lists(store, cents).groupBy("centroid_id").agg(F.count(F.lit(1)).alias("list_size"))
    return cents.join(sizes, "centroid_id", "left")


@register("pq_codes")
def q_pq_codes(spark, sf):
    store = emb(spark, sf)
    books = K.train_pq(store, 8, 256, SEED)
    return K.pq_encode(store, books).select("vec_id", "codes")


@register("pca_projection")
def q_pca_projection(spark, sf):
    return RT.pca(emb(spark, sf), 3)


def _u(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5('{SEED}|' || {text}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


PROBE_U = [f"((('0x' || substr(md5('{SEED}|{n}|' || q.vec_id::VARCHAR || '|' || p.i::VARCHAR || '|' || q.i::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
           for n in "uv"]
PROBES = (f"pq AS (SELECT q.vec_id AS query_id, p.i AS probe, q.i, q.x + 0.1 * p.i * sqrt(-2.0 * ln({PROBE_U[0]})) * cos(2 * pi() * {PROBE_U[1]}) AS x "
          "FROM el q JOIN sp ON sp.vec_id = q.vec_id AND sp.split <> 'train', (SELECT unnest([1, 2, 3]) AS i) p), "
          "pn AS (SELECT query_id, probe, sqrt(sum(x * x)) AS nrm FROM pq GROUP BY ALL), "
          "ps AS (SELECT pq.query_id, pq.probe, s.vec_id, round(sum(pq.x * s.x) / (any_value(pn.nrm) * any_value(nr.nrm)), 12) AS score FROM pq "
          "JOIN el s ON s.i = pq.i JOIN sp ON sp.vec_id = s.vec_id AND sp.split = 'train' JOIN nr ON nr.vec_id = s.vec_id "
          "JOIN pn ON pn.query_id = pq.query_id AND pn.probe = pq.probe GROUP BY ALL), "
          "pt AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY query_id, probe ORDER BY score DESC, vec_id) <= 10), "
          "pb AS (SELECT query_id, vec_id, max(score) AS score, count(*) AS n_probes FROM pt GROUP BY ALL)")


@register("multi_probe",
          f"WITH {ESPLIT}, {ELONG}, {PROBES} SELECT query_id, vec_id, round(score, {R6}) AS score, n_probes, "
          f"round(exp(score / 1.5) / sum(exp(score / 1.5)) OVER (PARTITION BY query_id), {R6}) AS weight FROM pb")
def q_multi_probe(spark, sf):
    store, qs = split_sets(spark, sf)
    return r6(H.multi_probe(qs, store, K10, probes=3, sigma=0.1, seed=SEED), "score", "weight")


HEAD_U = f"(2 * ((('0x' || substr(md5('{SEED}|head|' || i::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0) - 1)"
HEADS = (f"hu AS (SELECT i, {HEAD_U} AS u FROM (SELECT DISTINCT i FROM el)), "
         "al AS (SELECT vec_id, 2 * sum(x * u) / (SELECT sum(u * u) FROM hu) AS a FROM el JOIN hu USING (i) GROUP BY 1), "
         "tv AS (SELECT vec_id, i, i // 16 AS head, x - a * u AS x FROM el JOIN al USING (vec_id) JOIN hu USING (i)), "
         "tn AS (SELECT vec_id, head, sqrt(sum(x * x)) AS nrm FROM tv GROUP BY ALL), "
         "hs AS (SELECT q.vec_id AS query_id, s.vec_id, q.head, round(sum(q.x * s.x) / (any_value(nq.nrm) * any_value(ns.nrm)), 12) AS score "
         "FROM tv q JOIN sp a ON a.vec_id = q.vec_id AND a.split <> 'train' JOIN tv s ON s.i = q.i "
         "JOIN sp b ON b.vec_id = s.vec_id AND b.split = 'train' JOIN tn nq ON nq.vec_id = q.vec_id AND nq.head = q.head "
         "JOIN tn ns ON ns.vec_id = s.vec_id AND ns.head = s.head GROUP BY ALL), "
         "ht AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY query_id, head ORDER BY score DESC, vec_id) <= 10)")


@register("multi_head",
          f"WITH {ESPLIT}, {ELONG}, {HEADS}, hc AS (SELECT query_id, vec_id, count(*) AS n_heads FROM ht GROUP BY ALL), "
          f"m AS (SELECT query_id, vec_id, round(avg(score), 12) AS score, any_value(n_heads) AS n_heads "
          f"FROM hs JOIN hc USING (query_id, vec_id) GROUP BY ALL) "
          f"SELECT query_id, vec_id, round(score, {R6}) AS score, n_heads, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank "
          f"FROM m QUALIFY rank <= 10")
def q_multi_head(spark, sf):
    store, qs = split_sets(spark, sf)
    h = H.multi_head(qs, store, K10, heads=4, seed=SEED)
    return h.select("query_id", "vec_id", F.round("score", R6).alias("score"), F.col("n_heads").cast("bigint").alias("n_heads"),
                    F.col("rank").cast("bigint").alias("rank"))


@register("multi_head_vector",
          f"WITH {ESPLIT}, {ELONG}, {HEADS}, w AS (SELECT *, exp(score / 0.1) / sum(exp(score / 0.1)) OVER (PARTITION BY query_id, head) AS w FROM ht) "
          f"SELECT query_id, i AS dim, round(sum(w * x), {R6}) AS value FROM w JOIN tv ON tv.vec_id = w.vec_id AND tv.head = w.head GROUP BY 1, 2")
def q_multi_head_vector(spark, sf):
    store, qs = split_sets(spark, sf)
    return r6(H.multi_head_vector(qs, store, K10, heads=4, tau=0.1, seed=SEED), "value")


@register("random_fourier_features",
          f"WITH {ELONG}, j AS (SELECT unnest(range(16)) AS j) SELECT vec_id, j, round(sqrt(2.0 / 16) * cos(sum(x * "
          f"sqrt(-2.0 * ln({_u(chr(39) + 'w1' + chr(39), 'i::VARCHAR', 'j::VARCHAR')})) * "
          f"cos(2 * pi() * {_u(chr(39) + 'w2' + chr(39), 'i::VARCHAR', 'j::VARCHAR')}) * sqrt(2.0)) "
          f"+ 2 * pi() * {_u(chr(39) + 'b' + chr(39), 'j::VARCHAR')}), {R6}) AS feature FROM el, j GROUP BY vec_id, j")
def q_random_fourier_features(spark, sf):
    f = RT.random_fourier_features(emb(spark, sf), n_features=16, gamma=1.0, seed=SEED)
    return f.select("vec_id", F.posexplode("features").alias("j", "feature")) \
            .select("vec_id", F.col("j").cast("bigint").alias("j"), F.round("feature", R6).alias("feature"))


@register("quality_vote_hits",
          f"{VBASE}, {LAB}, v AS (SELECT query_id, label::VARCHAR AS token, score * (1 + least((label + 1) / 5.0, 1.0)) AS w "
          f"FROM hl WHERE score >= 0.1) SELECT query_id, token, round(sum(w) / sqrt(count(*)), {R6}) AS vote FROM v GROUP BY 1, 2")
def q_quality_vote_hits(spark, sf):
    """F6 with C4 over real similarities; the label stands for the continuation and its length."""
    h, store, _ = hits10(spark, sf)
    hl = K.attach_payload(h, store, ["label"])
    hl = hl.withColumns({"token": F.col("label").cast("string"), "length": F.col("label") + 1})
    return r6(RT.quality_vote(hl, "token", "length", 0.1), "vote")
