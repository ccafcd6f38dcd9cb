"""Query for next tokens by vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.operators import nextvec as N
from tessera.plans.catalog import register
from tessera.plans.q_dist import BT, RES, bench_tok
from tessera.plans.q_patterns import CONT_SQL, STORE_SQL, counts_for, whole_store

DIM, K10, LAST = DEFAULT.embedding_dim, DEFAULT.retrieval_k, max(RES)


def _hash(tokens: str) -> str:
    """DuckDB: twice the bucket of each token, plus one for a negative sign."""
    return (f"list_transform({tokens}, lambda t: 2 * (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}) "
            f"+ CASE WHEN ('0x' || substr(md5(t), 9, 1))::INTEGER < 8 THEN 0 ELSE 1 END)")


#: DuckDB: the vector of hashed tokens ``h``.
VEC = (f"list_transform(range({DIM}), lambda j: list_sum(list_transform(h, lambda x: CASE x WHEN 2 * j THEN 1.0::DOUBLE "
       f"WHEN 2 * j + 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS v")


@register("next_token_vector", f"""
    WITH {CONT_SQL}, {STORE_SQL}, {BT},
         sv AS (SELECT row_number() OVER (ORDER BY pattern) AS vec_id, pattern, cnt, {VEC}
                FROM (SELECT pattern, cnt, {_hash("string_split(pattern, ' ')")} AS h FROM s)),
         qv AS (SELECT item_id, {VEC} FROM (
                SELECT item_id, {_hash(f"tokens[greatest(1, len(tokens) - {LAST} + 1) : len(tokens)]")} AS h FROM bt)),
         sn AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM sv), qn AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM qv),
         sc AS (SELECT item_id, vec_id, pattern, cnt, round(list_inner_product(qn.v, sn.v) / (qn.n * sn.n), 12) AS score
                FROM qn, sn WHERE qn.n > 0 AND sn.n > 0),
         h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rk FROM sc)
               WHERE rk <= {K10} AND score >= 1e-12),
         vt AS (SELECT item_id, c.next AS token, sum(score * c.cnt / h.cnt) AS vote FROM h JOIN c USING (pattern) GROUP BY 1, 2)
    SELECT item_id, token, round(vote / sum(vote) OVER (PARTITION BY item_id), 6) AS prob FROM vt""")
def q_next_token_vector(spark, sf):
    """Every benchmark item's last tokens against all stored patterns."""
    store = whole_store(spark, sf)
    embed = N.hashed(DIM)
    ctx = bench_tok(spark, sf).select(F.col("item_id").alias("query_id"), F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - LAST + 1), LAST).alias("tokens"))
    out = N.next_tokens(ctx, N.embed_store(store, embed), lambda hits: counts_for(spark, sf, hits), None, embed, K10)
    return out.select(F.col("query_id").alias("item_id"), "token", F.round("prob", 6).alias("prob"))
