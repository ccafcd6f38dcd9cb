"""Queries for distributions, sampling and perplexity.

Store: all documents (min frequency 2).  Contexts: the whole text of every
benchmark item (next-token queries) and every position of every benchmark
item (evaluation queries).  Perplexity hold-out: the exact-count test split
of documents scored against a store built from the train split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.operators import corpus as C
from tessera.operators import dist as D
from tessera.operators import patterns as P
from tessera.operators import threshold as T
from tessera.plans.catalog import register
from tessera.plans.q_corpus import SPLIT_SQL
from tessera.plans.q_patterns import CONT_SQL, STORE_SQL, counts_for, docs, stored
from tessera.plans.sqlbits import norm, occurrences, ws_toks
from tessera.session import checkpoint_dir, load_table

R6 = 6
RES = DEFAULT.resolutions
MINF = DEFAULT.min_pattern_frequency
VALS = ",".join(f"({r})" for r in RES)
SEED = 42


def bench_tok(spark, sf):
    b = load_table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return P.tokenize_docs(b, balance=False).withColumnRenamed("doc_id", "item_id")


def weights(spark):
    return D.uniform_weights(spark, RES)


def bench_mixture(spark, sf):
    ctx = bench_tok(spark, sf)
    suf = D.context_suffixes(ctx, ["item_id"], RES)
    cont, store = counts_for(spark, sf, suf)
    small = ctx.count() * len(RES) <= D.BROADCAST_MAX_ROWS  # size check before broadcasting
    return D.mixture(suf, cont, store, ["item_id"], weights(spark), small=small), ctx


def r6(df, *cols):
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------- SQL pieces

BT = f"bt AS (SELECT item_id, {ws_toks(norm('text'))} AS tokens FROM benchmark WHERE len({ws_toks(norm('text'))}) >= 2)"
WT = f"wt AS (SELECT resolution, 1.0 / {len(RES)} AS weight FROM (VALUES {VALS}) r(resolution))"


def mix_sql(ctx: str, keys: str) -> str:
    """CTEs suf / ms / lv / mix for contexts ``ctx`` (keys + tokens)."""
    return f"""
    suf AS (SELECT {keys}, r.resolution,
                   array_to_string(tokens[len(tokens) - r.resolution + 1 : len(tokens)], ' ') AS pattern
            FROM {ctx} JOIN (VALUES {VALS}) r(resolution) ON len(tokens) >= r.resolution),
    ms AS (SELECT suf.*, s.cnt AS total FROM suf JOIN s USING (pattern)),
    lv AS (SELECT {keys}, ms.resolution, c.next AS token, c.cnt / ms.total AS p FROM ms JOIN c USING (pattern)),
    wsum AS (SELECT {keys}, sum(weight) AS wsum FROM ms JOIN wt USING (resolution) GROUP BY ALL),
    mix AS (SELECT {keys}, token, round(sum(weight * p) / any_value(wsum), 12) AS prob
            FROM lv JOIN wt USING (resolution) JOIN wsum USING ({keys}) GROUP BY ALL)"""


BASE = f"WITH {CONT_SQL}, {STORE_SQL}, {BT}, {WT}, {mix_sql('bt', 'item_id')}"


# ------------------------------------------------------------------ queries

@register("resolution_entropy",
          f"WITH {CONT_SQL}, {STORE_SQL}, h AS (SELECT c.resolution, sum(-c.cnt * ln(c.cnt / s.cnt)) / sum(c.cnt) AS entropy "
          f"FROM c JOIN s USING (pattern) GROUP BY 1) SELECT resolution, round(entropy, {R6}) AS entropy, "
          f"round(exp(-entropy) / sum(exp(-entropy)) OVER (), {R6}) AS weight FROM h")
def q_resolution_entropy(spark, sf):
    def sums(parts):
        cont, store = zip(*stored(parts))
        return D.entropy_sums(list(cont), list(store))

    return r6(D.level_entropy(None, None, sums=P.in_portions(docs(spark, sf), sums, least=MINF)), "entropy", "weight")


@register("next_token_mixture", f"{BASE} SELECT item_id, token, round(prob, {R6}) AS prob FROM mix")
def q_next_token_mixture(spark, sf):
    return r6(bench_mixture(spark, sf)[0], "prob")


@register("next_token_backoff",
          f"{BASE}, best AS (SELECT item_id, max(resolution) AS resolution FROM ms GROUP BY 1) "
          f"SELECT item_id, resolution, token, round(p, {R6}) AS prob FROM lv JOIN best USING (item_id, resolution)")
def q_next_token_backoff(spark, sf):
    suf = D.context_suffixes(bench_tok(spark, sf), ["item_id"], RES)
    cont, store = counts_for(spark, sf, suf)
    return r6(D.backoff(suf, cont, store, ["item_id"]), "prob")


@register("next_token_temperature",
          f"{BASE}, l AS (SELECT item_id, token, ln(prob + 1e-10) / 0.7 AS lg FROM mix), "
          f"e AS (SELECT item_id, token, exp(lg - max(lg) OVER (PARTITION BY item_id)) AS ex FROM l) "
          f"SELECT item_id, token, round(ex / sum(ex) OVER (PARTITION BY item_id), {R6}) AS prob FROM e")
def q_next_token_temperature(spark, sf):
    return r6(D.temperature(bench_mixture(spark, sf)[0], ["item_id"], 0.7), "prob")


@register("next_token_top_k",
          f"{BASE} SELECT item_id, token, round(prob, {R6}) AS prob, rank FROM (SELECT *, row_number() OVER "
          f"(PARTITION BY item_id ORDER BY prob DESC, token) AS rank FROM mix) WHERE rank <= 5")
def q_next_token_top_k(spark, sf):
    t = D.top_k(bench_mixture(spark, sf)[0], ["item_id"], 5)
    return r6(t.select("item_id", "token", "prob", F.col("rank")), "prob")


@register("next_token_top_p",
          f"{BASE}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY prob DESC, token) AS rk "
          f"FROM mix) WHERE rk <= 50), cp AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY item_id ORDER BY prob DESC, token "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) "
          f"SELECT item_id, token, round(prob / sum(prob) OVER (PARTITION BY item_id), {R6}) AS prob FROM cp WHERE before < 0.9")
def q_next_token_top_p(spark, sf):
    d = D.top_k(bench_mixture(spark, sf)[0], ["item_id"], 50).drop("rank")
    d = D.renormalize(D.top_p(d, ["item_id"], 0.9), ["item_id"])
    return r6(d.select("item_id", "token", "prob"), "prob")


@register("repetition_penalty",
          f"{BASE}, rec AS (SELECT DISTINCT item_id, unnest(tokens[greatest(1, len(tokens) - 19) : len(tokens)]) AS token FROM bt), "
          f"pen AS (SELECT m.item_id, m.token, CASE WHEN r.token IS NULL THEN m.prob ELSE m.prob / 1.2 END AS prob "
          f"FROM mix m LEFT JOIN rec r USING (item_id, token)) "
          f"SELECT item_id, token, round(prob / sum(prob) OVER (PARTITION BY item_id), {R6}) AS prob FROM pen")
def q_repetition_penalty(spark, sf):
    mix, ctx = bench_mixture(spark, sf)
    return r6(D.repetition_penalty(mix, ctx, ["item_id"], 1.2, "once", 20), "prob")


@register("greedy_next",
          f"{BASE} SELECT item_id, first(token ORDER BY prob DESC, token) AS token, round(max(prob), {R6}) AS prob "
          f"FROM mix GROUP BY 1")
def q_greedy_next(spark, sf):
    return r6(D.greedy(bench_mixture(spark, sf)[0], ["item_id"]), "prob")


UNI = f"(('0x' || substr(md5('{SEED}|' || item_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


@register("sampled_next",
          f"{BASE}, cu AS (SELECT item_id, token, sum(prob) OVER (PARTITION BY item_id ORDER BY prob DESC, token ROWS BETWEEN "
          f"UNBOUNDED PRECEDING AND CURRENT ROW) / sum(prob) OVER (PARTITION BY item_id) AS cum, row_number() OVER "
          f"(PARTITION BY item_id ORDER BY prob DESC, token) AS rk FROM mix) "
          f"SELECT item_id, coalesce(first(token ORDER BY rk) FILTER (WHERE cum >= {UNI}), first(token ORDER BY rk DESC)) "
          f"AS token FROM cu GROUP BY item_id")
def q_sampled_next(spark, sf):
    return D.sample(bench_mixture(spark, sf)[0], ["item_id"], SEED)


@register("sampling_methods",
          f"{BASE}, pm AS (SELECT * FROM (VALUES ('greedy'), ('top_k'), ('nucleus')) v(method)), "
          f"x AS (SELECT m.*, pm.method, CASE WHEN method = 'greedy' THEN 1 ELSE 10 END AS kk, "
          f"CASE WHEN method = 'nucleus' THEN 0.8 ELSE 1.0 END AS pp FROM mix m, pm), "
          f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, method ORDER BY prob DESC, token) AS rk FROM x) "
          f"WHERE rk <= kk), cp AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY item_id, method ORDER BY prob DESC, token "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) "
          f"SELECT item_id, method, token, round(prob / sum(prob) OVER (PARTITION BY item_id, method), {R6}) AS prob "
          f"FROM cp WHERE pp >= 1.0 OR before < pp")
def q_sampling_methods(spark, sf):
    mix = bench_mixture(spark, sf)[0]
    # Every context once per sampling method (a generator over a literal array)
    x = mix.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("greedy", "top_k", "nucleus")])))
    out = D.sampling_filter(x, ["item_id", "method"], F.col("method"), 10, 0.8)
    return r6(out.select("item_id", "method", "token", "prob"), "prob")


@register("eval_pairs",
          f"WITH {BT} SELECT item_id, pos, tokens[pos + 1] AS target, pos::BIGINT AS context_len FROM "
          f"(SELECT item_id, tokens, unnest(range(1, len(tokens))) AS pos FROM bt)")
def q_eval_pairs(spark, sf):
    e = D.eval_positions(bench_tok(spark, sf), "item_id")
    return e.select("item_id", F.col("pos").cast("bigint").alias("pos"), "target",
                    F.size("tokens").cast("bigint").alias("context_len"))


@register("perplexity_contexts",
          f"WITH {BT} SELECT item_id, pos, array_to_string(tokens[greatest(1, pos - 99) : pos], ' ') AS context FROM "
          f"(SELECT item_id, tokens, unnest(range(1, len(tokens))) AS pos FROM bt)")
def q_perplexity_contexts(spark, sf):
    e = D.eval_positions(bench_tok(spark, sf), "item_id", 100)
    return e.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("tokens", " ").alias("context"))


def ppl_sql(occ_sql: str, toks_sql: str, key: str) -> str:
    return f"""
    tp AS (SELECT o.{key}, o.position + o.resolution AS pos,
                  sum(wt.weight * coalesce(c.cnt, 0) / s.cnt) / sum(wt.weight) AS prob
           FROM {occ_sql} o JOIN s USING (pattern) LEFT JOIN c USING (pattern, next) JOIN wt ON wt.resolution = o.resolution
           GROUP BY ALL),
    tg AS (SELECT {key}, unnest(range(1, len(tokens))) AS pos FROM {toks_sql}),
    pp0 AS (SELECT {key}, round(-avg(ln(CASE WHEN prob > 0 THEN prob ELSE 1e-10 END)), 6) AS nll
           FROM tg LEFT JOIN tp USING ({key}, pos) GROUP BY 1),
    pp AS (SELECT {key}, nll, round(exp(nll), 2) AS perplexity FROM pp0)"""


BOCC = occurrences(table="(SELECT item_id AS doc_id, text FROM benchmark)")


@register("perplexity_benchmark",
          f"WITH {CONT_SQL}, {STORE_SQL}, {WT}, bt AS (SELECT item_id AS doc_id, {ws_toks(norm('text'))} AS tokens FROM benchmark "
          f"WHERE len({ws_toks(norm('text'))}) >= 2), {ppl_sql(BOCC, 'bt', 'doc_id')} "
          f"SELECT doc_id AS item_id, nll, perplexity FROM pp")
def q_perplexity_benchmark(spark, sf):
    b = load_table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    bt = P.tokenize_docs(b, balance=False)
    occ = P.extract_patterns(bt, RES)
    cont, store = counts_for(spark, sf, occ)
    ppl = ppl_out(D.perplexity(bt, occ, cont, store, weights(spark)))
    return ppl.withColumnRenamed("doc_id", "item_id")


def ppl_out(p):
    """nll rounded to 6 digits; perplexity = exp(nll) to 2 decimals (huge values
    carry no more stable digits across engines)."""
    nll = F.round("nll", 6)
    return p.select(p.columns[0], nll.alias("nll"), F.round(F.exp(nll), 2).alias("perplexity"))


def holdout_parts(spark, sf):
    d = load_table(spark, sf, "documents")
    split = C.ratio_split(d.select("doc_id"), SEED, "doc_id")
    train = d.join(split.filter("split = 'train'"), "doc_id", "left_semi")
    test = d.join(split.filter("split = 'test'"), "doc_id", "left_semi")
    tt = P.tokenize_docs(test)

    def terms(tasks, portion):         # both sides are dealt alike, so that their joins shuffle nothing more
        cont = P.count_parts(P.parts_from_docs(train, tasks=tasks, least=MINF, portion=portion))
        store = [P.build_store(c, MINF, ("head",)) for c in cont]
        return D.target_terms(P.dealt_patterns(tt, RES, tasks=tasks, portion=portion), cont, store, weights(spark))

    return ppl_out(D.perplexity(tt, None, None, None, weights(spark), terms=P.by_portion(d, terms)))


TRAIN_DOCS = f"(SELECT d.* FROM documents d JOIN {SPLIT_SQL} sp USING (doc_id) WHERE sp.split = 'train')"
TEST_DOCS = f"(SELECT d.* FROM documents d JOIN {SPLIT_SQL} sp USING (doc_id) WHERE sp.split = 'test')"
HOLD_SQL = (f"WITH c AS (SELECT pattern, resolution, next, count(*) AS cnt FROM {occurrences(table=TRAIN_DOCS)} o GROUP BY ALL), "
            f"{STORE_SQL}, {WT}, tt AS (SELECT doc_id, {ws_toks(norm('text'))} AS tokens FROM {TEST_DOCS} "
            f"WHERE len({ws_toks(norm('text'))}) >= 2), {ppl_sql(occurrences(table=TEST_DOCS), 'tt', 'doc_id')}")


@register("perplexity_holdout", f"{HOLD_SQL} SELECT doc_id, nll, perplexity FROM pp")
def q_perplexity_holdout(spark, sf):
    return holdout_parts(spark, sf)


@register("mean_perplexity",
          f"{HOLD_SQL} SELECT 'documents_test' AS dataset, round(avg(perplexity), 1) AS mean_perplexity, count(*) AS n "
          f"FROM pp WHERE perplexity < 'inf'::DOUBLE")
def q_mean_perplexity(spark, sf):
    p = holdout_parts(spark, sf).withColumn("dataset", F.lit("documents_test"))
    p = p.filter(F.col("perplexity") < F.lit(float("inf")))  # C7
    return p.groupBy("dataset").agg(F.round(F.avg("perplexity"), 1).alias("mean_perplexity"),
                                    F.count(F.lit(1)).alias("n"))


def position_preds(spark, sf):
    """The ten most likely tokens at every position.  Only patterns that end
    some context are counted: occurrences are filtered before the shuffle."""
    checkpoint_dir(spark)
    # the longest pattern is all that a context can match
    pairs = D.eval_positions(bench_tok(spark, sf), "item_id", max(RES))
    suf = D.context_suffixes(pairs, ["item_id", "pos"], RES).checkpoint()
    asked = suf.select("pattern").distinct().checkpoint()
    dt = P.tokenize_docs(load_table(spark, sf, "documents"))
    if asked.count() <= D.BROADCAST_MAX_ROWS:
        occ = P.asked_occurrences(dt, asked, RES)
    else:
        occ = P.extract_patterns(dt, RES).join(asked, "pattern", "left_semi")
    cont = P.continuation_counts(occ).checkpoint()                        # read in every round
    return T.top_predictions(suf, cont, P.build_store(cont, MINF), ["item_id", "pos"], weights(spark), 10), pairs


POS_CTX = "pc AS (SELECT item_id, pos, tokens[pos + 1] AS target, tokens[1:pos] AS tokens FROM (SELECT item_id, tokens, unnest(range(1, len(tokens))) AS pos FROM bt))"
PBASE = f"WITH {CONT_SQL}, {STORE_SQL}, {BT}, {WT}, {POS_CTX}, {mix_sql('pc', 'item_id, pos')}"
TOP10 = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, pos ORDER BY prob DESC, token) AS rk FROM mix) WHERE rk <= 10)"


@register("ranked_perplexity",
          f"{PBASE}, {TOP10}, sm AS (SELECT item_id, pos, sum(prob) AS ssum FROM top GROUP BY ALL), "
          f"ht AS (SELECT t.item_id, t.pos, t.prob AS hit FROM top t JOIN pc ON t.item_id = pc.item_id AND t.pos = pc.pos AND t.token = pc.target), "
          f"x AS (SELECT pc.item_id, pc.pos, sm.ssum, ht.hit FROM pc LEFT JOIN sm USING (item_id, pos) LEFT JOIN ht USING (item_id, pos)) "
          f"SELECT round(exp(sum(CASE WHEN ssum IS NULL THEN 0 ELSE -ln(coalesce(hit, 0.001) / ssum) END) / count(*)), 4) AS perplexity, "
          f"round(count(hit) / count(*), {R6}) AS accuracy, count(*) AS total_tokens, count(hit) AS correct_predictions FROM x")
def q_ranked_perplexity(spark, sf):
    preds, pairs = position_preds(spark, sf)
    r = T.ranked_perplexity(pairs, preds, ["item_id", "pos"])
    return r.select(F.round("perplexity", 4).alias("perplexity"), F.round("accuracy", R6).alias("accuracy"),
                    "total_tokens", "correct_predictions")


@register("topk_accuracy",
          f"{PBASE}, {TOP10} SELECT count(*) AS total, count(t.token) AS correct, round(count(t.token) / count(*), {R6}) AS accuracy "
          f"FROM pc LEFT JOIN top t ON t.item_id = pc.item_id AND t.pos = pc.pos AND t.token = pc.target")
def q_topk_accuracy(spark, sf):
    preds, pairs = position_preds(spark, sf)
    return r6(T.topk_accuracy(pairs, preds, ["item_id", "pos"]), "accuracy")
