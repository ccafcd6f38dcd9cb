"""Next-token distributions from the pattern store, and what acts on them.

A *context* row carries key columns and a ``tokens`` array (the tokens seen
so far).  Its suffixes of length r are looked up in the store (equi-join on
the pattern string), the matched levels' continuation counts become level
distributions, and those are mixed (E10) or backed off (E11).  Temperature,
top-k, top-p, repetition penalty and sampling are window/aggregate steps
keyed by the context key, so one plan serves every context at once.

Window sizes are bounded by the number of distinct continuations of the
matched patterns (the vocabulary), never by the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import patterns as P

EPS = 1e-10
STORE_BUCKETS = 64          # bucket partitions of a materialised store table
BROADCAST_MAX_ROWS = 1_000_000  # context rows a step may broadcast (checked by count)


def _parts(x: DataFrame | list[DataFrame]) -> list[DataFrame]:
    return x if isinstance(x, list) else [x]


def uniform_weights(spark, resolutions) -> DataFrame:
    return spark.createDataFrame([(int(r), 1.0 / len(resolutions)) for r in resolutions],
                                 "resolution INT, weight DOUBLE")


def given_weights(spark, resolutions, weights) -> DataFrame:
    return spark.createDataFrame([(int(r), float(w)) for r, w in zip(resolutions, weights)],
                                 "resolution INT, weight DOUBLE")


def entropy_sums(cont: DataFrame | list[DataFrame], store: DataFrame | list[DataFrame]) -> DataFrame:
    """What ``level_entropy`` adds up, a row per resolution.  ``cont`` and
    ``store`` may be lists of parts (see ``patterns.dealt_patterns``)."""
    def shares(c, s):
        on = P.key_columns(c, s)
        return (c.join(P.dealt_side(s.select(*on, F.col("cnt").alias("_t"))), on)
                 .select("resolution", "cnt", (F.col("cnt") / F.col("_t")).alias("_p")))
    x = P.union_parts([shares(c, s) for c, s in zip(_parts(cont), _parts(store))])
    return (x.groupBy("resolution")
             .agg(F.sum(-F.col("cnt") * F.ln("_p")).alias("_hsum"), F.sum("cnt").alias("_n")))


def level_entropy(cont: DataFrame | list[DataFrame] | None, store: DataFrame | list[DataFrame] | None, beta: float = 1.0,
                  sums: DataFrame | None = None) -> DataFrame:
    """conditional entropy per resolution and weights ``λ ∝ exp(-H_r/β)``.

    ``H_r = Σ_pattern (n_pattern / N_r) · (-Σ_next p log p)``; one small row
    per resolution, normalised by a scalar subquery.  ``sums`` are the
    ``entropy_sums`` of portions that share no pattern, instead of the tables."""
    h = entropy_sums(cont, store) if sums is None else sums.groupBy("resolution").agg(F.sum("_hsum").alias("_hsum"), F.sum("_n").alias("_n"))
    h = h.withColumn("entropy", F.col("_hsum") / F.col("_n")).withColumn("_e", F.exp(-F.col("entropy") / beta))
    z = h.select(F.sum("_e")).scalar()
    return h.select("resolution", "entropy", (F.col("_e") / z).alias("weight"))


def context_suffixes(ctx: DataFrame, keys: list[str], resolutions, tokens_col: str = "tokens") -> DataFrame:
    """``(keys, resolution, pattern)``: the last r tokens for every r <= len."""
    t = F.col(tokens_col)
    structs = [F.struct(F.lit(int(r)).alias("resolution"),
                        F.when(F.size(t) >= r, F.array_join(F.slice(t, -int(r), int(r)), " ")).alias("pattern"))
               for r in sorted(set(resolutions))]
    return (ctx.select(*keys, F.inline(F.array(*structs)))
               .filter(F.col("pattern").isNotNull()))


def _bucketed(suffixes: DataFrame, store: DataFrame) -> tuple[DataFrame, list[str]]:
    """Join keys: (bucket, pattern) when the store is a bucket-partitioned
    table (enables dynamic partition pruning), else pattern."""
    if "bucket" in store.columns and "bucket" not in suffixes.columns:
        suffixes = suffixes.withColumn("bucket", F.pmod(F.xxhash64("pattern"), F.lit(STORE_BUCKETS)).cast("int"))
    return suffixes, (["bucket", "pattern"] if "bucket" in store.columns else ["pattern"])


def level_distributions(suffixes: DataFrame, cont: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, resolution, token, p)`` for every suffix found in the store."""
    suffixes, jk = _bucketed(suffixes, store)
    matched = suffixes.join(store.select(*jk, F.col("cnt").alias("_total")), jk)
    c = cont.select(*jk, F.col("next").alias("token"), F.col("cnt").alias("_c"))
    return (matched.join(c, jk)
                   .select(*keys, "resolution", "token", (F.col("_c") / F.col("_total")).alias("p")))


def mixture(suffixes: DataFrame, cont: DataFrame, store: DataFrame, keys: list[str],
            weights: DataFrame, small: bool = False) -> DataFrame:
    """``P(t) = Σ_r λ_r P_r(t) / Σ_{matched r} λ_r``.

    The weights table has one row per resolution (proven tiny), so it is
    broadcast.  ``small=True`` (the caller has counted the contexts and
    checked them against ``BROADCAST_MAX_ROWS``) broadcasts the context side
    so the store is only scanned, never shuffled; otherwise all joins are
    shuffle joins on the pattern key."""
    w = F.broadcast(weights.select("resolution", "weight"))
    sb, jk = _bucketed(suffixes, store)
    side = F.broadcast(sb) if small else sb
    matched = side.join(store.select(*jk, F.col("cnt").alias("_total")), jk).join(w, "resolution")
    wsum = matched.groupBy(*keys).agg(F.sum("weight").alias("_wsum"))
    mside = F.broadcast(matched) if small else matched
    lv = mside.join(cont.select(*jk, F.col("next").alias("token"), F.col("cnt").alias("_c")), jk)
    num = lv.groupBy(*keys, "token").agg(F.sum(F.col("weight") * F.col("_c") / F.col("_total")).alias("_num"))
    # rounded to 12 digits so exact ties stay ties whatever the summation order
    return (num.join(wsum, keys)
               .select(*keys, "token", F.round(F.col("_num") / F.col("_wsum"), 12).alias("prob")))


def backoff(suffixes: DataFrame, cont: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The distribution of the longest matched suffix only."""
    matched = suffixes.join(store.select("pattern"), "pattern", "left_semi")
    best = matched.groupBy(*keys).agg(F.max("resolution").alias("resolution"))
    lv = level_distributions(suffixes, cont, store, keys)
    return lv.join(best, [*keys, "resolution"]).select(*keys, "resolution", "token", F.col("p").alias("prob"))


def _order(prob: str = "prob"):
    return [F.desc(prob), F.asc("token")]


def temperature(dist: DataFrame, keys: list[str], t: float, prob: str = "prob") -> DataFrame:
    """B15 on probabilities: ``softmax(log(p + 1e-10) / T)``; ``T = 0`` is
    greedy (all mass on the arg-max, ties to the smallest token)."""
    wk = Window.partitionBy(*keys)
    if t == 0:
        rn = F.row_number().over(wk.orderBy(*_order(prob)))
        return dist.withColumn(prob, F.when(rn == 1, 1.0).otherwise(0.0))
    logit = F.ln(F.col(prob) + EPS) / t
    x = dist.withColumn("_l", logit)
    x = x.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(wk)))
    return x.withColumn(prob, F.col("_e") / F.sum("_e").over(wk)).drop("_l", "_e")


def softmax_scores(df: DataFrame, keys: list[str], score: str, t: float, out: str = "w") -> DataFrame:
    """B15 on scores / F5: ``softmax(s / T)`` with max subtraction."""
    wk = Window.partitionBy(*keys)
    x = df.withColumn("_z", F.col(score) / t)
    x = x.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(wk)))
    return x.withColumn(out, F.col("_e") / F.sum("_e").over(wk)).drop("_z", "_e")


def renormalize(dist: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
    return dist.withColumn(prob, F.col(prob) / F.sum(prob).over(Window.partitionBy(*keys)))


def top_k(dist: DataFrame, keys: list[str], k: int | Column, prob: str = "prob") -> DataFrame:
    """G1: the k most likely tokens (ties by token); probabilities untouched."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(prob)))
    kk = k if isinstance(k, Column) else F.lit(int(k))
    x = dist.withColumn("rank", rn)
    return x.filter((kk <= 0) | (F.col("rank") <= kk))


def top_p(dist: DataFrame, keys: list[str], p: float | Column, prob: str = "prob") -> DataFrame:
    """Smallest prefix (prob desc, token) whose cumulative mass reaches p,
    the crossing token included; cumulates the probabilities as given."""
    w = Window.partitionBy(*keys).orderBy(*_order(prob)).rowsBetween(Window.unboundedPreceding, -1)
    pp = p if isinstance(p, Column) else F.lit(float(p))
    before = F.coalesce(F.sum(prob).over(w), F.lit(0.0))
    return dist.withColumn("_before", before).filter((pp >= 1.0) | (F.col("_before") < pp)).drop("_before")


def repetition_penalty(dist: DataFrame, history: DataFrame, keys: list[str], penalty: float,
                       mode: str = "once", window: int = 20, prob: str = "prob") -> DataFrame:
    """Tokens among the last ``window`` history tokens are divided by the
    penalty (``once``) or by ``penalty ** count`` (``count``), then renormalised.

    ``history`` has ``keys`` + ``tokens`` (the context)."""
    t = F.col("tokens")
    last = F.slice(t, F.greatest(F.lit(1), F.size(t) - window + 1), F.lit(window))
    recent = (history.select(*keys, F.explode(last).alias("token"))
                     .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_rep")))
    x = dist.join(recent, [*keys, "token"], "left")
    if mode == "once":
        fac = F.when(F.col("_rep").isNotNull(), F.lit(float(penalty))).otherwise(F.lit(1.0))
    else:
        fac = F.pow(F.lit(float(penalty)), F.coalesce(F.col("_rep"), F.lit(0)))
    x = x.withColumn(prob, F.col(prob) / fac).drop("_rep")
    return renormalize(x, keys, prob)


def greedy(dist: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
    """H1: arg-max token per key (ties to the smallest token), a partial aggregate."""
    return dist.groupBy(*keys).agg(F.min_by("token", F.struct(-F.col(prob), F.col("token"))).alias("token"),
                                   F.max(prob).alias(prob))


def uniform01(seed: int, *cols) -> Column:
    """Deterministic U[0,1) from md5('seed|col|...') (first 8 hex digits / 2^32)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])),
                           1, 8), 16, 10).cast("double")
    return h / float(2 ** 32)


def sample(dist: DataFrame, keys: list[str], seed: int, step_col: str | None = None,
           prob: str = "prob") -> DataFrame:
    """H2: inverse-CDF draw; u from md5(seed, keys, step); the first token (prob
    desc, token) whose cumulative normalised mass reaches u."""
    wk = Window.partitionBy(*keys)
    wo = wk.orderBy(*_order(prob)).rowsBetween(Window.unboundedPreceding, 0)
    ucols = [*keys] + ([step_col] if step_col else [])
    x = (dist.withColumn("_cum", F.sum(prob).over(wo) / F.sum(prob).over(wk))
             .withColumn("_u", uniform01(seed, *ucols))
             .withColumn("_rank", F.row_number().over(wk.orderBy(*_order(prob)))))
    # rows reaching u, plus the last row as a floating-point guard
    hit = (F.col("_cum") >= F.col("_u"))
    pick = x.groupBy(*keys).agg(
        F.coalesce(F.min_by("token", F.when(hit, F.col("_rank"))), F.max_by("token", F.col("_rank"))).alias("token"))
    return pick


def sampling_filter(dist: DataFrame, keys: list[str], method: Column, k: int, p: float,
                    prob: str = "prob") -> DataFrame:
    """K3: per-row method switch (``greedy`` / ``top_k`` / ``nucleus``) in one
    plan: greedy keeps the top token, top_k keeps k, nucleus keeps k then p;
    then renormalises."""
    kk = F.when(method == "greedy", F.lit(1)).otherwise(F.lit(int(k)))
    pp = F.when(method == "nucleus", F.lit(float(p))).otherwise(F.lit(1.0))
    x = top_k(dist.withColumn("_k", kk).withColumn("_p", pp), keys, F.col("_k"), prob)
    x = top_p(x, keys, F.col("_p"), prob)
    return renormalize(x.drop("_k", "_p", "rank"), keys, prob)


# ------------------------------------------------------------ evaluation rows


def eval_positions(docs_tok: DataFrame, key: str = "doc_id", window: int | None = None) -> DataFrame:
    """For every position i >= 1 of the whole text: the target token
    and its context, the whole prefix (D3) or the last ``window`` tokens (D4)."""
    x = docs_tok.select(key, "tokens", F.posexplode("tokens").alias("pos", "target")).filter(F.col("pos") >= 1)
    start = F.greatest(F.lit(1), F.col("pos") - window + 1) if window else F.lit(1)
    ctx = F.slice("tokens", start, F.col("pos") - start + 1)
    return x.select(key, "pos", "target", ctx.alias("tokens"))


def target_terms(occ: DataFrame | list[DataFrame], cont: DataFrame | list[DataFrame], store: DataFrame | list[DataFrame],
                 weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, pos, weight, part)`` for every context suffix that is in the
    store, of which ``target_probability`` is the mean: see there.

    The three tables may be lists of parts (see ``patterns.dealt_patterns``):
    parts dealt alike are joined where they are."""
    w = F.broadcast(weights.select("resolution", "weight"))

    def looked_up(o, c, s):
        on = P.key_columns(o, c, s)
        return (o.select(key, (F.col("position") + F.col("resolution")).alias("pos"), "resolution", *on, "next")
                 .join(P.dealt_side(s.select(*on, F.col("cnt").alias("_total"))), on)
                 .join(P.dealt_side(c.select(*on, "next", F.col("cnt").alias("_c"))), [*on, "next"], "left")
                 .select(key, "pos", "resolution", "_total", "_c"))
    x = P.union_parts([looked_up(*p) for p in zip(_parts(occ), _parts(cont), _parts(store))]).join(w, "resolution")
    p = F.coalesce(F.col("_c"), F.lit(0)) / F.col("_total")
    return x.select(key, "pos", "weight", (F.col("weight") * p).alias("part"))


def target_probability(occ: DataFrame | list[DataFrame] | None, cont: DataFrame | list[DataFrame] | None,
                       store: DataFrame | list[DataFrame] | None, weights: DataFrame, key: str = "doc_id",
                       terms: DataFrame | None = None) -> DataFrame:
    """Probability of the observed next token at every position, without
    materialising whole distributions.

    An occurrence (position q, resolution r, pattern, next) *is* the context
    suffix of length r before target position q + r, and ``next`` is the
    target, so ``P_r(target) = cont(pattern, next) / store(pattern)`` is one
    equi-join on (pattern, next); the mixture is a grouped sum per target.
    ``terms`` are the ``target_terms`` of all portions, instead of the tables."""
    x = target_terms(occ, cont, store, weights, key) if terms is None else terms
    return x.groupBy(key, "pos").agg((F.sum("part") / F.sum("weight")).alias("prob"))


def perplexity(docs_tok: DataFrame, occ: DataFrame | None, cont: DataFrame | None, store: DataFrame | None,
               weights: DataFrame, key: str = "doc_id", unseen: float = EPS, terms: DataFrame | None = None) -> DataFrame:
    """``exp(-mean log p)`` over positions 1..n-1 of each whole text;
    unseen (or unmatched) targets get ``unseen``; fewer than 2 tokens -> inf."""
    targets = docs_tok.select(key, F.posexplode("tokens").alias("pos", "_t")).filter(F.col("pos") >= 1)
    tp = target_probability(occ, cont, store, weights, key, terms)
    x = targets.join(tp, [key, "pos"], "left")
    lp = F.ln(F.when(F.col("prob") > 0, F.col("prob")).otherwise(F.lit(unseen)))
    nll = x.groupBy(key).agg((-F.avg(lp)).alias("nll"))
    return (docs_tok.select(key).join(nll, key, "left")
            .select(key, "nll", F.coalesce(F.exp("nll"), F.lit(math.inf)).alias("perplexity")))
