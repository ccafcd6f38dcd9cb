"""Exact top-k of a mixture without its whole distribution.

A context's mixture adds up, over the suffixes it matches, the weighted
continuation probabilities of each.  Most of that sum is never among the k
best.  The threshold algorithm reads every suffix's continuations in order of
their probability and stops once no unread one can reach the k-th best:

1. Contexts that match the same suffixes are one *tuple*, solved once.
2. The first ``depth`` continuations of each suffix are its list; the last
   one's probability bounds whatever the list leaves out.
3. Tokens of a tuple's lists whose upper bound (known part plus the bounds of
   the lists that do not show them) reaches the k-th best known part are looked
   up in the other suffixes, which makes their score exact.
4. A tuple is done where the k-th best exact score is above the sum of the
   bounds, or where no list leaves anything out.  The others go on with lists
   four times as long.

Rows are at most ``depth`` per suffix of a tuple, so they follow the number of
contexts, not the number of continuations of a frequent word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

#: Continuations of a suffix that the first round reads.
DEPTH = 32
GROWTH = 4


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def suffix_tuples(suffixes: DataFrame, store: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(keys, tuple, items) of each context that matches a suffix; ``items``
    has pattern, weight and total of each match, ``tuple`` names them."""
    found = (suffixes.join(store.select("pattern", F.col("cnt").alias("total")), "pattern")
                     .join(F.broadcast(weights.select("resolution", "weight")), "resolution"))     # one row a resolution
    item = F.struct("resolution", "pattern", "weight", "total")
    grouped = found.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))          # one item a resolution
    return grouped.withColumn("tuple", F.array_join(F.transform("items", lambda i: i["pattern"]), "\n"))


def pattern_lists(cont: DataFrame, patterns: DataFrame, depth: int) -> DataFrame:
    """(pattern, list, rest): the ``depth`` most frequent continuations, and
    the count that bounds all others (0 where there are none)."""
    order = Window.partitionBy("pattern").orderBy(F.desc("cnt"), "next")
    best = (cont.join(patterns, "pattern", "left_semi").withColumn("rank", F.row_number().over(order))
                .filter(F.col("rank") <= depth))
    lists = best.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("rank", "next", "cnt"))).alias("list"))
    rest = F.when(F.size("list") < depth, F.lit(0)).otherwise(F.element_at("list", -1)["cnt"])
    return lists.select("pattern", "list", rest.alias("rest"))


def candidates(tuples: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(tuple, token, known, open, bound): tokens of the lists that may be
    among the k best; ``open`` are the items that do not show the token but
    may hold it, ``bound`` is the most that a token in no list can score."""
    rows = (tuples.select("tuple", F.posexplode("items").alias("i", "item"))
                  .select("tuple", "i", "item.pattern", "item.weight", "item.total").join(lists, "pattern"))
    share = F.col("weight") / F.col("total")
    bounds = rows.groupBy("tuple").agg(
        F.sum(share * F.col("rest")).alias("bound"),
        F.collect_list(F.struct("i", "pattern", share.alias("share"), "rest")).alias("all"))       # one entry an item
    shown = rows.select("tuple", "i", share.alias("share"), F.explode("list").alias("e")).groupBy("tuple", F.col("e.next").alias("token")).agg(
        F.sum(F.col("share") * F.col("e.cnt")).alias("known"), F.collect_list("i").alias("seen"))
    x = shown.join(bounds, "tuple").withColumn(
        "open", F.filter("all", lambda a: (a["rest"] > 0) & ~F.array_contains("seen", a["i"])))
    most = F.col("known") + F.aggregate("open", F.lit(0.0), lambda s, a: s + a["share"] * a["rest"])
    order = Window.partitionBy("tuple").orderBy(F.desc("known"), "token")
    kth = F.max(F.when(F.col("rank") == k, F.col("known"))).over(Window.partitionBy("tuple"))
    x = x.withColumn("rank", F.row_number().over(order)).withColumn("kth", kth)
    # a little room below the k-th keeps scores that only differ by rounding
    return x.filter(F.col("kth").isNull() | (most >= F.col("kth") - 1e-9)).select("tuple", "token", "known", "open", "bound")


def exact_scores(cands: DataFrame, cont: DataFrame) -> DataFrame:
    """(tuple, token, score, bound): what the open items add is looked up."""
    asked = cands.select("tuple", "token", F.explode("open").alias("o")).select("tuple", "token", "o.pattern", "o.share")
    more = (asked.join(cont.select("pattern", F.col("next").alias("token"), "cnt"), ["pattern", "token"])
                 .groupBy("tuple", "token").agg(F.sum(F.col("share") * F.col("cnt")).alias("more")))
    return cands.join(more, ["tuple", "token"], "left").select(
        "tuple", "token", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("score"), "bound")


def top_lists(contexts: DataFrame, cont: DataFrame, k: int, depth: int = DEPTH) -> DataFrame:
    """(tuple, top): the k most likely tokens of each distinct tuple of
    ``contexts`` (of ``suffix_tuples``), an array of rank, token and prob in
    that order; equal probabilities (12 decimals) rank by token."""
    total = F.aggregate("items", F.lit(0.0), lambda s, i: s + i["weight"])
    todo = contexts.groupBy("tuple").agg(F.first("items").alias("items")).withColumn("total", total)
    todo, done = _cut(todo), None
    while True:
        patterns = todo.select(F.explode("items.pattern").alias("pattern")).distinct()
        shown = _cut(pattern_lists(cont, patterns, depth))              # read twice, from one sort of the continuations
        scores = exact_scores(candidates(todo, shown, k), cont).join(todo.select("tuple", "total"), "tuple")
        scores = scores.select("tuple", "token", F.round(F.col("score") / F.col("total"), 12).alias("prob"),
                               F.round(F.col("bound") / F.col("total"), 12).alias("bound"))
        order = Window.partitionBy("tuple").orderBy(F.desc("prob"), "token")
        best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        lists = best.groupBy("tuple").agg(F.sort_array(F.collect_list(F.struct("rank", "token", "prob"))).alias("top"), F.max("bound").alias("bound"))
        settled = (F.col("bound") == 0) | ((F.size("top") == k) & (F.element_at("top", -1)["prob"] > F.col("bound")))
        lists = _cut(lists.withColumn("settled", settled))
        ready = lists.filter("settled").select("tuple", "top")
        done = ready if done is None else done.unionByName(ready)
        rest = lists.filter("NOT settled").select("tuple")
        if rest.isEmpty():
            return done
        todo = _cut(todo.join(rest, "tuple", "left_semi"))
        depth *= GROWTH


def top_predictions(suffixes: DataFrame, cont: DataFrame, store: DataFrame, keys: list[str], weights: DataFrame, k: int,
                    depth: int = DEPTH) -> DataFrame:
    """(keys, top) of each context with a matched suffix: the k first rows of
    ``dist.mixture`` as an array, without the mixture."""
    contexts = _cut(suffix_tuples(suffixes, store, keys, weights))
    return contexts.select(*keys, "tuple").join(top_lists(contexts, cont, k, depth), "tuple").drop("tuple")


def _judged(pairs: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    x = pairs.select(*keys, "target").join(tops, keys, "left")
    hit = F.filter("top", lambda t: t["token"] == F.col("target"))
    return x.select(*keys, F.aggregate("top", F.lit(0.0), lambda s, t: s + t["prob"]).alias("mass"), F.get(hit, 0)["prob"].alias("hit"))


def ranked_perplexity(pairs: DataFrame, tops: DataFrame, keys: list[str], unseen_score: float = 0.001) -> DataFrame:
    """loss -log(score / mass of the list) of each position, unseen
    targets at ``unseen_score``; positions without a list only count in the
    denominator.  One row: perplexity, accuracy, totals."""
    x = _judged(pairs, tops, keys)
    loss = F.when(F.col("mass").isNull(), 0.0).otherwise(-F.ln(F.coalesce("hit", F.lit(unseen_score)) / F.col("mass")))
    n = F.count(F.lit(1))
    return x.agg(F.exp(F.sum(loss) / n).alias("perplexity"), (F.count("hit") / n).alias("accuracy"),
                 n.alias("total_tokens"), F.count("hit").alias("correct_predictions"))


def topk_accuracy(pairs: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """share of positions whose token is in their list."""
    x = _judged(pairs, tops, keys)
    n = F.count(F.lit(1))
    return x.agg(n.alias("total"), F.count("hit").alias("correct"), (F.count("hit") / n).alias("accuracy"))
