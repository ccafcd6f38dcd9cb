"""Queries for corpus statistics, splits, sampling and interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import patterns as P
from tessera.plans.catalog import register
from tessera.plans.sqlbits import WS, occurrences, ws_toks
from tessera.session import load_table

R6 = 6
SEED = 42


def docs(spark, sf):
    return load_table(spark, sf, "documents")


def H(x: str) -> str:
    """DuckDB twin of the seeded order key."""
    return f"md5('{SEED}|' || ({x})::VARCHAR)"


def HNUM(*parts: str) -> str:
    cat = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5('{SEED}|' || {cat}), 1, 8))::BIGINT"


@register("corpus_info",
          f"SELECT count(*) AS num_documents, coalesce(sum(length(text)), 0)::BIGINT AS total_chars, "
          f"round(coalesce(avg(length(text)), 0), {R6}) AS avg_chars, coalesce(min(length(text)), 0)::BIGINT AS min_chars, "
          f"coalesce(max(length(text)), 0)::BIGINT AS max_chars FROM documents")
def q_corpus_info(spark, sf):
    return C.corpus_info(docs(spark, sf)).withColumn("avg_chars", F.round("avg_chars", R6))


@register("corpus_statistics",
          f"SELECT count(*) AS num_samples, coalesce(sum(w), 0)::BIGINT AS total_tokens, round(avg(w), {R6}) AS avg_words, "
          f"round(median(w), {R6}) AS median_words, min(w)::BIGINT AS min_words, max(w)::BIGINT AS max_words "
          f"FROM (SELECT len({ws_toks('text', False)}) AS w FROM documents)")
def q_corpus_statistics(spark, sf):
    s = C.corpus_statistics(docs(spark, sf))
    return s.select("num_samples", "total_tokens", F.round("avg_words", R6).alias("avg_words"),
                    F.round("median_words", R6).alias("median_words"), "min_words", "max_words")


@register("source_counts", "SELECT source, count(*) AS num_samples FROM documents GROUP BY 1")
def q_source_counts(spark, sf):
    return C.source_counts(docs(spark, sf))


@register("first_patterns_per_doc",
          f"SELECT doc_id, position, resolution, pattern, next FROM (SELECT *, row_number() OVER "
          f"(PARTITION BY doc_id ORDER BY position, resolution) AS rn FROM {occurrences()} o) WHERE rn <= 100")
def q_first_patterns_per_doc(spark, sf):
    # every position has a window, or none has one after it: the first 100 rows begin at the first 100 positions
    o = P.patterns_from_docs(docs(spark, sf)).filter(F.col("position") < 100)
    return C.first_n_per_group(o, "doc_id", ["position", "resolution"], 100)


@register("interleave_sources",
          "SELECT doc_id, source, rr, source_rank FROM (SELECT doc_id, source, "
          "(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS rr, "
          "(dense_rank() OVER (ORDER BY source) - 1)::BIGINT AS source_rank FROM documents) "
          "ORDER BY rr, source_rank LIMIT 500")
def q_interleave_sources(spark, sf):
    return C.interleave(docs(spark, sf).select("doc_id", "source"), max_samples=500).select(
        "doc_id", "source", "rr", "source_rank")


@register("assign_ids",
          "SELECT item_id, ((SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY item_id))::BIGINT "
          "AS id FROM benchmark")
def q_assign_ids(spark, sf):
    b = load_table(spark, sf, "benchmark").select("item_id")
    d = docs(spark, sf).select(F.col("doc_id").alias("id"))
    return C.assign_ids(b, [F.col("item_id")], existing=d, id_col="id")


@register("sample_rows", f"SELECT doc_id, source FROM documents ORDER BY {H('doc_id')}, doc_id LIMIT 50")
def q_sample_rows(spark, sf):
    return C.sample_rows(docs(spark, sf).select("doc_id", "source"), 50, SEED, "doc_id")


@register("shuffle_rows",
          f"SELECT doc_id, (row_number() OVER (ORDER BY {H('doc_id')}, doc_id) - 1)::BIGINT AS shuffle_rank FROM documents")
def q_shuffle_rows(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return C.grouped_index(d, [], [C.seeded_key(SEED, "doc_id"), F.col("doc_id")], "shuffle_rank")


SPLIT_SQL = (f"(SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) "
             f"THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY "
             f"{H('doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents))")


@register("ratio_split", f"SELECT * FROM {SPLIT_SQL}")
def q_ratio_split(spark, sf):
    return C.ratio_split(docs(spark, sf).select("doc_id"), SEED, "doc_id")


@register("corpus_splits",
          f"SELECT s.doc_id, s.split FROM {SPLIT_SQL} s JOIN documents d USING (doc_id) "
          f"WHERE length(regexp_replace(d.text, '^{WS}+|{WS}+$', '', 'g')) > 50")
def q_corpus_splits(spark, sf):
    from tessera.functions import text as T
    d = docs(spark, sf)
    s = C.ratio_split(d.select("doc_id"), SEED, "doc_id")
    return s.join(d.filter(T.min_length("text", 50)).select("doc_id"), "doc_id", "left_semi")


@register("prefix_split",
          "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.1) "
          "THEN 'validation' ELSE 'train' END AS split FROM documents")
def q_prefix_split(spark, sf):
    return C.prefix_split(docs(spark, sf).select("doc_id"), 0.1, "doc_id")


@register("tail_holdout", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100")
def q_tail_holdout(spark, sf):
    return C.tail_n(docs(spark, sf).select("doc_id", "n_chars"), 100, "doc_id")


@register("head_limit", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def q_head_limit(spark, sf):
    return C.head_n(docs(spark, sf).select("doc_id", "n_chars"), 100, "doc_id")


@register("bounded_scan",
          f"SELECT doc_id, n_chars FROM documents WHERE length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) > 100 "
          f"ORDER BY doc_id LIMIT 300")
def q_bounded_scan(spark, sf):
    return C.bounded_scan(docs(spark, sf), 100, 300).select("doc_id", "n_chars")


@register("concat_quota",
          "SELECT id, corpus FROM (SELECT doc_id AS id, 'documents' AS corpus, 0 AS r FROM documents UNION ALL "
          "SELECT item_id, 'benchmark', 1 FROM benchmark) ORDER BY r, id LIMIT 1020")
def q_concat_quota(spark, sf):
    a = docs(spark, sf).select(F.col("doc_id").alias("id"), F.lit("documents").alias("corpus"), F.lit(0).alias("r"))
    b = load_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("corpus"),
                                                  F.lit(1).alias("r"))
    return C.first_rows(a.unionByName(b), [F.col("r"), F.col("id")], 1020).select("id", "corpus")


@register("sample_corpus",
          f"WITH pool AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) AS sent_idx, text AS sentence FROM benchmark), "
          f"np AS (SELECT count(*) AS n FROM pool), "
          f"s AS (SELECT doc_id, unnest(range(5 + {HNUM('doc_id', chr(39) + 'n' + chr(39))} % 11)) AS i FROM documents) "
          f"SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS text FROM s, np JOIN pool "
          f"ON pool.sent_idx = {HNUM('doc_id', 'i')} % np.n GROUP BY doc_id")
def q_sample_corpus(spark, sf):
    pool = C.grouped_index(load_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("sentence")),
                           [], [F.col("item_id")], "sent_idx").drop("item_id")
    return C.sample_corpus(docs(spark, sf).select("doc_id"), pool, SEED)
