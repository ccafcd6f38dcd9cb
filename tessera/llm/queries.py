"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, chats, crf, dedup, mixing, neardup, phrases, pieces, pii, quality, runs, tokenfile, tokens
from tessera.llm.common import load
from tessera.llm.registry import register
from tessera.session import scratch_path


@register("op1_token_files")
def op1(spark, sf):
    """Write all documents as a token file, read it back, and digest the ids."""
    at = scratch_path(spark, "tokens")
    tokenfile.write_tokens(load(spark, sf, "documents"), at, public_tokenizers.path("byte_bpe_50k.json"))
    back = tokenfile.read_tokens(spark, at)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op3_source_mix", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5('42|' || doc_id::VARCHAR) AS h FROM documents),
         s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY 1),
         w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS wt FROM s),
         r AS (SELECT *, 3.0::DOUBLE * z AS cap, 3.0::DOUBLE * z / wt AS ratio FROM w),
         l AS (SELECT *, (sum(z::DOUBLE) OVER () - (sum(cap) OVER o - cap)) / (sum(wt) OVER () - (sum(wt) OVER o - wt)) AS lev
               FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
         f AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
         t AS (SELECT source, z, least(cap, wt * (SELECT lev FROM f)) AS target FROM l),
         p AS (SELECT d.*, z, target, round(target)::BIGINT AS quota,
                      (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS a
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, z AS source_size, target,
           (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + z + size, quota) - a - z)
            + greatest(0, least(a + 2 * z + size, quota) - a - 2 * z))::BIGINT AS taken FROM p""")
def op3(spark, sf):
    """The SQL has the closed form of what the slots take: the first ``quota`` words of the cyclic run."""
    return mixing.taken(load(spark, sf, "documents")).drop("source")


@register("op4_streaming_dedup", """
    WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, text_sha256 FROM t""")
def op4(spark, sf):
    return dedup.exact_duplicates(spark, os.path.join(sf, "documents.parquet")) \
                .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op7_token_counts")
def op7(spark, sf):
    return tokens.count_tokens(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_sentencepiece")
def op8(spark, sf):
    """Encode all documents, decode the ids, and digest both."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    both = pieces.decode_pieces(pieces.encode_pieces(docs, model), model)
    return both.select(
        "doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("piece_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@register("op10_minhash_near_duplicates")
def op10(spark, sf):
    return neardup.near_duplicates(load(spark, sf, "documents"))


@register("op6_quality_rules")
def op6(spark, sf):
    return quality.quality(load(spark, sf, "documents"), load(spark, sf, "labels"))


@register("op2_personal_data")
def op2(spark, sf):
    return pii.personal_data(load(spark, sf, "documents"))


@register("op9_chat_snapshots", """
    WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
               FROM conversations),
         p AS (SELECT *, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
                      count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r),
         e AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos + 1 = n_turns GROUP BY 1),
         k AS (SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos + 1 < n_turns))
    SELECT p.conv_id, p.pos, p.n_turns, k.copies,
           '<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
           || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS rendered
    FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id""")
def op9(spark, sf):
    return chats.format_chats(load(spark, sf, "conversations"))


@register("op5_language_crf")
def op5(spark, sf):
    return crf.identify(load(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@register("op11_periodic_runs")
def op11(spark, sf):
    """Runs of all documents, every tenth of them made periodic, and digests of what is left without them."""
    found = runs.periodic_runs(runs.with_planted_runs(load(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = runs.strongest(F.col("runs"))
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                         F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                    F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))


@register("op12_word_bpe")
def op12(spark, sf):
    """Encode all documents, decode the ids, and digest both."""
    model = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_words(load(spark, sf, "documents").select("doc_id", "text"), model).drop("text")
    both = bpe.decode_words(coded, model)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_phrase_collocations", r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM p),
         i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM w),
         g AS (SELECT lang, k::BIGINT AS k, array_to_string(w[pos:pos + k - 1], ' ') AS phrase
               FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) AS ks WHERE pos + k - 1 <= len(w)),
         f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
         n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
         c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
         x AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS cut FROM c),
         s AS (SELECT x.lang, x.phrase, x.m, x.a, x.cut, l.f AS l, r.f AS r,
                      ((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
               FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
                      JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
         o AS (SELECT lang, a AS longer, array_to_string(w[st:st + ln - 1], ' ') AS phrase
               FROM c, (SELECT unnest([1, 2, 3]) AS st) AS sts, (SELECT unnest([2, 3]) AS ln) AS lns WHERE ln < m AND st + ln - 1 <= m),
         d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase
                                                    AND 100::HUGEINT * o.longer >= 80::HUGEINT * b.a))
    SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= 2000""")
def op13(spark, sf):
    return phrases.collocations(load(spark, sf, "documents"))
