"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept.  ``run`` writes the result of each stage as Parquet to the shared
scratch folder and reads it again as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers

from tessera.llm.common import load, stored

#: SQL can express neither the trained language model nor the piece segmentation.
ORACLE_SQL = None


def language(spark, docs, sf_dir):
    """Drop documents without a language: no letter, or no label above the least score."""
    from tessera.llm import crf

    return crf.keep_identified(docs)


def exact_duplicates(spark, docs, sf_dir):
    """Keep one document of each set of equal texts."""
    from tessera.llm import dedup

    return dedup.keep_unique(docs)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group of near copies."""
    from tessera.llm import neardup

    return neardup.keep_representatives(docs)


def mixture(spark, docs, sf_dir):
    """Take each document as often as the source schedule does."""
    from tessera.llm import mixing

    return mixing.take_mix(docs)


def sentencepiece_ids(spark, docs, sf_dir):
    """Add the ids of SentencePiece pieces."""
    from tessera.llm import pieces

    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("source_mix", mixture),
    ("sentencepiece", sentencepiece_ids),
]


def run(spark, sf_dir):
    """All stages over ``documents``: what is left, with its piece ids."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
