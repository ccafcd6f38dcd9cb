"""Oracle parity inside pytest: a cross-section of registered queries run
on Spark and their SQL on DuckDB over the sf0.001 tables."""

import math
import os

import pytest

import __spark_entry__ as E
from tessera.session import TABLES

from conftest import SF0001

duckdb = pytest.importorskip("duckdb")

NAMES = ["text_normalize", "word_tokens", "pattern_store", "continuation_distribution", "store_statistics",
         "vocabulary", "ratio_split", "interleave_sources", "next_token_mixture", "next_token_top_p",
         "sampled_next", "perplexity_benchmark", "knn_exact", "knn_sharded", "energy_rerank", "bleu", "rouge_2",
         "consistency", "hashed_text_vectors", "windowed_counts", "stream_incremental_store", "position_records",
         "strategy_table"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    cur = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(d_cols, cur.fetchall())
