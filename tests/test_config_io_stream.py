import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.config import Config
from tessera.operators import corpus as C
from tessera.operators import patterns as P
from tessera.sources import io
from tessera.streaming import incremental as S

from conftest import SF0001, SF001


@pytest.mark.parametrize("kw", [dict(resolutions=()), dict(pattern_stride=0), dict(temperature=-1.0),
                                dict(top_p=1.5), dict(similarity_metric="manhattan"),
                                dict(resolution_weights=(0.5, 0.5)), dict(resolutions=(1, 2), resolution_weights=(0.3, 0.3))])
def test_invalid_configs(kw):
    with pytest.raises(ValueError):
        Config(**kw).validate()


def test_config_roundtrip(spark, tmpdir_path):
    c = Config(resolutions=(1, 2), resolution_weights=(0.25, 0.75), top_k=7).validate()
    p = os.path.join(tmpdir_path, "cfg")
    c.save(spark, p)
    assert Config.load(spark, p) == c


def test_store_save_load(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    store = P.pattern_store(docs)
    io.save_store(store, tmpdir_path, Config(), max_records_per_file=5000)
    back, cfg = io.load_store(spark, tmpdir_path)
    cols = ["pattern", "resolution", "cnt", "n_next", "top_next", "top_cnt"]
    assert back.select(*cols).exceptAll(store.select(*cols)).count() == 0
    assert store.select(*cols).exceptAll(back.select(*cols)).count() == 0
    assert cfg == Config()
    shards = [f for d, _, fs in os.walk(os.path.join(tmpdir_path, "store")) for f in fs if f.endswith(".parquet")]
    assert len(shards) >= store.count() // 5000


def test_text_dir_and_json(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    d = os.path.join(tmpdir_path, "txt")
    io.write_text_files(docs, d)
    back = io.read_text_dir(spark, d, min_chars=50)
    from tessera.functions import text as T
    want = docs.filter(F.length(T.strip("text")) > 50).count()
    assert back.count() == want
    j = os.path.join(tmpdir_path, "arr")
    io.write_json_string_array(docs, j, "doc_id")
    arr = io.read_json_string_array(spark, j)
    assert arr.count() == docs.count()
    assert arr.orderBy("idx").first()["text"] == docs.orderBy("doc_id").first()["text"]
    jl = os.path.join(tmpdir_path, "jl")
    io.write_jsonl(docs.select(F.col("doc_id").alias("id"), "text"), jl)
    assert io.read_jsonl(spark, jl).count() == docs.count()


def test_split_counts_exact(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id")
    s = {r["split"]: r["count"] for r in C.ratio_split(d, 42, "doc_id").groupBy("split").count().collect()}
    assert s == {"train": 800, "validation": 100, "test": 100}


def test_incremental_equals_rebuild_with_restart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    parts = [docs.filter(F.col("doc_id") % 3 == i) for i in range(3)]
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    for i, p in enumerate(parts[:2]):
        p.coalesce(1).write.parquet(os.path.join(tmpdir_path, f"tmp{i}"))
        f = [x for x in os.listdir(os.path.join(tmpdir_path, f"tmp{i}")) if x.endswith(".parquet")][0]
        shutil.copy(os.path.join(tmpdir_path, f"tmp{i}", f), os.path.join(src, f"part{i}.parquet"))
    stream = S.stream_dir(spark, src, docs.schema, max_files=1)
    S.run_incremental(stream, out, ck).awaitTermination()
    # restart after a new file arrives: only the new file is processed
    parts[2].coalesce(1).write.parquet(os.path.join(tmpdir_path, "tmp2"))
    f = [x for x in os.listdir(os.path.join(tmpdir_path, "tmp2")) if x.endswith(".parquet")][0]
    shutil.copy(os.path.join(tmpdir_path, "tmp2", f), os.path.join(src, "part2.parquet"))
    S.run_incremental(S.stream_dir(spark, src, docs.schema, max_files=1), out, ck).awaitTermination()
    inc = S.store_from_deltas(spark, out, 2)[1]
    full = P.pattern_store(docs)
    cols = ["pattern", "cnt", "n_next", "top_next"]
    assert inc.select(*cols).exceptAll(full.select(*cols)).count() == 0
    assert full.select(*cols).exceptAll(inc.select(*cols)).count() == 0
    batches = spark.read.parquet(os.path.join(out, "deltas")).select("batch_id").distinct().count()
    assert batches == 3


def test_decayed_counter_matches_batch(spark):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    st = E.queries()["decayed_counter"](spark, SF0001)  # streaming run, state per event type
    got = {r["key"]: r["weight"] for r in st.collect()}
    import math
    rows = ev.select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("h")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["event_type"], []).append(r["h"])
    for k, hs in by.items():
        m = max(hs)
        assert abs(got[k] - round(sum(math.exp(-0.01 * (m - h)) for h in hs), 6)) < 1e-5


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"pattern", "resolution", "cnt", "top_next", "top_prob"}
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100
