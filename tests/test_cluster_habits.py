"""What must hold off one machine: shipped code, tables of several files,
late rows, compaction, saved models, arrays in several files."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera import session
from tessera.config import Config
from tessera.operators import dist as D
from tessera.operators import patterns as P
from tessera.plans import q_stream
from tessera.plans.q_dist import RES
from tessera.sources import io
from tessera.streaming import incremental as S

from conftest import SF0001


def test_kernels_run_from_a_foreign_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import importlib.util, sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        spec = importlib.util.spec_from_file_location("entry", {repo + "/__spark_entry__.py"!r})
        e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
        print("ROWS", e.queries()["knn_exact"](spark, {SF0001!r}).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1000" in out.stdout, out.stderr[-2000:]


def test_no_private_folder_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The sf0.001 tables that streams read, each as a folder of three files."""
    at = tmp_path_factory.mktemp("tables")
    for t in ("documents", "benchmark", "events"):
        df = spark.read.parquet(f"{SF0001}/{t}.parquet")
        if t == "events":       # later files hold later events
            cuts = [r.c for r in df.select(F.expr("percentile(unix_micros(cast(ts as timestamp)), array(0.33, 0.66)) AS c")).collect()][0]
            part = F.when(F.unix_micros(F.col("ts").cast("timestamp")) < cuts[0], 0) \
                    .when(F.unix_micros(F.col("ts").cast("timestamp")) < cuts[1], 1).otherwise(2)
        else:
            part = F.pmod(F.hash("text"), F.lit(3))
        for i in range(3):
            df.filter(part == i).coalesce(1).write.mode("append").parquet(str(at / f"{t}.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["stream_incremental_store", "stream_running_stats", "stream_union", "windowed_counts",
                                  "decayed_window_counts", "decayed_counter"])
def test_streams_over_tables_of_several_files(spark, many_files, name):
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(E.queries()[name](spark, many_files)) == key(E.queries()[name](spark, SF0001))


def test_late_rows_are_dropped_and_replays_do_not_count_twice(spark, tmp_path):
    schema = "event_type string, ts timestamp"
    for i, hours in enumerate([["2024-01-01 10:05:00", "2024-01-01 20:05:00"], ["2024-01-01 20:30:00"], ["2024-01-01 10:30:00", "2024-01-01 21:10:00"]]):
        df = spark.createDataFrame([("a", h) for h in hours], "event_type string, ts string").select("event_type", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = S.stream_dir(spark, str(tmp_path), spark.createDataFrame([], schema).schema, glob="events.parquet", max_files=1)
    w = S.windowed_counts(stream, "event_type", "ts", "1 hour", "2 hours")
    rows = q_stream.run_to_table(w, spark, "late", ["w", "event_type"])
    got = {r.w.start.hour: r.n for r in rows.collect()}
    assert got == {10: 1, 20: 2, 21: 1}          # the row of 10:30 came after the watermark had passed its window


def test_compaction_is_read_and_counts_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = str(tmp_path / "out")
    write = S.delta_writer(out)
    parts = [docs.filter(F.col("doc_id") % 3 == i) for i in range(3)]
    write(parts[0], 0)
    write(parts[1], 1)
    assert S.compact(spark, out) == 1
    write(parts[1], 1)                           # a replayed batch that the base holds already
    write(parts[2], 2)
    cols = ["pattern", "resolution", "next", "cnt"]
    full = P.continuation_counts(P.patterns_from_docs(docs)).select(cols)
    for _ in range(2):
        cont = S.store_from_deltas(spark, out)[0].select(cols)
        assert cont.exceptAll(full).isEmpty() and full.exceptAll(cont).isEmpty()
        S.compact(spark, out)


def test_a_loaded_model_answers_like_the_saved_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    cont = P.continuation_counts(P.patterns_from_docs(docs))
    store = P.build_store(cont, 2)
    vectors = spark.read.parquet(f"{SF0001}/embeddings.parquet")
    metrics = spark.createDataFrame([("r", 1, "n", 2.0)], io.METRICS_SCHEMA)
    io.save_model(cont, store, str(tmp_path / "m"), Config(top_k=9), vectors, metrics)
    m = io.load_model(spark, str(tmp_path / "m"))
    assert m["config"].top_k == 9 and m["metrics"].collect() == metrics.collect()
    b = P.tokenize_docs(spark.read.parquet(f"{SF0001}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"), balance=False)
    suf = D.context_suffixes(b, ["doc_id"], RES)
    weights = spark.createDataFrame([(r, 1.0) for r in RES], "resolution int, weight double")
    key = lambda df: sorted((r.doc_id, r.token, round(r.prob, 9)) for r in df.collect())
    assert key(D.mixture(suf, m["continuations"], m["store"], ["doc_id"], weights)) == key(D.mixture(suf, cont, store, ["doc_id"], weights))
    assert m["vectors"].count() == vectors.count()
    assert io.load_model(spark, str(tmp_path / "m"))["store"].count() == store.count()


def test_arrays_over_several_files_keep_order_and_quoting(spark, tmp_path):
    rows = [(i, f'te"xt\n{i}\\ é') for i in range(50)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_json_string_array(df, str(tmp_path / "a"), "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = io.read_json_string_array(spark, str(tmp_path / "a"))
    assert back.select("path").distinct().count() > 1
    got = sorted((int(r.path.split("part=")[1].split("/")[0]), r.idx, r.text) for r in back.collect())
    assert [t for _, _, t in got] == [t for _, t in rows]


@pytest.mark.parametrize("kw", [dict(pq_ks=0), dict(nprobe=0), dict(tokenizer="x"), dict(top_k=-1)])
def test_rules_name_the_field(kw):
    with pytest.raises(ValueError, match=next(iter(kw))):
        Config(**kw).validate()
