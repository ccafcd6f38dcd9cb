"""Usage log with eviction by recency; observed sums against the written table."""

from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.operators import vector_index as VI
from tessera.streaming import progress as PR
from tessera.streaming import usage as U

from conftest import SF0001


def log(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, s BIGINT").select("vec_id", F.timestamp_seconds("s").alias("at"))


def test_ties_go_to_the_latest_use_and_replays_count_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, 10), (1, 11), (2, 5)], [(2, 50), (3, 20), (4, 20)], [(5, 1)]):
        log(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("vec_id BIGINT, at TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(src)
        U.run_usage(stream, out, str(tmp_path / "ckpt")).awaitTermination()
    U.usage_writer(out)(log(spark, [(5, 1)]), 2)               # the last batch again
    used = U.usage(spark, out)
    assert {(r.vec_id, r.usage, int(r["last"].timestamp())) for r in used.collect()} == {(1, 2, 11), (2, 2, 50), (3, 1, 20), (4, 1, 20), (5, 1, 1)}
    ids = spark.range(1, 9).withColumnRenamed("id", "vec_id")
    keep = lambda n: [r.vec_id for r in U.retained(ids, used, DEFAULT.replace(max_index_size=n)).collect()]
    assert sorted(keep(1)) == [2]                              # same usage as 1, used later
    assert sorted(keep(3)) == [1, 2, 3]                        # 3 and 4 tie in both: the smaller id
    assert sorted(keep(6)) == [1, 2, 3, 4, 5, 6] and len(keep(99)) == 8
    assert U.usage(spark, str(tmp_path / "none")).count() == 0


def test_an_index_shrinks_to_its_size(spark, tmp_path):
    vecs = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 0.1]) for i in range(200)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    index = VI.build(vecs, str(tmp_path / "i"), "ivf", DEFAULT.replace(retrieval_k=2))
    used = spark.createDataFrame([(i, 1) for i in range(50, 90)], "vec_id BIGINT, usage BIGINT").withColumn("last", F.timestamp_seconds("vec_id"))
    assert U.evict(index, used, DEFAULT.replace(max_index_size=200)) == 0
    assert U.evict(index, used, DEFAULT.replace(max_index_size=30)) == 170
    assert sorted(r.vec_id for r in index.lists().collect()) == list(range(60, 90))


def test_observed_sums_equal_the_table(spark, tmp_path):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    seen = PR.write_observed(d, str(tmp_path / "t"), PR.text_sums())
    again = spark.read.parquet(str(tmp_path / "t")).agg(*PR.text_sums()).first()
    assert (seen["docs"], seen["chars"], seen["words"]) == (again.docs, again.chars, again.words)
    assert PR.write_observed(d.limit(0), str(tmp_path / "e"), PR.text_sums())["docs"] == 0


def test_stream_progress_and_listener(spark, tmp_path):
    d = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    src = str(tmp_path / "in")
    for b in range(3):
        d.filter(F.col("doc_id") % 3 == b).coalesce(1).write.mode("append").parquet(src)
    stream = PR.observed(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src), "texts", PR.text_sums())
    listener = PR.ProgressLog("texts")
    spark.streams.addListener(listener)
    try:
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        rows = PR.recent(q, "texts", spark).collect()
    finally:
        spark.streams.removeListener(listener)
    table = spark.read.parquet(str(tmp_path / "out"))
    assert [r.batch_id for r in rows] == [0, 1, 2]
    assert [r.docs for r in rows] == [table.filter(F.col("doc_id") % 3 == b).count() for b in range(3)]
    assert sum(r.words for r in rows) == table.agg(*PR.text_sums()).first().words
