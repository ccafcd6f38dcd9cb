"""The first patterns of each document are found without sorting all of them."""

from tessera.operators import corpus as C
from tessera.operators import patterns as P
from tessera.plans import q_corpus as Q


def test_first_hundred_patterns_need_only_the_first_positions(spark, tmp_path):
    long = " ".join(f"w{i % 37}" for i in range(400))
    texts = [(0, long), (1, "a b"), (1, long), (1, " ".join(["x"] * 150)), (None, long), (2, " ".join(f"v{i}" for i in range(101))), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))      # noqa: E731
    # rows of documents that share an id tie; their places do not
    key = ("doc_id", "position", "resolution")
    got = Q.q_first_patterns_per_doc(spark, str(tmp_path))
    plain = C.first_n_per_group(P.patterns_from_docs(docs), "doc_id", ["position", "resolution"], 100)
    assert rows(got.select(*key)) == rows(plain.select(*key)) and got.count() == 400
    assert rows(got.filter("doc_id IN (0, 2)")) == rows(plain.filter("doc_id IN (0, 2)"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "< 100)" in plan[plan.index("Generate inline"):]      # below the windows
