"""Near duplicates (10): arrays of a task follow a bounded run of texts."""

import random
import tracemalloc

import pyarrow as pa

from tessera.llm import neardup


def test_a_batch_takes_bounded_arrays():
    r, words = random.Random(1), [f"word{i}" for i in range(500)]
    texts = [" ".join(r.choices(words, k=800)) for _ in range(500)]
    b = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    for run in (neardup._features(25, 5), neardup._sets):
        assert sum(x.num_rows for x in run([b])) == len(texts)     # and fills the cached tables
        tracemalloc.start()
        rows = sum(x.num_rows for x in run([b]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts) and peak < 20e6
