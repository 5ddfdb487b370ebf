import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators.vectors import best_of, nearest


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_nearest(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(400)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [1.0] * 3), (404, rows[0][1]), (405, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    queries = [r for r in rows if r[0] % 40 == 0 or r[0] > 399]
    got = {}
    for r in nearest(df, df.where("vec_id % 40 = 0 OR vec_id > 399"), 7, block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.similarity))

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 5) + 0.0

    for i, v in queries:
        best = sorted((-cosine(v, w), j) for j, w in rows)[:7]
        assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)], i
    assert nearest(df, df.limit(0), 3).count() == 0 and nearest(df.limit(0), df, 3).count() == 0


def test_memory_of_a_task_is_bounded():
    """Products are made for as many rows as fit: a thousand rows at once took gigabytes with many queries."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(20_000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.arange(len(unit))
    rows = pa.RecordBatch.from_arrays([pa.array(ids[:1_500]), pa.array(list(unit[:1_500]))], names=["vec_id", "embedding"])
    tracemalloc.start()
    n = sum(b.num_rows for b in best_of(iter([rows]), SimpleNamespace(value=(ids, unit, np.full(len(ids), 8))), 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10 * len(ids) and peak < 250 << 20
