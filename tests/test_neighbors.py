import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainframe.operators import neighbors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_memory_of_a_comparison_does_not_grow_with_the_points():
    rng = np.random.default_rng(1)
    peaks = []
    for n in (20_000, 100_000):
        b, ids = unit(rng.standard_normal((n, 8))), np.arange(n)
        tracemalloc.start()
        rows, columns, found = neighbors._top(b[:200], ids[:200], b, ids, 5)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        cos = b[:200] @ b.T
        cos[ids[:200], ids[:200]] = -2
        assert len(rows) == 1000 and np.allclose(found, -np.sort(-cos, 1)[:, :5].reshape(-1))
    assert peaks[1] < 1.2 * peaks[0] < 40e6


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_copies_are_ties_settled_by_id(spark, limit):
    """Tiles of odd sizes, in which a plain product gives equal vectors cosines that differ in the last bit."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 4_511)]
    points = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(x))), "x": pa.array(x.tolist())}))
    group = {v.tobytes(): k for k, v in enumerate(x)}
    same = np.array([group[v.tobytes()] for v in x])
    asked = neighbors.knn(points, 7, block=1_000, broadcast_bytes=limit).groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("j")).collect()
    assert len(asked) == len(x)
    for r in asked:
        copies = np.flatnonzero(same == same[r["i"]])
        assert r["j"] == copies[copies != r["i"]][:7].tolist()


def test_points_named_by_strings_and_few_points(spark):
    points = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [0.0, 1.0]), ("z", [0.0, 0.0])], "i string, x array<double>")
    for limit in (1 << 20, 0):
        found = {(r["i"], r["j"]): r["d"] for r in neighbors.knn(points, 2, block=2, broadcast_bytes=limit).collect()}
        assert found == {("a", "b"): 0.0, ("a", "z"): 1.0, ("b", "a"): 0.0, ("b", "z"): 1.0, ("z", "a"): 1.0, ("z", "b"): 1.0, ("é", "a"): 1.0, ("é", "b"): 1.0}
        assert not neighbors.knn(points.limit(0), 2, broadcast_bytes=limit).collect()


def test_points_stream_by_a_block_so_a_task_does_not_hold_them():
    """Tasks of as many queries, by 20,000 and by 100,000 points: before, a task held all points that it compared."""
    rng = np.random.default_rng(3)
    peaks = []
    for n in (20_000, 100_000):
        x = rng.standard_normal((n, 16)).astype("float32")

        def batches(n=n, x=x):
            for asks, upto in ((True, 600), (False, n)):
                for at in range(0, upto, 5_000):
                    part = x[at : min(at + 5_000, upto)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, 16, dtype="int32")), pa.array(part.reshape(-1)))
                    same = [pa.array(np.full(len(part), v)) for v in (0, 0, asks)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(at, at + len(part))), lists], ["q", "p", "asks", "i", "x"])

        tracemalloc.start()
        before = pa.total_allocated_bytes()
        held, found = 0, []
        for batch in neighbors._compared(5)(batches()):
            held = max(held, pa.total_allocated_bytes() - before)
            found.append(batch)
        peaks.append(tracemalloc.get_traced_memory()[1] + held)
        tracemalloc.stop()
        table = pa.Table.from_batches(found)
        cos = unit(x[:600].astype(float)) @ unit(x.astype(float)).T
        cos[np.arange(600), np.arange(600)] = -2
        assert table["i"].to_pylist() == np.repeat(np.arange(600), 5).tolist()
        assert table["j"].to_pylist() == np.argsort(-cos, 1, kind="stable")[:, :5].reshape(-1).tolist()
    assert peaks[1] < 1.2 * peaks[0] < 40e6


def test_blocks_are_not_gathered_by_python_groups(spark):
    """A grouped Arrow function gets its group whole; before, the blocks were such groups. Batches of any size give the same rows."""
    x = np.random.default_rng(4).standard_normal((700, 8))
    points = spark.createDataFrame(pa.table({"i": pa.array([f"p{k}" for k in range(700)]), "x": pa.array(x.tolist())}))
    sizes = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(sizes)
    every = sorted(map(tuple, neighbors.knn(points, 4).select("i", "j").collect()))
    assert len(every) == 2_800
    try:
        spark.conf.set(sizes, "37")
        found = neighbors.knn(points, 4, block=90, broadcast_bytes=0)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.select("i", "j").collect())) == every
    finally:
        spark.conf.set(sizes, usual)
