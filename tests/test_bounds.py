"""What a task or a batch holds doesn't grow with the input."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from tests.conftest import SF
from pyspark.ml.feature import VectorAssembler

import __spark_entry__ as E
from sparkselect.llm import near_duplicates
from sparkselect.llm.common import written
from sparkselect.operators import neighbors
from sparkselect.streaming import score


def test_rows_of_long_texts_come_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = written(spark.range(0, 500, 1, 1).mapInArrow(sizes, "n long"), "sizes", 100)
    assert [r["n"] for r in got.collect()] == [100] * 5
    assert spark.conf.get(name) == before


def test_memory_of_sketches_follows_the_group_not_the_batch():
    rnd = np.random.default_rng(3)
    text = lambda: " ".join(map(str, rnd.integers(0, 3000, 20_000)))

    def peak(n):
        batch = pa.record_batch({"doc_id": pa.array(range(n)), "text": [text() for _ in range(n)], "row_key": pa.array(range(n))})
        tracemalloc.start()
        rows = sum(b.num_rows for b in near_duplicates._sketch(4, 32)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most

    assert peak(72) < 1.6 * peak(20)


def test_running_counts_lie_in_few_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(score, "_paths", lambda spark, tag: (f"{tmp_path}/out", f"{tmp_path}/state"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        E.queries()["st_stream_running_metrics"](spark, SF)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in os.listdir(tmp_path / "state" / "state" / "0") if p.isdigit()]) == 8


def test_neighbours_by_boxes_and_in_small_matrices(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MATRIX_CELLS", 5_000)
    rnd = np.random.default_rng(4)
    for dims in (3, 20):  # 20: no boxes
        cols = [f"c{i}" for i in range(dims)]
        b = rnd.integers(0, 9, (2500, dims)).astype(float)
        q = np.vstack([rnd.integers(0, 9, (30, dims)), rnd.uniform(8, 12, (10, dims))])
        frame = lambda x, key: VectorAssembler(inputCols=cols, outputCol="x").transform(
            spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"{key} long, " + ", ".join(f"{c} double" for c in cols)))
        got = neighbors.knn_candidates(frame(q, "q"), frame(b, "k"), 4, "q", "k", "x", "x").select("q", "nb_rank", "k").collect()
        far = ((q[:, None, :] - b[None]) ** 2).sum(axis=2)
        want = [(i, r + 1, int(k)) for i in range(len(q)) for r, k in enumerate(np.lexsort((np.arange(len(b)), far[i]))[:4])]
        assert sorted(tuple(r) for r in got) == want
