"""Rows of many small files leave a task together."""

import numpy as np

from rankloom.plans import catalog
from rankloom.sources import binary as B


def test_rows_of_small_files_are_pooled():
    parts = [{"path": [str(i)] * 3, "i": np.full(3, i, "int32")} for i in range(10)]
    frames = list(B.pooled(parts, 12))
    assert [len(f) for f in frames] == [12, 12, 6]
    assert [r for f in frames for r in zip(f["path"], f["i"])] == [(str(i), i) for i in range(10) for _ in range(3)]
    assert list(B.pooled([])) == []


def test_volumes_of_all_parts_are_read(spark):
    rows = catalog.QUERIES["volume_files"](spark, "/root/testdata/sf0.001").collect()
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    want = sum((p["p_size"] + i * 10) * 2 + 1 >= 60 for p in parts if p["p_partkey"] % 9 for i in range(6))
    assert len(rows) == want
