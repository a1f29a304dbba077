"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import cut_lineage, ship_package

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def split_words(text: str | None) -> list[str]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.

    ``str.split`` also cuts at other Unicode spaces, so it is used only where it means the same.
    """
    if not text:
        return []
    if text.isascii():
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in text.translate(_ASCII_SPACES).split(" ") if w]
        return text.split()
    return [w for w in text.translate(_ASCII_SPACES).split(" ") if w]


_ASCII_SPACES = {c: " " for c in range(9, 14)}
_LOWER_ASCII = {c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else, as the contracts ask."""
    return text.lower() if text.isascii() else text.translate(_LOWER_ASCII)


class Memo(dict):
    """Remembers ``make(key)``. Once it holds ``limit`` entries, ``trim`` keeps the short keys alone, which come again most often, so memory is bounded."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def trim(self):
        if len(self) > self.limit:
            short = {k: v for k, v in self.items() if len(k) <= 6}
            self.clear()
            if 2 * len(short) <= self.limit:
                self.update(short)


def release_memory() -> None:
    """Hands what is free in this process back to the system, where the C library can.

    Python workers outlive their tasks, and the next stage's tasks, or Spark's own, need the memory beside them.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, after which its memory is handed back."""
    yield from rows
    del rows
    release_memory()


def sized_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterable[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        size, start, total = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), 0, 0
        if size.sum() <= limit:
            yield batch
            continue
        for i, n in enumerate(size):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component, for a graph that fits one task."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds until nothing changes.

    Returns (node, root) for every node that has an edge; root is the smallest node of its component.
    Minima are pre-aggregated per map task and joined back, so a node with a third of all edges
    is no single group. Each round is checkpointed; superseded rounds are dropped by Spark's cleaner.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    now = cut_lineage(now)
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.filter("u <> v").distinct())
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
