"""What the vector operators share: usable vectors, k-means, and tasks of bounded size for cells and their visitors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

#: Members and visitors of a cell that meet in one task.
MEMBERS, VISITORS = 4096, 8192


def usable(vector: Column) -> Column:
    """Not null, finite components only, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length, of equally frequent ones the smaller; 0 for an empty table."""
    row = vectors.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row[0] if row else 0


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, length)


def unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values ** 2).sum(1, keepdims=True))


def squared_distances(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((values ** 2).sum(1)[:, None] - 2 * values @ centres.T + (centres ** 2).sum(1)[None, :], 0)


def k_means(values: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of at most k groups; fewer if there are not k different rows."""
    random = np.random.default_rng(seed)
    distinct = np.unique(values, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[random.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = squared_distances(values, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, values)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def sample_vectors(vectors: DataFrame, column: str, limit: int, length: int) -> np.ndarray:
    """At most ``limit`` different vectors, those with the smallest hash, as unit rows."""
    low = vectors.select(column, F.xxhash64(F.lit(17), column).alias("h")).dropDuplicates(["h"]).orderBy("h").limit(limit)
    rows = low.select(column).collect()
    return unit(np.array([r[0] for r in rows], np.float64).reshape(-1, length)) if rows else np.zeros((0, length))


def meetings(members: DataFrame, visits: DataFrame, cell: list[str], member_limit: int = MEMBERS, visitor_limit: int = VISITORS) -> DataFrame:
    """Rows (task, visitor, *columns) such that every visit of a cell meets every member of it in exactly one task.

    Both tables have the columns of ``cell``, an ``id`` and the same others. A cell with many members or visitors is cut into
    blocks by the hash of the id, and each block of members meets each block of visitors in a task of its own, so a cell
    with a third of all rows is spread.
    """
    counts = members.groupBy(*cell).agg(F.count("*").alias("m")).join(visits.groupBy(*cell).agg(F.count("*").alias("v")), cell)
    counts = cut_lineage(counts.select(*cell, F.ceil(F.col("m") / member_limit).cast("int").alias("m"), F.ceil(F.col("v") / visitor_limit).cast("int").alias("v")))
    others = [c for c in members.columns if c not in cell]

    def dealt(rows: DataFrame, own: str, other: str, visitor: bool) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(23), "id"), F.col(own)).cast("int")
        rows = rows.join(counts, cell).select(*cell, *others, block.alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        task = F.xxhash64(*cell, *(["other", "own"] if visitor else ["own", "other"]))
        return rows.select(task.alias("task"), F.lit(visitor).alias("visitor"), *others)

    return dealt(members, "m", "v", False).union(dealt(visits, "v", "m", True)).repartition("task").sortWithinPartitions("task")


def tasks_of(table: pa.Table, pieces) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the members and of the visitors of each task in a table sorted by task."""
    visitor = table.column("visitor").to_numpy()
    for a, b in pieces(table.column("task").to_numpy()):
        rows = np.arange(a, b)
        yield rows[~visitor[a:b]], rows[visitor[a:b]]
