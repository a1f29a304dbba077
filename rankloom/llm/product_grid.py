"""Near-copies among vectors by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import components, table, union_find
from rankloom.llm.near_copies import grouped, pieces
from rankloom.llm.vectors import common_length, k_means, matrix, meetings, sample_vectors, squared_distances, tasks_of, unit, usable
from rankloom.session import cut_lineage, ship_package

SIMILARITY = 0.93
#: A pair just at the threshold lies in a visited cell with this chance; nearer pairs with a higher one.
RECALL = 0.999
#: Codebooks and the number of visits are fitted on at most so many vectors.
SAMPLE = 8192
#: Vectors of a label in a cell, on average.
CELL = 64
MOST_CENTRES = 256


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells of a product grid in ascending order of the summed distances to the centres of both halves."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(float(first[rows[0]] + second[columns[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(rows[i]), int(columns[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(rows) and b < len(columns) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (float(first[rows[a]] + second[columns[b]]), a, b))


class Grid:
    """Two independent codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, per_half: int, similarity: float, recall: float):
        self.half = (sample.shape[1] + 1) // 2
        self.first = k_means(sample[:, :self.half], per_half, 1)
        self.second = k_means(sample[:, self.half:], per_half, 2) if sample.shape[1] > 1 else np.zeros((1, 0))
        self.visits = self.calibrate(sample[:2048], similarity, recall)

    def distances(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared_distances(values[:, :self.half], self.first), squared_distances(values[:, self.half:], self.second)

    def calibrate(self, sample: np.ndarray, similarity: float, recall: float) -> int:
        """Visits that reach partners drawn at exactly the threshold, in random directions, with the wanted recall."""
        random = np.random.default_rng(3)
        aside = random.normal(size=(4, *sample.shape))
        ranks = []
        for noise in aside:
            noise -= (noise * sample).sum(1, keepdims=True) * sample
            length = np.sqrt((noise ** 2).sum(1, keepdims=True))
            partner = similarity * sample + math.sqrt(1 - similarity ** 2) * noise / np.maximum(length, 1e-300)
            one, two = self.distances(sample)
            p_one, p_two = self.distances(partner)
            at = np.arange(len(sample))
            home = one[at, p_one.argmin(1)] + two[at, p_two.argmin(1)]
            ranks.append(((one[:, :, None] + two[:, None, :]) < home[:, None, None]).sum((1, 2)) + 1)
        return int(np.quantile(np.concatenate(ranks), recall, method="higher")) if len(sample) else 1

    def cells(self, values: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, its own first."""
        one, two = self.distances(values)
        width, out = len(self.second), []
        for a, b in zip(one, two, strict=True):
            path = multi_sequence(a, b)
            out.append([i * width + j for (i, j), _ in zip(path, range(self.visits), strict=False)])
        return out


def linked(batches: Iterable[pa.RecordBatch], length: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(id, links, root) of the vectors with links in each task; a pair counts once, whichever of both visits the other's cell."""
    for rows in grouped(batches, "task"):
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        values = unit(matrix(rows.column("vector"), length))
        visits = rows.column("cells").to_pylist()
        home = np.array([v[0] for v in visits])
        out = []
        for members, visitors in tasks_of(rows, pieces):
            if not len(members) or not len(visitors):
                continue
            left, right = [], []
            for at in range(0, len(visitors), 1024):
                part = visitors[at:at + 1024]
                i, j = np.nonzero(values[part] @ values[members].T >= similarity)
                left.append(part[i])
                right.append(members[j])
            left, right = np.concatenate(left), np.concatenate(right)
            other = ids[left] != ids[right]
            left, right = left[other], right[other]
            # the pair with the larger visitor is left to the other direction, if that one visits too
            once = np.array([ids[a] < ids[b] or home[a] not in visits[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)], bool)
            left, right = left[once], right[once]
            if not len(left):
                continue
            used, place = np.unique(np.concatenate((ids[left], ids[right])), return_inverse=True)
            i, j = place[:len(left)], place[len(left):]
            n = np.bincount(i, copies[right], len(used)) + np.bincount(j, copies[left], len(used))
            out.append((used, n.astype(np.int64), used[union_find(len(used), i, j)]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "links", "root"])


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                 recall: float = RECALL) -> DataFrame:
    """Links among vectors of one label: (vec_id, n_links, component_id, kept), one row a vector.

    Equal vectors of a label are merged and counted. The halves of unit vectors are quantised by two codebooks, whose product
    is the grid; each vector lies in one cell and visits the nearest cells in multi-sequence order, as many as
    partners drawn at the threshold need for ``recall``. What meets in a cell is verified by the cosine in
    double precision; a pair is found if either of both visits the other.

    Null labels, and vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing:
    0 links, their own component, kept. Repeated rows link with each other. A vec_id may repeat: each of its vectors is one of its own. Rows with a null id are never
    the smallest of a component unless alone. An empty table gives no rows; other columns are not read.
    Hot cells are cut into blocks; sums and stars are written, never pairs.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    valid = rows.filter(usable(F.col("vector")) & F.col("label").isNotNull())
    length = common_length(valid, "vector")
    valid = valid.filter(F.size("vector") == length)
    least = F.min("vec_id")
    sets = valid.groupBy("label", "vector").agg(least.alias("least"), F.count("*").alias("copies"))
    sets = cut_lineage(sets.withColumn("id", F.xxhash64("label", "vector")))  # vec_id may repeat
    n, labels = sets.agg(F.count("*"), F.countDistinct("label")).first()
    sample = sample_vectors(sets, "vector", SAMPLE, length)
    per_half = min(MOST_CENTRES, max(2, round(math.sqrt(n / (max(1, labels) * CELL)))))
    held = spark.sparkContext.broadcast(Grid(sample, per_half, similarity, recall) if n else None)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = held.value.cells(unit(matrix(batch.column("vector"), length))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kind = {f.name: f.dataType.simpleString() for f in sets.schema}
    at = sets.select("label", "id", "copies", "vector")
    cells = cut_lineage(at.mapInArrow(placed, f"label {kind['label']}, id bigint, copies bigint, vector {kind['vector']}, cells array<int>"))
    members = cells.select("label", F.col("cells")[0].alias("cell"), "id", "copies", "vector", "cells")
    visits = cells.select("label", F.explode("cells").alias("cell"), "id", "copies", "vector", "cells")
    found = cut_lineage(meetings(members, visits, ["label", "cell"]).mapInArrow(lambda b: linked(b, length, similarity), "id bigint, links bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    known = sets.join(links, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = cut_lineage(known.select("label", "vector", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "vector", "n_links", "component_id")
    result = rows.withColumn("valid", usable(F.col("vector"))).alias("r").join(
        known.alias("k"), F.col("r.valid") & (F.col("r.label") == F.col("k.label")) & (F.col("r.vector") == F.col("k.vector")), "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
