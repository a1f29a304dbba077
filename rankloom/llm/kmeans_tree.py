"""Nearest vectors by a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import table
from rankloom.llm.near_copies import grouped, pieces
from rankloom.llm.vectors import common_length, k_means, matrix, meetings, sample_vectors, squared_distances, tasks_of, unit, usable
from rankloom.session import cut_lineage, ship_package

#: The tree is fitted on at most so many vectors; all rows are indexed.
SAMPLE = 16_384
BRANCHES = 8
#: Rows of a leaf, on average, unless the sample is too small for so many leaves.
LEAF = 512
CALIBRATION = 128
RECALL = 0.97
NEIGHBOURS = 5


class Tree:
    """Centres of a hierarchical k-means tree; ``children[node]`` is empty for a leaf."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_number: dict[int, int] = {}
        self.grow(sample, leaf, sample.mean(0) if len(sample) else np.zeros(sample.shape[1]), 0)
        self.table = np.array(self.centres)

    def grow(self, sample: np.ndarray, leaf: int, centre: np.ndarray, depth: int) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        if len(sample) > leaf and depth < 20:
            centres = k_means(sample, min(BRANCHES, -(-len(sample) // leaf)), node)
            own = squared_distances(sample, centres).argmin(1)
            if len(centres) > 1 and len(np.unique(own)) > 1:
                self.children[node] = [self.grow(sample[own == i], leaf, c, depth + 1) for i, c in enumerate(centres) if (own == i).any()]
        if not self.children[node]:
            self.leaf_number[node] = len(self.leaf_number)
        return node

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """The leaf that each vector is indexed in, by the nearest child on every level."""
        out = np.zeros(len(values), np.int64)
        waiting = [(0, np.arange(len(values)))]
        while waiting:
            node, rows = waiting.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_number[node]
                continue
            best = squared_distances(values[rows], self.table[kids]).argmin(1)
            waiting += [(kid, rows[best == i]) for i, kid in enumerate(kids) if (best == i).any()]
        return out

    def best_bins(self, vector: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order: the queue gives the open node whose centre is nearest."""
        distance = squared_distances(vector[None, :], self.table)[0]
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_number[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (float(distance[kid]), kid))


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the same order for equal rows."""
    return (query * rows).sum(1) / np.sqrt((query * query).sum() * (rows * rows).sum(1))


def best_of(query: np.ndarray, own: int, rough: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, cosines) of the k best other rows, ties to the smaller id; ``rough`` may be off in the last bits."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        near = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9)
    else:
        near = np.arange(len(rough))
    near = near[ids[near] != own]
    exact = exact_cosine(query, rows[near])
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def search_tasks(batches: Iterable[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the k best of each query within each task."""
    for rows in grouped(batches, "task"):
        ids = rows.column("id").to_numpy()
        raw = matrix(rows.column("vector"), length)
        norm = unit(raw)
        query, found, score = [], [], []
        for members, visitors in tasks_of(rows, pieces):
            for at in range(0, len(visitors), 256):
                part = visitors[at:at + 256]
                rough = norm[part] @ norm[members].T
                for q, line in zip(part.tolist(), rough, strict=True):
                    near, exact = best_of(raw[q], ids[q], line, ids[members], raw[members], k)
                    query.append(np.full(len(near), ids[q]))
                    found.append(ids[members][near])
                    score.append(exact)
        if query:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (query, found, score)], ["query_id", "vec_id", "score"])


def top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: str, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows by cosine for all rows where ``queries`` holds.

    A k-means tree is fitted on a bounded sample of vectors and every row is put into its leaf. A query visits leaves in
    best-bin-first order. How many is calibrated: for a bounded number of queries the true neighbours are found
    by brute force over all rows, and visits are widened until ``recall`` of them lie in visited leaves. What meets in a leaf is
    scored exactly.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows with a null id, take no part.
    Ties go to the smaller id; equal vectors are candidates each; rows that share a query's id are never its
    candidates, and such repeated queries give one answer. With fewer candidates all are returned; an empty table gives no rows; other columns are
    not read. Large leaves are cut into blocks, so copies of one vector are spread.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.expr(queries).alias("asks"))
    rows = rows.filter(usable(F.col("vector")) & F.col("id").isNotNull())
    length = common_length(rows, "vector")
    rows = rows.filter(F.size("vector") == length)
    kind = rows.schema["vector"].dataType.simpleString()
    n = rows.count()
    sample = sample_vectors(rows, "vector", SAMPLE, length)
    tree = Tree(sample, max(16, round(LEAF * len(sample) / max(n, 1))))
    calibration = rows.filter("asks").dropDuplicates(["id"]).orderBy(F.xxhash64(F.lit(29), "id")).limit(CALIBRATION).collect()
    held = spark.sparkContext.broadcast((tree, [(r[0], np.array(r[1], np.float64)) for r in calibration]))

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value[0].leaves(unit(matrix(batch.column("vector"), length))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    index = cut_lineage(rows.mapInArrow(indexed, f"leaf bigint, id bigint, vector {kind}, asks boolean"))

    def truth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, leaf = batch.column("id").to_numpy(), matrix(batch.column("vector"), length), batch.column("leaf").to_numpy()
            norm, out = unit(raw), []
            for own, asked in held.value[1]:
                near, exact = best_of(asked, own, norm @ unit(asked[None, :])[0], ids, raw, k)
                out += [(own, int(ids[i]), float(s), int(leaf[i])) for i, s in zip(near, exact, strict=True)]
            q, v, s, leaves = zip(*out, strict=True) if out else ([],) * 4
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array(leaves, pa.int64())], ["query_id", "vec_id", "score", "leaf"])

    true = top(index.mapInArrow(truth, "query_id bigint, vec_id bigint, score double, leaf bigint"), k).select("query_id", "leaf").collect()
    visits = widen(tree, {r[0]: unit(np.array(r[1], np.float64)[None, :])[0] for r in calibration}, true, recall)

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = held.value[0]
            leaves = [[leaf for leaf, _ in zip(own.best_bins(v), range(visits), strict=False)] for v in unit(matrix(batch.column("vector"), length))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(leaves, pa.list_(pa.int64()))], ["id", "vector", "leaves"])

    queries_ = index.filter("asks").dropDuplicates(["id"]).select("id", "vector").mapInArrow(asked, f"id bigint, vector {kind}, leaves array<bigint>")
    visiting = queries_.select(F.explode("leaves").alias("leaf"), "id", "vector")
    met = meetings(index.select("leaf", "id", "vector"), visiting, ["leaf"], 8192, 8192)
    found = met.mapInArrow(lambda b: search_tasks(b, length, k), "query_id bigint, vec_id bigint, score double")
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def widen(tree: Tree, queries: dict, true: list, recall: float) -> int:
    """The number of leaf visits that holds the wanted share of all true neighbours."""
    order = {q: {leaf: i for i, leaf in enumerate(tree.best_bins(v))} for q, v in queries.items()}
    places = sorted(order[q][leaf] for q, leaf in true)
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1 if places else 1


def op8_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), "vec_id % 50 = 0")
