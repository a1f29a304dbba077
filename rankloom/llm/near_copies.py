"""Near-duplicate texts by a chosen-path join over word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Memo, components, released, row_key, sized_batches, table, union_find
from rankloom.session import cut_lineage, ship_package

WORDS = 5
SIMILARITY = 0.8
#: Hash functions that a set is embedded with; a pair agrees in each with a chance equal to its Jaccard similarity.
COORDINATES = 64
#: A pair whose sketches agree in fewer coordinates is no candidate; at 0.8 a pair has fewer with a chance of 1e-4.
AGREE = 38
RECALL = 0.99999
#: Rows of a bucket that are compared in one task; buckets of up to DIRECT times as many are compared in pairs of blocks, larger ones
#: are split on further coordinates first, DEPTH levels at most.
BUCKET, DIRECT = 2048, 8
DEPTH = 3
#: Shingles that one task verifies at once.
WEIGHT = 1 << 21

_ODD = np.random.default_rng(20).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 63, COORDINATES, np.uint64)
_POWERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)]


def word_hashes(text: bytes | None, memo: Memo) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, memo: Memo) -> np.ndarray:
    """Distinct hashes of all runs of five words, ascending; a shorter text is one run. No words: an empty set."""
    words = word_hashes(text, memo)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(min(WORDS, len(words))))
        for i in range(min(WORDS, len(words))):
            total = (total + words[i:i + n]) * np.uint64(_POWERS[1]) ^ (total >> np.uint64(29))
        total ^= total >> np.uint64(32)
    return np.unique(total)


def sketch(values: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, upper 32 bits."""
    with np.errstate(over="ignore"):
        least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 4096):
            part = values[at:at + 4096]
            mixed = part[None, :] * _ODD[:, None] + _ADD[:, None]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, mixed.min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size, set_hash, sketch) of each text; set_hash tells equal sets."""
    memo = Memo(xxhash.xxh64_intdigest, 500_000)
    for batch in sized_batches(batches, "text"):
        size, digest, drawn = [], [], []
        for text in batch.column("text"):
            values = shingles(text.as_py(), memo)
            size.append(len(values))
            digest.append(xxhash.xxh128_digest(values.tobytes()) if len(values) else None)
            drawn.append(sketch(values).tobytes() if len(values) else None)
        memo.trim()
        yield pa.record_batch([batch.column("key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(drawn, pa.binary())],
                              ["key", "size", "set_hash", "sketch"])


def coordinates_for(recall: float, similarity: float, depth: int) -> int:
    """Coordinates to split on, so that a pair at the threshold agrees in none of them on some level with a chance of at most 1 - recall."""
    return min(COORDINATES, math.ceil(math.log((1 - recall) / depth) / math.log(max(1 - similarity, 1e-9))))


def chosen(path: np.ndarray, take: int) -> np.ndarray:
    """For each path, the coordinates to split on; they depend on nothing else, so both sets of a pair choose the same."""
    with np.errstate(over="ignore"):
        mixed = path[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDINATES, dtype=np.uint64)[None, :] * np.uint64(2654435761) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.argsort(mixed, 1, kind="stable")[:, :take]


def split(batches: Iterable[pa.RecordBatch], take: int) -> Iterator[pa.RecordBatch]:
    """Children (path, rep) of rows (path, rep, sketch): one for each chosen coordinate, named by its value."""
    for batch in batches:
        path = batch.column("path").to_numpy().view(np.uint64)
        values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
        at = chosen(path, take).ravel()
        row = np.repeat(np.arange(len(path)), take)
        with np.errstate(over="ignore"):
            child = (path[row] ^ (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15) + values[row, at]
            child ^= child >> np.uint64(33)
            child *= np.uint64(0xFF51AFD7ED558CCD)
        yield pa.record_batch([pa.array(child.view(np.int64)), batch.column("rep").take(pa.array(row))], ["path", "rep"])


def bucket_stars(rep: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a candidate group of a bucket with the group's smallest one; members of one group aren't compared again."""
    order = np.argsort(rep)
    rep, values = rep[order], values[order]
    root, rest, left = np.arange(len(rep)), np.arange(len(rep)), values
    while len(rest) > 1:
        first, open_ = rest[0], [rest[0]]
        rest, left = rest[1:], left[1:]
        while open_ and len(rest):
            near = (left == values[open_.pop()]).sum(1) >= AGREE
            if near.any():
                open_ += rest[near].tolist()
                root[rest[near]] = first
                rest, left = rest[~near], left[~near]
    joined = np.flatnonzero(root != np.arange(len(rep)))
    return rep[joined], rep[root[joined]]


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables with whole groups of a partition that is sorted by ``key``."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if waiting and waiting[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def pieces(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def brute_force(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate stars (a, b) of all buckets of a partition that is sorted by path."""
    for rows in grouped(batches, "path"):
        path, rep = rows.column("path").to_numpy(), rows.column("rep").to_numpy()
        values = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
        found = [bucket_stars(rep[a:b], values[a:b]) for a, b in pieces(path) if b - a > 1]
        if found:
            left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch([pa.array(left), pa.array(right)], ["a", "b"])


def candidates(sets: DataFrame, similarity: float, recall: float, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """Candidate edges (a, b) between sets (rep, sketch): stars within the candidate groups of each bucket.

    Buckets of more than ``bucket`` sets come from passages that many texts share, and from large groups of copies. They are
    compared in pairs of blocks or, beyond DIRECT times the limit, split again on coordinates chosen by the path, and
    compared in pairs of blocks on the last level. No set leaves a bucket, so a pair is met if it agrees in one
    of the chosen coordinates, whatever the sizes of the buckets.
    """
    take = coordinates_for(recall, similarity, depth)
    now = sets.select(F.lit(0).cast("long").alias("path"), "rep", "sketch")
    edges = None
    for level in range(depth):
        children = cut_lineage(now.mapInArrow(lambda b: split(b, take), "path bigint, rep bigint"))
        sizes = children.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        kept = cut_lineage(children.join(sizes, "path"))
        most = bucket * DIRECT if level < depth - 1 else None
        named = kept.filter(F.col("n") <= bucket).select("path", "rep").join(sets.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
        own = cut_lineage(named.repartition("path").sortWithinPartitions("path").mapInArrow(brute_force, "a bigint, b bigint").distinct())
        edges = own if edges is None else edges.union(own)
        large = kept.filter(F.col("n") > bucket)
        direct = large.filter(F.col("n") <= most) if most else large
        if not direct.isEmpty():
            rows = direct.select("path", "rep").join(sets.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
            edges = edges.union(cut_lineage(block_edges(rows, direct.groupBy("path").agg(F.count("*").alias("n")), bucket)))
        if not most:
            break
        now = large.filter(F.col("n") > most).select("path", "rep").join(sets.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
        if now.isEmpty():
            break
    return edges


def block_edges(rows: DataFrame, sizes: DataFrame, bucket: int) -> DataFrame:
    """Candidate edges in buckets that one task can't hold: blocks of the bucket, each pair of blocks in a task of its own."""
    blocks = F.ceil(F.col("n") * 2 / F.lit(bucket)).cast("int")
    dealt = rows.join(sizes, "path").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(9), "rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("path", "rep", "sketch", "own", other)
    task = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    return (pairs.select(task.alias("path"), "rep", "sketch").repartition("path").sortWithinPartitions("path")
            .mapInArrow(brute_force, "a bigint, b bigint").distinct())


class Verifier:
    """Exact Jaccard links among sets of one group."""

    def __init__(self, rep: np.ndarray, copies: np.ndarray, values: list[np.ndarray], block: np.ndarray, similarity: float):
        self.rep, self.copies, self.values, self.block, self.similarity = rep, copies, values, block, similarity

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i < j) of all pairs with a similarity from the threshold on, by counting shared shingles."""
        size = np.array([len(v) for v in self.values])
        owner = np.repeat(np.arange(len(size)), size)
        flat = np.concatenate(self.values)
        order = np.argsort(flat, kind="stable")
        flat, owner_sorted = flat[order], owner[order]
        first = np.append(np.flatnonzero(np.diff(flat, prepend=flat[0] - np.uint64(1))), len(flat))
        term = np.empty(len(flat), np.int64)
        term[order] = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ends, left, right = np.cumsum(size), [], []
        for i in range(len(size) - 1):
            own = term[ends[i] - size[i]:ends[i]]
            count = first[own + 1] - first[own]
            total = np.cumsum(count)
            place = np.repeat(first[own] - (total - count), count) + np.arange(total[-1])
            shared = np.bincount(owner_sorted[place], minlength=len(size))[i + 1:]
            near = np.flatnonzero(shared >= self.similarity * (size[i] + size[i + 1:] - shared) - 1e-9) + i + 1
            left.append(np.full(len(near), i))
            right.append(near)
        return np.concatenate(left), np.concatenate(right)


def verify(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) rows of the groups of a partition that is sorted by task.

    A task holds a whole candidate group or two of its blocks. Links between blocks count in the task of both, links
    within a block in the task of that block with itself.
    """
    memo = Memo(xxhash.xxh64_intdigest, 500_000)
    for rows in grouped(batches, "task"):
        task = rows.column("task").to_numpy()
        reps, copies, block = (rows.column(c).to_numpy() for c in ("rep", "copies", "block"))
        within, texts = rows.column("within").to_numpy(), rows.column("text")
        out = []
        for a, b in pieces(task):
            if b - a < 2:
                continue
            order = np.argsort(reps[a:b]) + a
            own = Verifier(reps[order], copies[order], [shingles(texts[int(i)].as_py(), memo) for i in order], block[order], similarity)
            left, right = own.links()
            if not within[a]:
                across = own.block[left] != own.block[right]
                left, right = left[across], right[across]
            n = np.bincount(left, own.copies[right], b - a) + np.bincount(right, own.copies[left], b - a)
            root = union_find(b - a, left, right)
            used = np.flatnonzero(n > 0)
            out.append((own.rep[used], n[used].astype(np.int64), own.rep[root[used]]))
        memo.trim()
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "root"])


def near_copies(documents: DataFrame, text: str = "text", id_column: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL,
                bucket: int = BUCKET, weight: int = WEIGHT) -> DataFrame:
    """Classes of near-copies: (doc_id, key, class_id, n_links, kept), one row a document.

    Documents link if their sets of five-word shingles (words between white space, as written) have a Jaccard similarity of
    ``similarity`` or more; class_id is the smallest id reachable by links, n_links the number of other rows linked directly.
    ``kept`` marks one row a class, the first by (id, key). ``key`` is the 64-bit hash of (id, text).

    Rows with equal sets are merged first and counted. The chosen-path join then splits the sets recursively on sampled
    coordinates of their sketches, so many that a pair at the threshold is met with chance ``recall``; buckets of up
    to ``bucket`` sets are compared in one task, larger ones in pairs of blocks, and very large ones are split again
    before. Candidate groups are verified on the whole shingle sets, so no link is false; neither pairs of
    copies nor pairs of a group are written anywhere.

    Null and empty texts have no shingles and link with nothing. A text of fewer than five words is one shingle. Repeated rows
    link with each other. Null ids count as the largest id in a class. An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    ship_package(spark)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("text"), row_key(id_column, text).alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            for found in describe([batch]):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], ["doc_id", *found.schema.names])

    drawn = cut_lineage(rows.mapInArrow(lambda b: released(described(b)), f"doc_id {kind}, key bigint, size bigint, set_hash binary, sketch binary"))
    sets = drawn.filter("size > 0").groupBy("set_hash").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least"),
                                                            F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = cut_lineage(sets)
    groups = components(candidates(sets.select("rep", "sketch"), similarity, recall, bucket))
    members = cut_lineage(groups.join(sets.select("rep", "copies", "size"), groups.node == F.col("rep")).select("root", "rep", "copies", "size"))
    heavy = members.groupBy("root").agg(F.sum("size").alias("total")).filter(F.col("total") > weight)
    blocks = F.ceil(F.col("total") * 2 / F.lit(weight)).cast("int")
    dealt = members.join(heavy, "root", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("rep", "copies", "block", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("rep", "copies", "block", (F.col("block") == F.col("other")).alias("within"), F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    texts = rows.select(F.col("key").alias("rep"), "text").join(members.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    tasks = dealt.join(texts, "rep").select("task", "rep", "copies", "block", "within", "text").repartition("task").sortWithinPartitions("task")
    found = cut_lineage(tasks.mapInArrow(lambda b: released(verify(b, similarity)), "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "rep"})
    labelled = cut_lineage(sets.select("set_hash", "rep", "copies", "least").join(links, "rep", "left").join(joined, "rep", "left")
                           .withColumn("root", F.coalesce("root", "rep")))
    first = labelled.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = labelled.join(first, "root").select("set_hash", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = drawn.select("doc_id", "key", "set_hash").join(classes, "set_hash", "left")
    result = cut_lineage(result.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root"))
    best = result.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    marked = result.join(best, "root", "left")
    kept = F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.key") == F.col("key")))
    return marked.select("doc_id", "key", "class_id", "n_links", kept.alias("kept"))


def op10_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "kept")
