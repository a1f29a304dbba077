"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Memo, release_memory, sized_batches, table
from rankloom.session import cut_lineage, ship_package

#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of their id, and at most so many of their characters.
EXAMPLES, CHARACTERS = 4_096, 48 << 20
NEIGHBOURS = 15
#: Every word of the examples counts. Its weight is the inverse document frequency times its correlation with the label, which doesn't
#: depend on the number of examples, shrunk as if SHRINK more rows held it; FLOOR is what a word without correlation keeps.
SHRINK, FLOOR = 5.0, 0.02
#: Examples come in blocks of so many; a term of more than one in LONG examples is compared block by block, others by their postings.
BLOCK, LONG = 32, 4
GROUP = 64
EDGES = b".,;:!?\"'()[]{}|%&$#*+-_<>/\\="


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def words_of(text: bytes | None) -> Counter:
    """Words of a text without punctuation at their ends, A-Z in lower case."""
    found: Counter = Counter()
    for word, n in Counter(text.lower().split()).items() if text else ():
        found[word.strip(EDGES)] += n
    found.pop(b"", None)
    return found


class Vocabulary:
    """Finds the words of a text among ``hashes``, ascending; a written form is looked up once. Number ``len(hashes)`` stands for all others."""

    def __init__(self, hashes: np.ndarray):
        self.number, self.other = dict(zip(hashes.tolist(), range(len(hashes)), strict=True)), len(hashes)
        self.of_word = Memo(lambda word: self.number.get(term_hash(word.strip(EDGES)), self.other), 250_000)

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(ascending term numbers, counts)."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.of_word.trim()
        terms, n = np.unique(np.fromiter(map(self.of_word.__getitem__, text.lower().split()), np.int64), return_counts=True)
        return (terms[:-1], n[:-1]) if len(terms) and terms[-1] == self.other else (terms, n)


class BlockMaxIndex:
    """Exact cosines with the nearest examples, with upper bounds for blocks of BLOCK examples.

    Short postings are added up for all examples. Of a term that many examples hold, each block keeps its largest weight; the sums
    of these bound what the long terms can add in a block, and only examples that could still be among the nearest have them added.
    """

    def __init__(self, terms: int, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list):
        """``vectors``: ascending term numbers and weights of each example, with a length of 1."""
        self.labels, self.ids, self.examples = labels, ids, len(vectors)
        self.blocks = -(-len(vectors) // BLOCK)
        owner = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int32)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(np.float32)
        size = np.bincount(term, minlength=terms)
        common = np.flatnonzero(size * LONG > len(vectors))
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        far = self.row[term] >= 0
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)  # long postings, with a place for every example
        self.dense[self.row[term[far]], owner[far]] = weight[far]
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(2) if self.blocks else np.zeros((len(common), 0), np.float32)
        term, owner, weight = term[~far], owner[~far], weight[~far]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, ties to the smaller example."""
        row = self.row[terms]
        long, heavy = row[row >= 0], weights[row >= 0].astype(np.float32)
        short, light = terms[row < 0], weights[row < 0]
        count = self.first[short + 1] - self.first[short]
        place = np.repeat(self.first[short] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        part = np.zeros(self.blocks * BLOCK)
        part[:self.examples] = np.bincount(self.owner[place], self.weight[place] * np.repeat(light, count), self.examples)
        bound = heavy @ self.most[long]
        reach = part.reshape(-1, BLOCK).max(1) + bound
        least, seen, found, score = 1e-9, np.zeros(self.blocks, bool), [], []
        best_first = np.argsort(-reach, kind="stable")
        step, at = 4, 0
        while at < self.blocks and reach[best_first[at]] >= least - 1e-6:
            some = best_first[at:at + step]
            some = some[reach[some] >= least - 1e-6]
            at, step, seen[some] = at + step, 2 * step, True
            own = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            own = own[part[own] + np.repeat(bound[some], BLOCK) >= least - 1e-6]
            own = own[(own < self.examples) & (own != without)]
            found.append(own)
            score.append(part[own] + heavy @ self.dense[np.ix_(long, own)] if len(long) else part[own])
            have = np.concatenate(score)
            if len(have) >= k:
                least = max(least, float(np.partition(have, -k)[-k]))
        found, score = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(score or [np.zeros(0)])
        found, score = found[score > 1e-9], score[score > 1e-9]
        order = np.lexsort((found, -np.round(score, 6)))[:k]
        return found[order], score[order]


@dataclass
class ToxicityModel:
    terms: np.ndarray  # ascending hashes
    weight: np.ndarray  # of each term
    index: BlockMaxIndex | None = None
    raw: np.ndarray = field(default_factory=lambda: np.zeros(1))  # ascending votes and their calibrated scores
    calibrated: np.ndarray = field(default_factory=lambda: np.zeros(1))
    without: float = 0.0  # score of texts without a neighbour

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.weight[terms]
        return terms, weights / np.sqrt((weights ** 2).sum()) if len(terms) else weights

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float | None, list]]:
        """Votes of the nearest, each weighted by the inverse of its cosine distance; their ids are the evidence."""
        for i, (terms, weights) in enumerate(vectors):
            if self.index is None or not self.index.examples:
                yield None, []
                continue
            found, cosine = self.index.nearest(terms, weights, NEIGHBOURS, without[i] if without is not None else -1)
            weight = 1 / (1.02 - np.minimum(cosine, 1.0))
            yield (float((weight * self.index.labels[found]).sum() / weight.sum()) if len(found) else None), [self.index.ids[j] for j in found]

    def score(self, vote: float | None) -> float:
        return self.without if vote is None else float(np.interp(vote, self.raw, self.calibrated))


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: mean vote and rate of each pool, both ascending; one row of each kind is added."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for vote, label in zip(votes[order], labels[order], strict=True):
        pools.append([vote, float(label), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    raw = np.array([p[0] / p[2] for p in pools])
    rate = np.array([p[1] / p[2] for p in pools])
    size = np.array([p[2] for p in pools])
    return raw, (rate * size + 0.5 * (rate > 0.5) + 0.25 * (rate == 0.5)) / (size + 0.5)


def example_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes and counts of each example."""
    for batch in sized_batches(batches, "text"):
        found = [words_of(t.as_py()) for t in batch.column("text")]
        columns = [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array([[term_hash(w) for w in c] for c in found], pa.list_(pa.int64())),
                   pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "terms", "counts"])


def chosen_examples(documents: DataFrame, labels: DataFrame, training: str, examples: int, characters: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``examples`` labelled ids and, beyond the first, ``characters`` characters, in the order of a hash of the id."""
    known = labels.filter(training).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]
    known = known.orderBy(*order).limit(examples)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    texts = cut_lineage(texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    few = texts.select("doc_id", so_far.alias("so_far"), F.length("text").alias("own"))  # a row an example
    few = few.filter(F.col("so_far").isNull() | (F.col("so_far") + F.coalesce("own", F.lit(0)) <= characters))
    return texts.join(F.broadcast(few.select("doc_id")), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, training: str, examples: int = EXAMPLES, characters: int = CHARACTERS) -> ToxicityModel:
    """Weighs all words of the examples by their frequency over all ``documents`` and by the labels, and indexes the examples.

    ``labels`` (doc_id, toxic): of repeated ids the largest label counts, null labels are none; of documents with one id the smallest text
    is the example. Only ids for which the SQL expression ``training`` holds are learnt from, at most ``examples`` of them with ``characters``
    characters in all, which bounds what is broadcast and what reaches the driver; document frequencies come from all rows of ``documents``.
    """
    spark = documents.sparkSession
    ship_package(spark)
    sample = chosen_examples(documents, labels, training, examples, characters)
    kind = sample.schema["doc_id"].dataType.simpleString()
    table_ = sample.mapInArrow(example_words, f"doc_id {kind}, toxic int, terms array<bigint>, counts array<int>").toArrow()
    order = np.argsort(np.array(table_["doc_id"].to_pylist(), object), kind="stable")
    ids, label = [table_["doc_id"][int(i)].as_py() for i in order], table_["toxic"].to_numpy().astype(float)[order]
    total, toxic_rows = len(ids), float(label.sum())
    if not total or not 0 < toxic_rows < total:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), without=toxic_rows / total if total else 0.0)
    lists = [(table_["terms"][int(i)].values.to_numpy(), table_["counts"][int(i)].values.to_numpy()) for i in order]
    del table_
    term, place, n = np.unique(np.concatenate([t for t, _ in lists]), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(label, [len(t) for t, _ in lists]), len(term))
    rate = toxic_rows / total
    correlation = np.abs(toxic - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate) * total, 1e-12))
    shared = spark.sparkContext.broadcast(term)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, rows = Vocabulary(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in sized_batches(batches, "text"):
            for text in batch.column("text"):
                count[own.counts(text.as_py())[0]] += 1
                rows += 1
        count[-1] = rows
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used), pa.array(count[used])], ["term", "n"])

    frequency = np.zeros(len(term) + 1)
    rows = documents.select(F.col("text").cast("binary").alias("text"))
    seen = rows.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # words of the examples
    frequency[seen["term"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1]))
    model = ToxicityModel(term, np.maximum(idf, 1e-3) * (correlation * n / (n + SHRINK) + FLOOR))
    vectors, at = [], 0
    for terms, counts in lists:
        own = place[at:at + len(terms)]
        by_term = np.argsort(own)
        vectors.append(model.vector(own[by_term], counts[by_term]))
        at += len(terms)
    model.index = BlockMaxIndex(len(term), vectors, label, ids)
    held = spark.sparkContext.broadcast((model, vectors))

    def left_out(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = held.value
        for batch in parts:
            at = batch.column("id").to_pylist()
            votes = [v for v, _ in own.votes([given[i] for i in at], at)]
            yield pa.record_batch([pa.array(votes, pa.float64()), pa.array(own.index.labels[at], pa.float64())], ["vote", "label"])

    judged = spark.range(0, total, 1, 16).mapInArrow(left_out, "vote double, label double").collect()  # one row an example
    votes = np.array([r[0] if r[0] is not None else np.nan for r in judged])
    truth = np.array([r[1] for r in judged])
    near = ~np.isnan(votes)
    if near.any():
        model.raw, model.calibrated = isotonic(votes[near], truth[near])
    shared.unpersist()
    held.unpersist()
    model.without = float((truth[~near].sum() + rate) / ((~near).sum() + 1))
    return model


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """struct(score, evidence) of a text column; evidence lists the ids of its nearest examples, as text."""
    held = spark.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.string()))])
    memory: dict = {}

    @F.arrow_udf("struct<score: double, evidence: array<string>>")
    def score(texts: pa.Array) -> pa.Array:
        own = held.value
        if "vocabulary" not in memory:
            memory["vocabulary"], memory["seen"] = Vocabulary(own.terms), {}
        vocabulary, seen = memory["vocabulary"], memory["seen"]
        out = []
        for start in range(0, len(texts), GROUP):
            counted = [vocabulary.counts(text.as_py()) for text in texts[start:start + GROUP]]
            keys = [xxhash.xxh128_digest(terms.tobytes() + n.tobytes()) for terms, n in counted]
            if len(seen) > 8_000:
                seen.clear()
            new = {key: own.vector(*pair) for key, pair in zip(keys, counted, strict=True) if key not in seen}
            for key, (vote, evidence) in zip(new, own.votes([*new.values()]), strict=True):
                seen[key] = {"score": own.score(vote), "evidence": [str(i) for i in evidence]}
            out += [seen[key] for key in keys]
        scored = pa.array(out, kind)
        del out
        release_memory()
        return scored

    return score(text.cast("binary"))


def score_toxicity(documents: DataFrame, labels: DataFrame, training: str, text: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """Adds score (0 to 1), predicted (1 from 0.5) and evidence to every row.

    Each text is compared with the labelled examples by cosine over TF-IDF of all words of the examples, weighed by
    how much the labels depend on them; votes of the 15 nearest are calibrated by isotonic regression on left-out examples. Texts without
    such words, null and empty ones among them, get the rate of examples without a neighbour. Without labels of both kinds all texts get
    the share of toxic labels (0 if none). Repeated rows score alike; an empty table gives no rows; other columns stay, those of the
    three names are replaced; evidence (ids as text) lists the nearest examples. Documents are not shuffled: each pass is a scan.
    """
    model = fit(documents.select("doc_id", F.col(text).alias("text")), labels.select("doc_id", "toxic"), training, examples)
    scored = documents.withColumn("__score", score_column(documents.sparkSession, model, F.col(text)))
    value = F.col("__score.score")
    return scored.withColumns({"score": value, "predicted": (value >= 0.5).cast("int"), "evidence": F.col("__score.evidence")}).drop("__score")


HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)"


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), f"NOT {HELD_OUT}")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")
