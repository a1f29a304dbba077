"""Periodic runs of words, found by uniting suffix classes in order of falling common prefixes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, split_words, table
from rankloom.session import ship_package

#: A run has at least so many words and at least so many periods.
LEAST, EXPONENT = 24, 3
#: Bytes of text whose suffixes are sorted together; a longer text is sorted alone.
TOGETHER = 4 << 20

FOUND = pa.struct([("n_words", pa.int64()),
                   ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                   ("collapsed", pa.string())])
FOUND_DDL = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class Numbers(dict):
    """Numbers its keys from 0 in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def shortest_prefix(least: int, exponent: int) -> int:
    """A run of period q shares at least so many words with itself moved by q, whatever q is."""
    return max(1, ceil(least * (exponent - 1) / exponent))


def repeated_windows(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Marks places whose window of ``size`` words, a power of two, may occur twice in its text (by a 64-bit hash)."""
    n = len(ids)
    mark = np.zeros(n, bool)
    if n < size:
        return mark
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        step, factor = 1, np.uint64(0xBF58476D1CE4E5B9)
        while step < size:
            value[:n - step] = value[:n - step] * factor + value[step:]
            factor, step = factor * factor, 2 * step
        value = value * np.uint64(0xC2B2AE3D27D4EB4F) + owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    inside = np.flatnonzero(np.arange(n) + size <= ends[owner])
    order = inside[np.argsort(value[inside])]
    same = value[order[1:]] == value[order[:-1]]
    mark[order[1:][same]] = mark[order[:-1][same]] = True
    return mark


def suffix_ranks(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Level j ranks the suffixes of all texts by text and first 2 ** j words; the last level tells all apart."""
    n = len(ids)
    rank = np.unique(owner.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank.astype(np.int32)], 1
    while rank.max() < n:
        follow = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + step < ends[owner])
        follow[inside] = rank[inside + step]
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``left`` and ``right`` share, two of one text at a time."""
    n, length = len(levels[0]), np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        inside = (a < n) & (b < n)
        same = np.zeros(len(left), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        length[same] += 1 << level
    return length


def united_runs(ids: list[int], suffixes: list[int], prefixes: list[int], order: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """{(start, length): period} of all runs, by joining neighbours of the suffix order from the longest shared prefix down.

    Each class of suffixes keeps its places in order. A smaller class moves into a larger one, and where two places of the
    two become neighbours at a distance within the prefix they share, a repetition of that period starts at the first.
    It is kept if it cannot be extended to the left, so each run is seeded once, at its start; a period that is
    a multiple of the smallest one gives the same stretch, of which the smallest period counts.
    """
    up = list(range(len(suffixes)))
    places: list[list[int] | None] = [[p] for p in suffixes]
    runs: dict[tuple[int, int], int] = {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def seed(first: int, second: int, shared: int):
        period = second - first
        length = period + shared
        if period <= shared and length >= least and length >= exponent * period and (first == 0 or ids[first - 1] != ids[second - 1]):
            runs[first, length] = min(period, runs.get((first, length), period))

    for i in order:
        one, two, shared = root(i), root(i + 1), prefixes[i]
        if len(places[one]) < len(places[two]):
            one, two = two, one
        large, small = places[one], places[two]
        up[two], places[two] = one, None
        before = -1
        for k, place in enumerate(small):
            at = bisect_left(large, place)
            if at and large[at - 1] != before:
                seed(large[at - 1], place, shared)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                seed(place, large[at], shared)
            large.insert(at, place)
            before = place
    return runs


def runs_of(word_lists: list[list[str]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in word_lists]
    number = Numbers()
    sizes = np.array([len(words) for words in word_lists], np.int64)
    if not sizes.sum():
        return found
    ids = np.concatenate([np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in word_lists])
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    floor = shortest_prefix(least, exponent)
    level = floor.bit_length() - 1
    marked = repeated_windows(ids, owner, ends, 1 << level)
    texts = np.unique(owner[marked])
    if not len(texts):
        return found
    taken = np.isin(owner, texts)
    ids, owner, sizes = ids[taken], np.repeat(np.arange(len(texts)), sizes[texts]), sizes[texts]
    ends = np.cumsum(sizes)
    levels = suffix_ranks(ids, owner, ends)
    suffixes = np.empty(len(ids), np.int64)
    suffixes[levels[-1] - 1] = np.arange(len(ids))
    if level >= len(levels):
        return found
    coarse = levels[level][suffixes]
    near = np.flatnonzero(coarse[1:] == coarse[:-1])
    shared = common_prefixes(levels, suffixes[near], suffixes[near + 1])
    near, shared = near[shared >= floor], shared[shared >= floor]
    del levels
    # only suffixes with a long enough neighbour take part; each stretch of them is numbered anew
    keep = np.zeros(len(suffixes), bool)
    keep[near] = keep[near + 1] = True
    place = np.cumsum(keep) - 1
    prefixes = np.zeros(int(keep.sum()), np.int64)
    prefixes[place[near]] = shared
    order = place[near][np.argsort(-shared, kind="stable")]
    # texts are told apart by their number in front of the word's
    told = (owner * (int(ids.max()) + 1) + ids).tolist()
    runs = united_runs(told, suffixes[keep].tolist(), prefixes.tolist(), order.tolist(), least, exponent)
    begin = ends - sizes
    for (start, length), period in runs.items():
        text = int(owner[start])
        found[int(texts[text])].append((start - int(begin[text]), length, period))
    for runs_of_text in found:
        runs_of_text.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, of each run its first period alone."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return " ".join(word for word, drop in zip(words, gone.tolist(), strict=True) if not drop)


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Cuts texts so that each slice holds about ``limit`` bytes, one text at least."""
    size, start, total = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for i, n in enumerate(size):
        if total + n > limit and i > start:
            yield texts[start:i]
            start, total = i, 0
        total += n
    yield texts[start:]


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Adds n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeated periods.

    A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``exponent`` (2 or more) times q long,
    that no neighbouring word extends. Texts are looked at whole: those in which a window of words repeats have their suffixes sorted
    by prefix doubling; suffix classes are united from the longest common prefix down to the shortest that a run needs.

    Null, empty and wordless texts have no words, no runs and an empty collapsed text. Repeated rows give equal results;
    an empty table gives no rows. Other columns stay; those of the three names are replaced. Rows are not shuffled.
    Memory per task follows the longest text, about 8 bytes a word for each doubling.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run needs two periods and two words at least")
    ship_package(documents.sparkSession)

    @F.arrow_udf(FOUND_DDL)
    def find(texts: pa.Array) -> pa.Array:
        counts, runs, collapsed = [], [], []
        for part in slices(texts, TOGETHER):
            words = [split_words(t) for t in part.to_pylist()]
            own = runs_of(words, least, exponent)
            counts += map(len, words)
            runs += [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in own]
            collapsed += map(collapse, words, own)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, FOUND.field("runs").type), pa.array(collapsed, pa.string())],
                                          fields=list(FOUND))

    found = documents.withColumn("__found", find(F.col(text).cast("string")))
    return found.withColumns({name: F.col(f"__found.{name}") for name in ("n_words", "runs", "collapsed")}).drop("__found")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equal ones the first by start, then by period."""
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        ahead = (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(ahead, -1).otherwise(F.when((left == right) & (a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(1))

    return F.get(F.array_sort(runs, order), F.lit(0))


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) in which each tenth text, by the checksum of its id, repeats a stretch from some word on to its end.

    Texts with a null id stay as they are.
    """
    rows = documents.select("doc_id", "text", F.expr("crc32(CAST(doc_id AS STRING))").alias("h")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(words, (w, i) -> IF(i >= a, words[CAST(a + (i - a) % p AS INT)], w)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, folder, "documents"))).withColumn("best", strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def greatest_exponent(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The same choice for runs in hand."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
