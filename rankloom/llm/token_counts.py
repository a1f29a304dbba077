"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are produced."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Memo, table
from rankloom.session import ship_package

#: The pattern that byte-level tokenizers split text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = 1 << 40


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return names


class MergeCounter:
    """Counts what is left of a piece of text after all merges of a vocabulary."""

    def __init__(self, definition: str):
        vocabulary = json.loads(definition)
        model = vocabulary["model"]
        split = [pair if isinstance(pair, list) else pair.split(" ", 1) for pair in model["merges"]]
        number = {token: i for i, token in enumerate(model["vocab"])}
        self.start = [number[c] for _, c in sorted(byte_characters().items())]
        self.merges = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(split)}
        self.special = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.pieces, self.chunks = Memo(self.merged, 500_000), Memo(self.chunk, 500_000)

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges, the adjacent pair of lowest rank (leftmost first) popped each time."""
        symbols = [self.start[b] for b in piece.encode()]
        n = left = len(symbols)
        if n < 2:
            return n
        merges, following, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rule[0] * _SHIFT + i for i in range(n - 1) if (rule := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), _SHIFT)
            j = following[i] if symbols[i] >= 0 else n
            if j >= n:
                continue
            rule = merges.get((symbols[i], symbols[j]))
            if rule is None or rule[0] != rank:  # one side was merged meanwhile
                continue
            symbols[i], symbols[j] = rule[1], -1
            left -= 1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if rule := merges.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, rule[0] * _SHIFT + i)
            h = before[i]
            if h >= 0 and (rule := merges.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, rule[0] * _SHIFT + h)
        return left

    def chunk(self, word: str) -> int:
        """Tokens of ``word`` after a single space; only for words without white space at either end."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError
        return self.plain(" " + word)

    def plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def part(self, text: str) -> int:
        """A text with single spaces only falls into words that are counted once each; any other is split whole."""
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise ValueError
            return self.plain(first) + sum(map(self.chunks.__getitem__, rest))
        except ValueError:
            return self.plain(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        self.pieces.trim()
        self.chunks.trim()
        if self.cut is None or not any(s in text for s in self.special):
            return self.part(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


@lru_cache(maxsize=2)
def counter(definition: str) -> MergeCounter:
    return MergeCounter(definition)


def definition_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def token_count_column(spark: SparkSession, text: Column, path: str) -> Column:
    """struct(n_bytes, n_tokens) of a text column, for the tokenizer file at ``path`` on the driver.

    The definition (about 1.5 MB, at most 64 MB by check) is broadcast. Null counts as empty. Nothing
    is shuffled; memory per task is one batch plus two memos of at most 500,000 short pieces.
    """
    definition = definition_text(path)
    if len(definition) > 64 << 20:
        raise ValueError("the tokenizer definition is too large to broadcast")
    shared = spark.sparkContext.broadcast(definition)

    @F.arrow_udf("struct<n_bytes: bigint, n_tokens: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        own = counter(shared.value)
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        n_tokens = pa.array([own.count(t.as_py()) for t in texts], pa.int64())
        return pa.StructArray.from_arrays([n_bytes, n_tokens], ["n_bytes", "n_tokens"])

    return count(text)


def token_counts(documents: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to every row.

    Null and empty texts: 0 bytes, 0 tokens. Long texts are counted whole. Repeated rows are counted
    each. An empty table gives no rows. Columns of these names are replaced; all others stay.
    """
    spark = documents.sparkSession
    ship_package(spark)
    found = documents.withColumn("__count", token_count_column(spark, F.col(text), path))
    return found.withColumns({"n_bytes": F.col("__count.n_bytes"), "n_tokens": F.col("__count.n_tokens"),
                              "over_limit": F.col("__count.n_tokens") > limit}).drop("__count")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")
