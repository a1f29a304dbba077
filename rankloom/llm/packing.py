"""Packing of documents into windows with lexically near neighbours."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm.common import Memo, release_memory, released, sized_batches, table
from rankloom.llm.token_counts import byte_characters, definition_text
from rankloom.session import cut_lineage, ship_package

END_ID = 1
WINDOW = 2048
K1, B = 1.2, 0.75
#: Words whose ids a task remembers; about 250 bytes each.
REMEMBERED = 1_000_000
PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, near bigint"
PACKED = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


_MARKS = ".,;:!?|%&$#*"


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space, word by word with bounded memos.

    Such a tokenizer never merges across white space, so a text's ids are those of its words in order; a word's
    are those of the pieces that the tokenizer's pattern cuts it into, each merged by its model. Words with its special
    strings, or beyond the Latin blocks, go to the tokenizer whole.
    """

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pattern = regex.compile(json.loads(definition)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = {i: c for i, c in byte_characters().items() if chr(i) != c}
        self.words, self.pieces = Memo(self.word, remembered), Memo(self.piece, remembered // 2)
        self.plain = all("<" in s for s in self.special)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word(self, word: str) -> bytes:
        if self.plain and word.isascii() and "<" not in word or max(word) < "\u0250" and not any(s in word for s in self.special):
            # Latin letters are in normal form, and each has its lower case whatever stands beside it
            low = word.lower()
            if low.isalpha():
                return self.piece(low) if low == word else self.words[low]
            core = low.rstrip(_MARKS)
            if core.isalpha():
                return self.words[core] + self.pieces[low[len(core):]]
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(low)))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        self.words.trim()
        self.pieces.trim()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, but not for the tokenizer
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.plain and "<" not in text and self.narrow(text):
            text = text.lower()  # no special string, and letters whose lower case is their own: words differ less
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<u4")

    @staticmethod
    def narrow(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True


@lru_cache(maxsize=1)
def encoder(definition: str, remembered: int = REMEMBERED) -> WordEncoder:
    return WordEncoder(definition, remembered)


def lexical_key(ids: np.ndarray) -> int:
    """Two minima of hashed ids: texts that share many tokens often share it."""
    low = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        one = ((low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        two = ((low + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
    return int(one.min()) << 31 | int(two.min())


def cut_documents(batches: Iterable[pa.RecordBatch], definition: str, schema: pa.Schema, remembered: int) -> Iterator[pa.RecordBatch]:
    """One row for each full window inside a document and one for what is left, with its ids."""
    own = encoder(definition, remembered)
    for batch in sized_batches(batches, "text"):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.append(own.encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
            for start in range(0, len(ids), WINDOW):
                piece = ids[start:start + WINDOW]
                tail = len(piece) < WINDOW
                rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.tobytes() if tail else None,
                             lexical_key(piece) if tail else None))
        yield from to_batches(rows, schema)


def to_batches(rows: list[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        part = list(zip(*rows[at:at + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)


class Shard:
    """BM25 index of some tails, and the windows that are packed from it."""

    def __init__(self, tails: list[tuple]):
        self.tails = tails  # (doc_id, start, length, crc, doc_tokens, ids)
        self.ids = [np.frombuffer(t[5], "<u4") for t in tails]
        self.length = np.array([len(x) for x in self.ids], np.int64)
        n = len(tails)
        owner = np.repeat(np.arange(n), self.length)
        pair, tf = np.unique(np.concatenate(self.ids).astype(np.int64) * n + owner, return_counts=True)
        term, self.posting = np.divmod(pair, n)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first, self.df = first, df
        idf = np.log((n - df + 0.5) / (df + 0.5))
        self.useful = idf > 0  # terms of more than half of the texts carry no weight
        norm = K1 * (1 - B + B * self.length / self.length.mean())
        self.impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.posting])

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.terms, np.unique(self.ids[seed]))
        at = at[self.useful[at]]
        if not len(at):
            return np.zeros(len(self.tails))
        size = self.df[at]
        ends = np.cumsum(size)
        place = np.repeat(self.first[at] - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(self.posting[place], self.impact[place], len(self.tails))

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (tail, from, to); every id lies in one of them, and all but the last are full."""
        begun, open_ = np.zeros(len(self.tails), np.int64), np.ones(len(self.tails), bool)
        for seed in np.argsort(-self.length, kind="stable"):
            if not open_[seed]:
                continue
            window, room = [(int(seed), int(begun[seed]), int(self.length[seed]))], WINDOW - int(self.length[seed] - begun[seed])
            open_[seed] = False
            if room and open_.any():
                score = np.where(open_, self.scores(seed), -np.inf)
                for near in self.nearest_first(score):
                    if not open_[near]:
                        break
                    size = min(room, int(self.length[near] - begun[near]))
                    window.append((int(near), int(begun[near]), int(begun[near]) + size))
                    begun[near] += size
                    room -= size
                    open_[near] = begun[near] < self.length[near]
                    if not room:
                        break
            yield window

    @staticmethod
    def nearest_first(score: np.ndarray) -> Iterator[int]:
        """Best scores first, ties to the smaller index; a few are found by partition, all others by a sort."""
        k = 16
        if len(score) > 4 * k:
            top = np.argpartition(-score, k)[:k]
            top = top[np.lexsort((top, -score[top]))]
            yield from top[:-1]
            done = set(top[:-1].tolist())
        else:
            done = set()
        yield from (i for i in np.argsort(-score, kind="stable") if int(i) not in done)


def pack_partition(batches: Iterable[pa.RecordBatch], schema: pa.Schema, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Packs the rows of one partition, shard by shard. Words that a worker remembers from cutting are let go: a shard takes their place."""
    encoder.cache_clear()
    release_memory()
    base, used, tails, tokens = TaskContext.get().partitionId() << 32, 0, [], 0

    def flush():
        nonlocal used, tails, tokens
        shard, rows = Shard(tails), []
        for window in shard.windows():
            offset = 0
            for tail, begin, end in window:
                doc, start, length, crc, total, _ = tails[tail]
                if (begin, end) != (0, length):
                    crc = zlib.crc32(shard.ids[tail][begin:end].tobytes())
                rows.append((doc, start + begin, end - begin, crc, total, base + used, offset))
                offset += end - begin
            used += 1
        tails, tokens = [], 0
        return rows

    for batch in batches:
        whole = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")], strict=True):
            if row[5] is None:
                whole.append((*row[:5], base + used, 0))
                used += 1
                continue
            tails.append(row)
            tokens += row[2]
            if tokens >= shard_tokens:
                yield from to_batches(flush(), schema)
        yield from to_batches(whole, schema)
    if tails:
        yield from to_batches(flush(), schema)


def pack(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", shard_tokens: int = 1 << 20,
         remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, near texts together.

    A document's ids are cut into full windows, which are sequences of their own, and a tail. Tails are
    range-partitioned by a lexical key (copies of one text are spread by a second, random one) into shards
    of about ``shard_tokens`` ids. Each shard holds a BM25 index of its tails over token ids; the longest unused
    tail is the seed of a window, and its best unused neighbours fill it, the last one cut to fit. So only the
    last window of a shard is padded. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the final id alone. Null ids stay null. Repeated rows are packed each.
    An empty table gives no rows. Other columns are not read. Memory per task is one shard, or the ids of
    ``remembered`` words, which changes the time but no row. The cut documents are
    written to the checkpoint folder before the shuffle, so texts are tokenized once and a lost task repeats its shard alone.
    """
    spark = documents.sparkSession
    ship_package(spark)
    definition = definition_text(path)
    if len(definition) > 64 << 20:
        raise ValueError("the tokenizer definition is too large to broadcast")
    shared = spark.sparkContext.broadcast(definition)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = arrow_schema(spark, PIECES.format(id=kind))
    pieces = cut_lineage(rows.mapInArrow(lambda batches: cut_documents(batches, shared.value, cut, remembered), PIECES.format(id=kind)))
    total = pieces.agg(F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), F.col("length"))), F.lit(0))).first()[0]
    shards = max(1, round(total / shard_tokens))
    order = ["near", F.xxhash64(F.lit(11), "doc_id", "start")]
    spread = pieces.withColumn("near", F.coalesce("near", F.abs(F.xxhash64(F.lit(5), "doc_id", "start")).bitwiseAND((1 << 62) - 1)))
    spread = spread.repartitionByRange(shards, *order).sortWithinPartitions("near", "doc_id", "start", "ids_crc32")
    packed = arrow_schema(spark, PACKED.format(id=kind))
    return spread.mapInArrow(lambda batches: released(pack_partition(batches, packed, 2 * shard_tokens)), PACKED.format(id=kind))


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
