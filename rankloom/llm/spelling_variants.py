"""Groups of words one edit apart, by partition-and-enumerate signatures over their letters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import lower_ascii, sized_batches, table
from rankloom.session import cut_lineage, ship_package

LETTERS = regex.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a letter.
CUT = 97
#: The letters' dimensions are dealt to so many parts; vectors at distance two agree on all parts but two.
PARTS = 3
#: Words of a signature shared by more are met through the words they leave when one letter goes.
BUCKET = 64
#: Different words a task counts before it passes them on.
HELD = 400_000


def word_of(run: str, prefix: int | None) -> str:
    """The run, or what is left of it without one letter, chosen by the checksum of ``<doc_id>:<run>``; ``prefix`` is that of ``<doc_id>:``."""
    if prefix is None:
        return run
    h = zlib.crc32(run.encode(), prefix)
    if h % CUT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of a partition with ``least`` letters or more, totals of up to HELD words at a time."""
    total: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in sized_batches(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            prefix = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(LETTERS.findall(lower_ascii(text.as_py()))).items():
                if len(run) >= least:
                    word = word_of(run, prefix)
                    if len(word) >= least:
                        total[word] += n
        if len(total) > HELD:
            yield rows()
            total.clear()
    yield rows()


def vector(word: str) -> list[tuple[str, int]]:
    """Non-zero dimensions of the word's letter multiset as a binary vector: (letter, k) for its k-th occurrence.

    A letter more or less is one dimension, a replaced letter is two.
    """
    seen: dict[str, int] = {}
    out = []
    for letter in sorted(word):
        seen[letter] = seen.get(letter, 0) + 1
        out.append((letter, seen[letter]))
    return out


def part_of(dimension: tuple[str, int], parts: int) -> int:
    return xxhash.xxh32_intdigest(f"{dimension[0]}{dimension[1]}") % parts


def signatures(word: str, parts: int = PARTS) -> list[int]:
    """64-bit keys of which two words one edit apart share at least one.

    Each key holds the dimensions of all parts but two. Since an edit lies in one half of a word, it also holds half of the shorter
    word's letters, first or last ones; the shorter word may be this one or one a letter shorter.
    """
    dealt = [""] * parts
    for dimension in vector(word):
        dealt[part_of(dimension, parts)] += f"{dimension[0]}{dimension[1]}"
    halves = []
    for size in (len(word) - 1, len(word)):
        half = size // 2
        halves += [f"{size}<{word[:half]}", f"{size}>{word[len(word) - half:]}"]
    out = []
    for kept in combinations(range(parts), parts - 2):
        whole = f"{kept}" + "|".join(dealt[i] for i in kept)
        out += [xxhash.xxh64_intdigest(f"{whole}|{half}") - (1 << 63) for half in halves]
    return out


def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            keys = [signatures(word) for word in part.column("word").to_pylist()]
            yield pa.record_batch([part.column("word"), part.column("n"), pa.array(keys, pa.list_(pa.int64()))], ["word", "n", "keys"])


def one_edit(a: str = "a.word", b: str = "b.word") -> str:
    return f"abs(char_length({a}) - char_length({b})) <= 1 AND levenshtein({a}, {b}, 1) = 1"


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, a_n, b, b_n) with a < b, once for each two of ``words`` (word, n; no word twice) one inserted, deleted or replaced letter apart.

    Words are joined on their signatures and verified. Words of signatures with more than ``bucket`` of them are joined on
    what is left of them without one letter (or whole) instead; a pair one edit apart always shares such a rest, and at most
    the alphabet times the length share one, so no group is unbounded and none is cut.
    """
    keyed = cut_lineage(words.mapInArrow(signed, "word string, n bigint, keys array<bigint>").select("word", "n", F.explode("keys").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keyed.join(sizes, "key")
    few = shared.filter(F.col("size") <= bucket).drop("size")
    many = shared.filter(F.col("size") > bucket).select("word", "n").distinct()
    rests = F.expr("array_distinct(concat(array(word), transform(sequence(1, char_length(word)),"
                   " i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))))")
    many = many.select("word", "n", F.explode(rests).alias("rest")).select("word", "n", F.xxhash64("rest").alias("key"))

    def met(rows: DataFrame) -> DataFrame:
        pairs = rows.alias("a").join(rows.alias("b"), F.expr(f"a.key = b.key AND a.word < b.word AND {one_edit()}"))
        return pairs.selectExpr("a.word AS a", "a.n AS a_n", "b.word AS b", "b.n AS b_n")

    return met(few).union(met(many)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following ``forms`` (word, form) to the last one; each round doubles the steps."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 2, bucket: int = BUCKET) -> DataFrame:
    """For each row of ``words`` (word, n; no word twice): word, form, root, n, n_near, form_n.

    A word's form is its near word (one letter inserted, deleted or replaced) of largest n, ties to the smallest word, if that n is
    at least ``ratio`` times its own; its root is the last form that follows. Null words are dropped, an empty table gives no rows.
    """
    words = cut_lineage(words.filter("word IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")))
    pairs = near_pairs(words, bucket)
    ways = F.explode(F.expr("array(struct(a AS word, b AS near, b_n AS near_n), struct(b AS word, a AS near, a_n AS near_n))"))
    both = pairs.select(ways.alias("w")).select("w.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = cut_lineage(found.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                     F.when(fits, F.col("form_n")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(documents: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the letter runs of all whole texts, A-Z in lower case, one run in 97 of a document without one letter.

    Runs of texts with a null id stay whole; null, empty and letterless texts have none. Counts are summed in tasks before the shuffle.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda batches: count_words(batches, least_letters), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(corpus_words(table(spark, folder, "documents")))


SQL = {"op13_spelling_variants": """
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
summed AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(
    list_transform(range(length(hex(encode(doc_id || ':' || run))) // 2), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) END AS h FROM runs, crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
rests AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
picked AS (SELECT word, min(near) AS near FROM near JOIN best USING (word) WHERE near_n = top GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best b USING (word) LEFT JOIN picked p USING (word)),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word
  JOIN forms e ON e.word = c.at AND e.form IS NULL
"""}
