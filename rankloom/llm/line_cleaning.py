"""Line-first cleaning: rules for single lines, then for what is left of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import lower_ascii, split_words, table
from rankloom.session import ship_package

#: A line that holds one of these, A-Z in any case, is boilerplate.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "we use cookies", "accept cookies", "enable javascript", "click here", "read more", "sign up for",
    "subscribe to our", "follow us on", "share this", "powered by", "lorem ipsum", "skip to content", "back to top",
)
#: Words that stand between the entries of a menu.
SEPARATORS = ("|", ">", "»", "›", "·", "•", "/", "::")
SYMBOLS = "#*$%&|<>"
MARKS = ".!?…。！？"
ENDING = r"[.!?…。！？][\"'”’»)\]]*$"
SHOUT = r"[!?][!?]+$"
KINDS = ("punctuation", "navigation", "boilerplate")


@dataclass(frozen=True)
class Limits:
    """Shares in per cent of a line's words, and of a document's characters for ``lost``."""

    least_endings: int = 1  # a line needs at least so many words that end a sentence
    most_shouts: int = 25  # words that end in several marks
    most_symbols: int = 25  # words that hold a symbol
    most_separators: int = 20  # words that only separate entries
    lost: int = 50  # a document that loses more than this is rejected
    least_words: int = 50  # the base rules
    most_repeats: int = 50


_ENDING, _SHOUT = regex.compile(ENDING), regex.compile(SHOUT)
_SYMBOL = regex.compile("[" + regex.escape(SYMBOLS) + "]")


def enough_endings(words: list[str], limits: Limits) -> bool:
    if limits.least_endings * len(words) <= 100 and _ENDING.search(words[-1]):
        return True  # one is enough for a line of this length
    endings = sum(1 for w in words if _ENDING.search(w))
    return endings > 0 and 100 * endings >= limits.least_endings * len(words)


def line_fault(line: str, words: list[str], repeated: bool, limits: Limits) -> str | None:
    """The first rule that a line with words breaks."""
    n = len(words)
    if 100 * sum(1 for w in words if w in SEPARATORS) > limits.most_separators * n:
        return "navigation"
    low = lower_ascii(line)
    if repeated or any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    marks = sum(map(line.count, MARKS))
    if not marks or not enough_endings(words, limits):
        return "punctuation"
    if 100 * marks > limits.most_shouts * n and 100 * sum(1 for w in words if _SHOUT.search(w)) > limits.most_shouts * n:
        return "punctuation"
    if 100 * sum(map(line.count, SYMBOLS)) > limits.most_symbols * n and 100 * sum(1 for w in words if _SYMBOL.search(w)) > limits.most_symbols * n:
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that the text holds twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first, again = {}, set()
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            again.add(j)
            again.add(i)
    covered, end = 0, 0
    for i in sorted(again):
        covered += i + 3 - max(i, end)
        end = i + 3
    return covered


def judge(text: str | None, limits: Limits) -> dict:
    """All columns that ``clean_lines`` adds, for one text."""
    seen: set[str] = set()
    kept, faults, word_chars, lost, duplicates, all_words = [], dict.fromkeys(KINDS, 0), 0, 0, 0, []
    for line in (text or "").split("\n"):
        words = split_words(line)
        if not words:
            kept.append(line)
            continue
        repeated = line in seen
        seen.add(line)
        size = sum(map(len, words))
        word_chars += size
        duplicates += repeated
        all_words += words
        fault = line_fault(line, words, repeated, limits)
        if fault is None:
            kept.append(line)
        else:
            faults[fault] += 1
            lost += size
    repeats = repeated_words(all_words)
    failed = len(all_words) < limits.least_words or 100 * repeats > limits.most_repeats * len(all_words)
    return {"n_words": len(all_words), "word_chars": word_chars, "n_symbols": sum(map(text.count, SYMBOLS)) if text else 0, "n_dup_lines": duplicates,
            "n_repeat_words": repeats, **{f"n_{kind}": faults[kind] for kind in KINDS}, "lost_chars": lost, "base_failed": failed,
            "kept": not failed and 100 * lost <= limits.lost * word_chars, "cleaned": "\n".join(kept)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"n_{kind}" for kind in KINDS), "lost_chars")
FOUND = pa.struct([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())])
FOUND_DDL = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", base_failed: boolean, kept: boolean, cleaned: string>"


def clean_lines(documents: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """Adds counts, base_failed, kept and cleaned, the text without the lines that break a rule.

    A line with words is removed by the first rule it breaks: navigation (entries between separators), boilerplate (a known phrase, or
    equal to an earlier line of its text) or punctuation (no sentence ends in it, or it is full of marks or symbols). ``n_<rule>`` count the
    removed lines and lost_chars the characters of their words. A document is kept if the base rules hold (enough words,
    not too many in repeated windows) and it loses no more than ``limits.lost`` per cent of its characters in words.

    Null, empty and wordless texts have counts of 0 and fail the base; the cleaned text is empty for null. Lines without words
    stay. Repeated rows give equal results; an empty table gives no rows. Other columns stay; those of the added names
    are replaced. Map only: memory per task is a batch of texts.
    """
    ship_package(documents.sparkSession)
    limits = limits or Limits()

    @F.arrow_udf(FOUND_DDL)
    def found(texts: pa.Array) -> pa.Array:
        def rows() -> Iterator[dict]:
            for value in texts:
                yield judge(value.as_py(), limits)

        return pa.array(rows(), FOUND)

    judged = documents.withColumn("__found", found(F.col(text).cast("string")))
    return judged.withColumns({f.name: F.col(f"__found.{f.name}") for f in FOUND}).drop("__found")


def op12_line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    return clean_lines(table(spark, folder, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_SHARE = "100 * len(list_filter(words, lambda w: {0})) > {1} * len(words)"


def _sql(limits: Limits = Limits()) -> str:  # noqa: B008
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    separators = ", ".join(f"'{s}'" for s in SEPARATORS)
    ending = ENDING.replace("'", "''")
    return f"""
WITH rows AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM rows),
worded AS (SELECT k, line, place, {_WORDS.format("line")} AS words, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM lines),
judged AS (
  SELECT k, place, words, length(array_to_string(words, '')) AS size, row_number() OVER (PARTITION BY k, line ORDER BY place) > 1 AS repeated,
    CASE WHEN {_SHARE.format(f"list_contains([{separators}], w)", limits.most_separators)} THEN 'navigation'
      WHEN row_number() OVER (PARTITION BY k, line ORDER BY place) > 1 OR {phrases} THEN 'boilerplate'
      WHEN len(list_filter(words, lambda w: regexp_matches(w, '{ending}'))) = 0
        OR 100 * len(list_filter(words, lambda w: regexp_matches(w, '{ending}'))) < {limits.least_endings} * len(words)
        OR {_SHARE.format(f"regexp_matches(w, '{SHOUT}')", limits.most_shouts)}
        OR {_SHARE.format(f"regexp_matches(w, '[{SYMBOLS}]')", limits.most_symbols)} THEN 'punctuation' END AS fault
  FROM worded WHERE len(words) > 0),
by_line AS (SELECT k, sum(len(words)) AS n_words, sum(size) AS word_chars, count(*) FILTER (WHERE repeated) AS n_dup_lines,
    {", ".join(f"count(*) FILTER (WHERE fault = '{kind}') AS n_{kind}" for kind in KINDS)},
    sum(CASE WHEN fault IS NULL THEN 0 ELSE size END) AS lost_chars FROM judged GROUP BY k),
numbered AS (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY place, i) AS i FROM (
    SELECT k, place, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM judged)),
windows AS (SELECT k, i, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM numbered WINDOW w AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + d) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY k),
counted AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, coalesce(lost_chars, 0) AS lost_chars
  FROM rows LEFT JOIN by_line USING (k) LEFT JOIN covered USING (k))
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)},
  n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeats} * n_words AS base_failed,
  NOT (n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeats} * n_words) AND 100 * lost_chars <= {limits.lost} * word_chars AS kept
FROM counted"""


SQL = {"op12_line_cleaning": _sql()}
