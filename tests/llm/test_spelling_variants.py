"""Spelling variants next to a comparison of all pairs."""

import random
import zlib
from collections import Counter

import pytest

from rankloom.llm import spelling_variants
from rankloom.llm.spelling_variants import LETTERS, part_of, signatures, vector


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, ratio=2):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), words[best] if form[w] else None]
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_words_one_edit_apart_share_a_signature():
    rng = random.Random(4)
    for parts in (3, 4, 6):
        for _ in range(400):
            word = "".join(rng.choice("abcéñst") for _ in range(rng.randrange(2, 12)))
            at, letter = rng.randrange(len(word)), rng.choice("abcéñst")
            for other in (word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:]):
                assert set(signatures(word, parts)) & set(signatures(other, parts))
                one, two = set(vector(word)), set(vector(other))
                assert len(one ^ two) <= 2
    assert {part_of(("a", k), 3) for k in range(1, 30)} == {0, 1, 2}


@pytest.mark.parametrize("bucket", [2, 64])
def test_all_pairs(spark, bucket):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 8))): rng.choice((3, 4, 9, 30, 200)) for _ in range(500)}
    words |= {"motor": 100, "moter": 40, "metor": 9, "meter": 200, "motors": 100}
    frame = spark.createDataFrame([*words.items(), (None, 3)], "word string, n bigint")
    assert rows_of(spelling_variants.spelling_variants(frame, bucket=bucket)) == plain(words)


def test_many_words_of_equal_letters(spark):
    """All orders of some letters share every letter signature; none may be lost."""
    rng = random.Random(9)
    words = set()
    while len(words) < 600:
        words.add("".join(rng.sample("aabbccdd", 8)) + rng.choice(("", "a", "b")))
    counted = {w: 3 + i % 50 for i, w in enumerate(sorted(words))}
    frame = spark.createDataFrame(list(counted.items()), "word string, n bigint")
    assert rows_of(spelling_variants.spelling_variants(frame, bucket=8)) == plain(counted)


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in LETTERS.findall(low):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def test_words_of_the_corpus(spark, folder, documents):
    expected = plain_words([(r.doc_id, r.text) for r in documents.collect()])
    assert {r.word: r.n for r in spelling_variants.corpus_words(documents).collect()} == expected
    found = rows_of(spelling_variants.op13_spelling_variants(spark, folder))
    assert found == plain(expected)


def test_odd_rows(odd):
    got = {r.word: r.n for r in spelling_variants.corpus_words(odd).collect()}
    assert got == plain_words([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling_variants.spelling_variants(spelling_variants.corpus_words(odd.limit(0))).collect() == []
