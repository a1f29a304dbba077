"""Periodic runs next to a search over all periods."""

import random
import zlib
from hashlib import sha256

from rankloom.llm import periodic_runs
from rankloom.llm.common import split_words


def plain_runs(words, least=24, exponent=3):
    """All stretches by definition: for each period the maximal stretches of equal words, without those of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            stretch = words[start:start + length]
            smaller = any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_rewrite(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_equal_all_periods_on_random_words():
    rng = random.Random(5)
    lists = []
    for _ in range(150):
        words = []
        while len(words) < rng.randrange(5, 260):
            piece = [rng.choice("abc" if rng.random() < 0.7 else "abcdefgh") for _ in range(rng.randrange(1, 14))]
            words += piece * rng.choice((1, 1, 2, 3, 5, 9)) + piece[:rng.randrange(len(piece))]
        lists.append(words)
    lists += [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 100, ["a", "b"] * 40 + ["a"], [*"ab"] * 12 + [*"abc"] * 12]
    for words, found in zip(lists, periodic_runs.runs_of(lists), strict=True):
        assert found == plain_runs(words)


def test_other_limits():
    rng = random.Random(6)
    lists = [[rng.choice("ab") for _ in range(rng.randrange(80))] for _ in range(60)]
    for least, exponent in ((2, 2), (5, 2), (9, 3), (16, 4)):
        for words, found in zip(lists, periodic_runs.runs_of(lists, least, exponent), strict=True):
            assert found == plain_runs(words, least, exponent)


def test_query_equals_all_periods(spark, folder, documents):
    rows = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, folder).collect()}
    assert len(rows) == documents.count()
    hit = 0
    for doc_id, text in ((r.doc_id, r.text) for r in documents.collect()):
        words = plain_rewrite(doc_id, split_words(text))
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = periodic_runs.greatest_exponent(runs)
        row = rows[doc_id]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(" ".join(kept).encode()).hexdigest()
        hit += bool(runs)
    assert hit > 10


def test_odd_rows(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars", "key").withColumnRenamed("key", "runs").write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    by_text = {r.text: r for r in found}
    assert len(found) == odd.count()
    assert by_text[None].n_words == 0 and by_text[None].runs == [] and by_text[None].collapsed == ""
    assert by_text[" \t\n "].collapsed == ""
    long_text = next(r for r in found if r.doc_id == 4)
    assert [(r.start, r.length, r.period) for r in long_text.runs] == [(0, 30_000, 977)]
    assert len(long_text.collapsed.split()) == 977
    digests = periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(digests) == odd.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in digests)
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []
