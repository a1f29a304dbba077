import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rankloom.llm import packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"abcdefghij  \n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0​　'sdllé́½²Ⅷ٣中🙂,.!<|ΣÉİ", "<|endoftext|>", "<|endof", " the", "ing", "<|startoftext|>", "  "]


def strings(n):
    draw = random.Random(3)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    own, library = token_counts.MergeCounter(token_counts.definition_text(BYTE)), Tokenizer.from_file(BYTE)
    for text in [*strings(2000), "a" * 5000, "\n" * 300, "ab" * 3000]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_ids_equal_the_library():
    own, library = packing.WordEncoder(packing.definition_text(WORD)), Tokenizer.from_file(WORD)
    for text in strings(2000):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_count_query(spark, folder, texts):
    library = Tokenizer.from_file(BYTE)
    for row in token_counts.op1_token_counts(spark, folder).collect():
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(texts[row.doc_id].encode()), n > 1024)


def check_pieces(rows, texts):
    """Every id in one piece, sequences gapless and within the window, digests right; ``texts`` may hold repeats."""
    library = Tokenizer.from_file(WORD)
    wanted = {}
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.setdefault(doc, []).append(ids)
    covered = {doc: np.zeros(len(own[0]), int) for doc, own in wanted.items()}
    for r in rows:
        ids = wanted[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        covered[r.doc_id][r.start:r.start + r.length] += 1
    assert all((n == len(wanted[doc])).all() for doc, n in covered.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    return sequences


def test_packing_query(spark, folder, texts):
    sequences = check_pieces(packing.op2_packing(spark, folder).collect(), texts.items())
    assert sum(sum(n for _, n in own) < 2048 for own in sequences.values()) <= 1


def test_small_shards(documents, texts):
    check_pieces(packing.pack(documents, WORD, shard_tokens=20_000).collect(), texts.items())


def test_neighbours_come_first():
    draw = np.random.default_rng(1)
    kinds = [draw.integers(i * 500, i * 500 + 500, (20, 300)) for i in range(4)]
    tails = [(i, 0, 300, 0, 300, ids.astype("<u4").tobytes()) for i, ids in enumerate(np.concatenate(kinds))]
    windows = list(packing.Shard(tails).windows())
    pure = [len({tail // 20 for tail, _, _ in window}) == 1 for window in windows]
    assert sum(pure) >= len(windows) - 4


def test_odd_rows(spark, odd):
    counted = token_counts.token_counts(odd, BYTE)
    assert counted.count() == odd.count() and set(odd.columns) < set(counted.columns)
    by = {r.doc_id: r for r in counted.collect()}
    assert (by[2].n_tokens, by[2].n_bytes, by[3].n_tokens) == (0, 0, 0) and by[4].over_limit
    check_pieces(packing.pack(odd, WORD).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert token_counts.token_counts(odd.limit(0), BYTE).count() == 0 and packing.pack(odd.limit(0), WORD).count() == 0
