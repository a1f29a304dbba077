from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from rankloom.llm import packing
from rankloom.llm.token_counts import definition_text


def test_a_word_is_remembered_once():
    """Capitals and pieces had entries of their own before: five in place of two."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = packing.WordEncoder(definition_text(path)), Tokenizer.from_file(path)
    assert list(own.encode("Foo foo FOO étÉ ÉTÉ")) == library.encode("Foo foo FOO étÉ ÉTÉ", add_special_tokens=False).ids
    assert len(own.words) + len(own.pieces) == 2


def test_ids_of_odd_texts_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = packing.WordEncoder(definition_text(path)), Tokenizer.from_file(path)
    for text in ("A.B, c!? 3.14 X-Y don't DON'T", "<|ENDOFTEXT|> <|endoftext|> a<b", "İstanbul ΣΑΣ ß µ ÿ Ÿ", "é É ﬁ", "a B\u0085C\x1cD", "ĀbĆ. Ǆ", "²³ª º¼"):
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_packing_lets_go_of_the_words_that_cutting_remembered(monkeypatch):
    """A worker that cut texts and then packs held both the words and a shard before."""
    definition = definition_text(public_tokenizers.path("word_bpe_49k.json"))
    ids = packing.encoder(definition).encode("one two three").astype("<u4").tobytes()
    assert packing.encoder.cache_info().currsize == 1
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])
    tail = pa.record_batch([pa.array([x]) for x in (7, 0, len(ids) // 4, 5, len(ids) // 4, ids)],
                           ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packed = [row for batch in packing.pack_partition([tail], schema, 1 << 20) for row in batch.to_pylist()]
    assert [(row["doc_id"], row["length"]) for row in packed] == [(7, len(ids) // 4)]
    assert packing.encoder.cache_info().currsize == 0
