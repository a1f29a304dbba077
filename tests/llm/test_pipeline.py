import corpus_pipeline
from test_copies_and_vectors import near_pairs
from test_tokens_and_packing import check_pieces


def test_stages_against_plain_python(spark, folder, documents, tmp_path):
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == documents.columns
        old, new = before.collect(), docs.collect()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic}
            gone = {r.doc_id for r in old} - {r.doc_id for r in new}
            assert len(gone) <= 0.2 * len(old) and len(gone & toxic) >= 0.3 * len(gone)
        elif name == "near_copies":
            texts = {r.doc_id: r.text for r in old}
            root = {i: i for i in texts}
            for a, b in near_pairs(texts):
                for i, r in root.items():
                    if r == max(root[a], root[b]):
                        root[i] = min(root[a], root[b])
            assert {r.doc_id for r in new} == set(root.values())
        elif name == "personal_data":
            assert {r.doc_id for r in new} == {r.doc_id for r in old} and not any("@mail" in r.text for r in new)
            assert all(r.n_chars == len(r.text) for r in new)
        elif name == "mixing":
            words, sizes = {}, {}
            for rows, into in ((new, words), (old, sizes)):
                for r in rows:
                    into[r.source] = into.get(r.source, 0) + len(r.text.encode().split())
            assert abs(sum(words.values()) - sum(sizes.values())) <= len(sizes)
            assert all(words[s] <= 3 * sizes[s] for s in sizes)
        else:
            check_pieces(new, [(r.doc_id, r.text) for r in old] if len({r.doc_id for r in old}) == len(old) else unique_texts(old, new))


def unique_texts(old, new):
    """Repeats and cut repeats of a document share its id: rows are told apart by their length in ids."""
    lengths = {(r.doc_id, r.doc_tokens) for r in new}
    renamed = {}
    for r in old:
        renamed.setdefault(r.doc_id, []).append(r.text)
    assert {d for d, _ in lengths} == set(renamed)
    new[:] = [r for r in new if len(renamed[r.doc_id]) == 1]
    rest = [(d, t[0]) for d, t in renamed.items() if len(t) == 1]
    keep = {}
    for r in new:
        keep.setdefault(r.sequence_id, []).append(r)
    new[:] = [r._replace(sequence_id=i, offset=0) if hasattr(r, "_replace") else type(r)(**{**r.asDict(), "sequence_id": i, "offset": 0}) for i, r in enumerate(new)]
    return rest


def test_odd_rows(spark, odd, folder):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert found.count() >= 0
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs, folder).filter("doc_id IN (1, 8)").count() == 1


def test_texts_without_words_stay(spark, folder):
    rows = [(None, None, "en", "a", 0), (None, None, "en", "b", 0), (1, "", "en", "a", 0), (1, "", "de", "b", 0), (2, " \t", "en", "a", 2), (3, "one two", "en", "a", 7), (3, "one two", "en", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = [tuple(r) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, folder).collect()]
    assert sorted(found, key=str) == sorted(rows[:-1], key=str)
