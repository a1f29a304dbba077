import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import class_model, kmeans_tree, near_copies, product_grid
from rankloom.llm.common import components


def sets_of(texts):
    out = {}
    for doc, text in texts.items():
        words = text.encode().split() if text else []
        out[doc] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_classes(ids, linked):
    links, root = Counter(), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        links[a] += 1
        links[b] += 1
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return links, {i: find(i) for i in ids}


def near_pairs(texts):
    sets, ids = sets_of(texts), sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                yield a, b


def check_copies(rows, texts):
    links, root = brute_classes(texts, near_pairs(texts))
    for r in rows:
        assert (r.n_links, r.class_id, r.kept) == (links[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id), r


def test_copies_query(spark, folder, texts):
    check_copies(near_copies.op10_near_copies(spark, folder).collect(), texts)


@pytest.mark.parametrize("bucket, weight", [(2048, 1 << 21), (8, 400)])
def test_large_groups(spark, bucket, weight):
    """Near copies of one text, copies, and a passage that all others share; small limits send them through splits and blocks."""
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in draw.integers(0, 5000, 120)]
    texts = {}
    for i in range(60):
        words = list(base)
        words[int(draw.integers(0, 120))] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {100 + i: texts[i % 5] for i in range(20)}
    texts |= {200 + i: " ".join(base[:40] + [f"y{i}_{j}" for j in range(40)]) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_copies(near_copies.near_copies(frame, bucket=bucket, weight=weight).collect(), texts)


def test_pairs_with_only_large_buckets(spark):
    """Texts of one common passage and one of two common endings; the endings' buckets are smaller than the passage's."""
    texts = {}
    for f in range(8):
        passage, ends = [f"p{f}_{i}" for i in range(110)], [[f"e{f}_{e}_{i}" for i in range(11)] for e in range(2)]
        for e in range(2):
            texts[1000 * f + e] = " ".join(passage + ends[e])
            texts |= {1000 * f + 100 * (e + 1) + i: " ".join(ends[e] + [f"s{f}_{e}_{i}_{j}" for j in range(4)]) for i in range(14)}
        texts |= {1000 * f + 300 + i: " ".join(passage + [f"t{f}_{i}_{j}" for j in range(50)]) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r for r in near_copies.near_copies(frame, bucket=8).collect()}
    assert [(found[1000 * f + e].n_links, found[1000 * f + e].class_id) for f in range(8) for e in range(2)] == [(1, 1000 * f) for f in range(8) for _ in range(2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 900)] + [(950, 950), (1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 900)}, 1000: 1000, 1001: 1000}


def test_odd_texts(spark, odd):
    found = near_copies.near_copies(odd)
    assert found.count() == odd.count()
    by = {r.doc_id: r for r in found.collect()}
    assert (by[1].n_links, by[8].n_links, by[8].class_id, by[2].n_links, by[3].class_id) == (2, 2, 1, 0, 3)
    assert near_copies.near_copies(odd.limit(0)).count() == 0
    scored = class_model.score_texts(odd, "true")
    assert scored.count() == odd.count() and {r.n_tokens for r in scored.filter("doc_id IN (2, 3, 5)").collect()} == {1}
    assert scored.filter("score IS NULL OR isnan(score) OR base_score IS NULL").count() == 0
    assert class_model.score_texts(odd.limit(0), "true").count() == 0
    assert class_model.score_texts(odd, "false").filter("train_tokens <> 0 OR n_known <> 0 OR isnan(score)").count() == 0


def test_class_model_query(spark):
    folder = "/root/testdata/sf0.01"
    words, counts = {}, Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words[r.doc_id] = [*r.text.encode().lower().split(), None]
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(words[r.doc_id])
    total = sum(counts.values())
    base = model = n = 0
    for r in class_model.op9_class_model(spark, folder).collect():
        own = words[r.doc_id]
        wanted = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in own)
        assert abs(r.base_score - wanted) < 1e-6 * len(own) and r.n_known == sum(counts[w] > 0 for w in own)
        assert (r.n_tokens, r.train_tokens) == (len(own), total)
        if r.held_out:
            base, model, n = base + r.base_score, model + r.score, n + len(own)
    assert model / n > base / n + 0.1


def test_exchange_gain_is_the_change_of_likelihood():
    draw = np.random.default_rng(6)
    n, k = 12, 4
    pairs = draw.integers(0, 9, (n, n)).astype(float)
    classes = draw.integers(0, k, n)

    def table(now):
        out = np.zeros((k, k))
        np.add.at(out, (now[:, None].repeat(n, 1), now[None, :].repeat(n, 0)), pairs)
        return out

    for s in range(n):
        others = np.arange(n) != s
        left = np.bincount(classes[others], pairs[others, s], k)
        right = np.bincount(classes[others], pairs[s, others], k)
        best = class_model.best_class(int(classes[s]), left, right, pairs[s, s], table(classes))
        scores = []
        for c in range(k):
            moved = classes.copy()
            moved[s] = c
            scores.append(class_model.likelihood(table(moved)))
        assert scores[best] >= max(scores) - 1e-6


def vectors_frame(spark, n=1500, length=16):
    draw = np.random.default_rng(8)
    values = draw.normal(size=(n, length))
    values[300:600] = values[0] + 0.12 * draw.normal(size=(300, length))
    values[600:700] = values[1]
    labels = [None if i % 97 == 0 else int(i % 3 == 0) for i in range(n)]
    rows = [(i, v.astype(np.float32).tolist(), label, "extra") for i, (v, label) in enumerate(zip(values, labels, strict=True))]
    rows += [(n, None, 0, "x"), (n + 1, [0.0] * length, 0, "x"), (n + 2, [float("nan")] * length, 0, "x"), (n + 3, [float("inf")] + [1.0] * (length - 1), 1, "x"),
             (n + 4, [None] + [1.0] * (length - 1), 1, "x"), (n + 5, [1.0], 1, "x"), (n + 6, [], 1, "x")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, copies string"), values.astype(np.float32).astype(float), labels


def test_vector_links(spark):
    frame, values, labels = vectors_frame(spark)
    norm = values / np.sqrt((values ** 2).sum(1, keepdims=True))
    near = np.triu(norm @ norm.T >= 0.93, 1)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if labels[a] is not None and labels[a] == labels[b]]
    links, root = brute_classes(range(len(values)), pairs)
    found = product_grid.near_vectors(frame).collect()
    assert len(found) == len(values) + 7
    wrong = 0
    for r in found:
        if r.vec_id >= len(values):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            wrong += r.n_links != links[r.vec_id]
            assert r.component_id == root[r.vec_id] and r.kept == (root[r.vec_id] == r.vec_id)
    assert wrong <= 0.01 * len(values)
    assert product_grid.near_vectors(frame.limit(0)).count() == 0


def test_multi_sequence_order():
    draw = np.random.default_rng(9)
    a, b = draw.random(6), draw.random(5)
    sums = [a[i] + b[j] for i, j in product_grid.multi_sequence(a, b)]
    assert len(sums) == 30 and sums == sorted(sums)


def test_nearest(spark):
    frame, values, _ = vectors_frame(spark)
    norm = values / np.sqrt((values ** 2).sum(1, keepdims=True))
    cosine = norm @ norm.T
    np.fill_diagonal(cosine, -2)
    found = {}
    for r in kmeans_tree.nearest(frame, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, got in found.items():
        assert len(got) == 5 and all(abs(s - cosine[q, v]) < 1e-9 for v, s in got) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        hits += len({v for v, _ in got} & set(np.lexsort((np.arange(len(values)), -np.round(cosine[q], 12)))[:5].tolist()))
    assert len(found) == 30 and hits >= 0.95 * 150
    assert [v for v, _ in found[600]] == [1, 601, 602, 603, 604]
    assert kmeans_tree.nearest(frame.limit(0), "true").count() == 0
    assert kmeans_tree.nearest(frame.filter("vec_id < 3"), "vec_id = 0").count() == 2


def test_links_of_repeated_ids(spark):
    """One vec_id with different vectors or labels: each row links for itself."""
    v, w, far = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, v, 0), (2, w, 0), (2, v, 1), (3, w, 1), (4, v, 2), (4, w, 2), (5, far, 2), (5, far, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in product_grid.near_vectors(frame).collect())
    assert found == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (5, 0, 5, True)])
