import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import personal_data, toxicity

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab0123459.@+- ()é\n%", max_size=60))
def test_patterns(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_query_keeps_base_spans(spark, folder, texts):
    for r in personal_data.find_personal_data(spark.read.parquet(f"{folder}/documents.parquet")).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base == personal_data.written(base) and r.n_card == sum(k == 2 for _, k, _ in base)
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_marginals_against_enumeration():
    """On a chain without loops the messages are exact."""
    draw = np.random.default_rng(5)
    n, labels = personal_data.LABELS, personal_data.LABELS
    field = personal_data.Field(draw.normal(size=(personal_data.FEATURES, labels)), *(draw.normal(size=(n, n)) for _ in range(3)))
    chain = personal_data.Chain([0, 2, 4], [1, 3, 5], [[1], [2], [3]], [(0, 1)], [(1, 2)], [])
    score = np.zeros((n, n, n))
    for a in range(n):
        for b in range(n):
            for c in range(n):
                score[a, b, c] = field.unary[1, a] + field.unary[2, b] + field.unary[3, c] + field.near[a, b] + field.same[b, c]
    joint = np.exp(score - score.max())
    joint /= joint.sum()
    wanted = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(field.marginals(chain, 200), wanted, atol=1e-2)


def test_field_adds_what_patterns_miss(spark):
    """Cards of a wrong digit sum look like the others and are added; years and versions are not."""
    def card(i):
        body = f"4{i * 7919 % 10**14:014d}"
        return next(body + str(d) for d in range(10) if personal_data.luhn(body + str(d)))

    rows = [(i, f"pay with {card(i)} now in 2024 version 3.1") for i in range(200)]
    wrong = card(500)[:-1] + str((int(card(500)[-1]) + 1) % 10)
    rows.append((999, f"pay with {wrong} now in 2024 version 3.1"))
    found = {r.doc_id: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string"), redact=True).collect()}
    assert found[999].base == "" and found[999].spans == "card:9:25" and found[999].redacted == "pay with [CARD] now in 2024 version 3.1"
    assert found[1].spans == found[1].base == "card:9:25"


def test_block_max_is_exact():
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        terms = np.sort(draw.choice(40, draw.integers(1, 6), replace=False))
        weights = draw.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, weights / np.sqrt((weights ** 2).sum())))
    index = toxicity.BlockMaxIndex(40, vectors, np.zeros(500), list(range(500)))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        cosine = np.round(dense @ dense[i], 9)
        cosine[i] = 0
        wanted = [j for j in np.lexsort((np.arange(500), -cosine)) if cosine[j] > 0][:15]
        found, scores = index.nearest(*vectors[i], 15, without=i)
        assert np.allclose(scores, cosine[wanted]) and np.allclose(np.sort(cosine[found]), np.sort(cosine[wanted]))


def test_isotonic():
    raw, rate = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(raw) > 0).all() and (np.diff(rate) >= 0).all() and len(raw) == 3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in toxicity.op6_toxicity(spark, folder).collect() if r.doc_id in labels]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    assert np.mean(clean) < 0.05
    order = sorted(held, key=lambda r: r.score)
    ranks = {r.doc_id: i for i, r in enumerate(order)}
    pairs = [(ranks[a.doc_id] > ranks[b.doc_id]) for a in held if labels[a.doc_id] for b in held if not labels[b.doc_id]]
    assert np.mean(pairs) > 0.75


def test_scores_equal_brute_force(spark, folder, documents):
    """Scores and evidence of the query next to cosines of all pairs in plain Python."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    training = f"NOT {toxicity.HELD_OUT}"
    scored = {r.doc_id: r for r in toxicity.score_toxicity(documents, labels, training).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.filter(training).collect() if r.toxic is not None}
    counts = {r.doc_id: toxicity.words_of(r.text.encode() if r.text else None) for r in documents.collect()}
    known = sorted(i for i in toxic if i in counts)
    n, hits = Counter(), Counter()
    for i in known:
        n.update(counts[i].keys())
        hits.update({w: toxic[i] for w in counts[i]})
    total, df = len(known), Counter(w for c in counts.values() for w in c)
    rate = sum(toxic[i] for i in known) / total
    weight = {}
    for w in n:
        correlation = abs(hits[w] - n[w] * rate) / np.sqrt(n[w] * rate * (1 - rate) * total)
        weight[w] = max(np.log((1 + len(counts)) / (1 + df[w])), 1e-3) * (correlation * n[w] / (n[w] + 5) + 0.02)

    def vector(i):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in counts[i].items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(i) for i in counts}

    def vote(i, without=None):
        cosines = {j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in known if j != without}
        best = [j for j in sorted(known, key=lambda j: (-round(cosines.get(j, -1), 6), j)) if cosines.get(j, 0) > 1e-9][:15]
        shares = {j: 1 / (1.02 - min(cosines[j], 1)) for j in best}
        return (sum(shares[j] * toxic[j] for j in best) / sum(shares.values()) if best else None), best

    votes = [vote(i, i)[0] for i in known]
    near = [k for k, v in enumerate(votes) if v is not None]
    raw, calibrated = toxicity.isotonic(np.array([votes[k] for k in near]), np.array([float(toxic[known[k]]) for k in near]))
    for i in sorted(counts)[::3]:
        value, best = vote(i)
        if value is not None:
            assert abs(scored[i].score - np.interp(value, raw, calibrated)) < 2e-3
            assert len(set(map(str, best)) & set(scored[i].evidence)) >= len(best) - 1


def test_text_ids_and_repeated_ids(spark):
    words = ["good day to all of you", "you are an idiot and a fool", "what a fine morning it is", "such an idiot, you fool"]
    rows = [(f"d{i}", words[i % 4]) for i in range(40)] + [("d1", "you are an idiot and a fool")] * 5
    documents = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    assert toxicity.chosen_examples(documents, labels, "true", 10, 1 << 20).count() == 10
    assert toxicity.chosen_examples(documents, labels, "true", 40, 100).agg({"doc_id": "count"}).first()[0] <= 5
    found = toxicity.score_toxicity(documents, labels, "true").collect()
    assert len(found) == 45 and all(r.predicted == ("idiot" in r.text) for r in found)
    assert all(e.startswith("d") for r in found for e in r.evidence)


def test_few_examples(spark, folder):
    """Labelled toxic rows are rejected on the smallest tables, and a copy of any example finds it."""
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    training = f"NOT {toxicity.HELD_OUT}"
    toxic = {r.doc_id for r in labels.filter(training).filter("toxic = 1").collect()}
    scored = {r.doc_id: r for r in toxicity.score_toxicity(documents, labels, training).collect()}
    assert toxic and all(scored[i].predicted == 1 for i in toxic)
    assert sum(r.predicted for r in scored.values()) < 0.3 * len(scored)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in labels.filter(training).collect():
        assert any(texts[int(i)].split() == texts[r.doc_id].split() for i in scored[r.doc_id].evidence)


def test_odd_rows(spark, odd):
    found = personal_data.find_personal_data(odd, redact=True)
    by = {r.doc_id: r for r in found.collect()}
    assert found.count() == odd.count() and by[2].spans == "" and by[2].redacted is None and by[3].redacted == ""
    assert by[7].n_phone == 1 and by[7].n_email == 1 and by[7].redacted.startswith("call [PHONE] or [EMAIL] ")
    assert personal_data.find_personal_data(odd.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, 0), (4, None)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        scored = toxicity.score_toxicity(odd, known, "true")
        assert scored.count() == odd.count() and scored.filter("score IS NULL OR predicted IS NULL").count() == 0
    assert toxicity.score_toxicity(odd.limit(0), labels, "true").count() == 0
