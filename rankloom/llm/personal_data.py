"""Personal data by fixed patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import release_memory, row_key, sized_batches, table
from rankloom.session import cut_lineage, ship_package

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
FEATURES = 1 << 13
#: The field is fitted on at most so many texts with candidates, of at most so many candidates each.
SAMPLE_TEXTS, SAMPLE_CANDIDATES = 2048, 400
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(rb"[0-9@]")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGES = ".,;:!?\"'<>[]{}|"
_SPACES = "\x20\t\n\x0b\x0c\r"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        n = n * 2 - 9 * (n > 4) if i % 2 else n
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from each @ to both sides, so long words cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, 0, domain.end()
            free = domain.end()
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Chain:
    """Candidate tokens of a text: the words with a digit or @. All other words are certain to be no entity."""

    start: list[int]
    end: list[int]
    features: list[list[int]]
    near: list[tuple[int, int]]  # neighbours in the text
    same: list[tuple[int, int]]  # a token and its last occurrence before
    alike: list[tuple[int, int]]  # a token and the last one of its shape before, if no equal one


def shape_of(token: str) -> str:
    """Digits as their run lengths, letters as a single a; other characters stay."""
    return re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", re.sub(r"[^\W\d_]+", "a", token))


def build_chain(text: str) -> Chain:
    chain, last_same, last_shape, words = Chain([], [], [], [], [], []), {}, {}, []
    for m in _CANDIDATE.finditer(text):
        token = m.group().rstrip(_EDGES)
        start = m.start() + len(token) - len(token := token.lstrip(_EDGES))
        words.append((token, shape_of(token), start, start + len(token), m.start(), m.end()))
    for i, (token, shape, start, end, left, right) in enumerate(words):
        before = words[i - 1] if i and not text[words[i - 1][5]:left].strip(_SPACES) else None
        after = words[i + 1] if i + 1 < len(words) and not text[right:words[i + 1][4]].strip(_SPACES) else None
        digits = sum("0" <= c <= "9" for c in token)
        names = ["1", f"s{shape}", f"d{min(digits, 20)}", f"@{token.count('@')}", f".{min(token.count('.'), 4)}", f"+{token[:1]}",
                 f"<{before[1] if before else ''}|{shape}", f">{after[1] if after else ''}|{shape}",
                 f"c{len(set(shape) - set('a0123456789'))}|{min(digits, 20)}"]
        chain.features.append([zlib.crc32(n.encode()) % FEATURES for n in names])
        chain.start.append(start)
        chain.end.append(end)
        if before:
            chain.near.append((i - 1, i))
        if token in last_same:
            chain.same.append((last_same[token], i))
        elif shape in last_shape:
            chain.alike.append((last_shape[shape], i))
        last_same[token] = last_shape[shape] = i
    return chain


def token_labels(chain: Chain, spans: list[Span]) -> list[int]:
    """Kind of the span that covers a token, or OTHER."""
    labels, at = [], 0
    for start, end in zip(chain.start, chain.end, strict=True):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        labels.append(next((k for s, k, e in spans[at:at + 4] if s < end and start < e), OTHER))
    return labels


@dataclass
class Field:
    """Weights of tokens and of the three kinds of edges."""

    unary: np.ndarray
    near: np.ndarray
    same: np.ndarray
    alike: np.ndarray

    def marginals(self, chain: Chain, rounds: int = 30) -> np.ndarray:
        """Loopy sum-product with damping, in logarithms; messages are updated side by side until they settle."""
        score = self.unary[np.array(chain.features)].sum(1)
        edges = [(a, b, w) for pairs, w in ((chain.near, self.near), (chain.same, self.same), (chain.alike, self.alike)) for a, b in pairs]
        if edges:
            source = np.array([e[0] for e in edges] + [e[1] for e in edges])
            target = np.array([e[1] for e in edges] + [e[0] for e in edges])
            weight = np.stack([e[2] for e in edges] + [e[2].T for e in edges])
            back = np.concatenate((np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))))
            message = np.zeros((len(source), LABELS))
            for _ in range(rounds):
                belief = score.copy()
                np.add.at(belief, target, message)
                joint = (belief[source] - message[back])[:, :, None] + weight
                top = joint.max(1, keepdims=True)
                new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
                new = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
                settled = np.abs(new - message).max() < 1e-3
                message = new
                if settled:
                    break
            score = score.copy()
            np.add.at(score, target, message)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)


def learn(chains: list[Chain], labels: list[list[int]], steps: int = 60) -> Field:
    """Pseudo-likelihood by adaptive gradient steps: each token given the labels of the tokens it shares an edge with."""
    field = Field(np.zeros((FEATURES, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3)))
    field.unary[:, OTHER] = 0.05
    if not chains:
        return field
    offset = np.cumsum([0] + [len(c.features) for c in chains])
    features = np.array([f for c in chains for f in c.features])
    truth = np.array([x for own in labels for x in own])
    pairs = [np.array([(a + o, b + o) for c, o in zip(chains, offset[:-1], strict=True) for a, b in getattr(c, name)], np.int64).reshape(-1, 2)
             for name in ("near", "same", "alike")]
    weights = [field.unary, field.near, field.same, field.alike]
    memory = [np.full_like(w, 1e-2) for w in weights]
    hot = np.eye(LABELS)[truth]
    for _ in range(steps):
        score = field.unary[features].sum(1)
        for edge, weight in zip(pairs, weights[1:], strict=True):
            np.add.at(score, edge[:, 1], weight[truth[edge[:, 0]]])
            np.add.at(score, edge[:, 0], weight[:, truth[edge[:, 1]]].T)
        score = np.exp(score - score.max(1, keepdims=True))
        gap = (hot - score / score.sum(1, keepdims=True)) / len(truth)
        steps_of = [np.zeros_like(w) for w in weights]
        np.add.at(steps_of[0], features, gap[:, None, :])
        for edge, step in zip(pairs, steps_of[1:], strict=True):
            np.add.at(step, truth[edge[:, 0]], gap[edge[:, 1]])
            np.add.at(step.T, truth[edge[:, 1]], gap[edge[:, 0]])
        for weight, step, seen in zip(weights, steps_of, memory, strict=True):
            step -= 1e-4 * weight
            seen += (step * 30) ** 2
            weight += 0.3 * step * 30 / np.sqrt(seen)
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the ones that the field adds: runs of neighbouring tokens of one sure kind that touch no base span."""
    base = base_spans(text)
    chain = build_chain(text)
    if not chain.start:
        return base, base
    covered = token_labels(chain, base)
    found = field.marginals(chain)
    kind = np.where(found.max(1) >= SURE, found.argmax(1), OTHER)
    near, added = {b: a for a, b in chain.near}, []
    last = None
    for i, k in enumerate(kind.tolist()):
        if k == OTHER or covered[i] != OTHER or chain.start[i] >= chain.end[i]:
            last = None
            continue
        if last is not None and near.get(i) == last and added[-1][1] == k:
            added[-1] = (added[-1][0], k, chain.end[i])
        else:
            added.append((chain.start[i], k, chain.end[i]))
        last = i
    if not added:
        return base, base
    touching = {a for a in added for b in base if a[0] < b[2] and b[0] < a[2]} if base else set()
    return base, sorted(base + [a for a in added if a not in touching])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fit(documents: DataFrame, text: str = "text", texts: int = SAMPLE_TEXTS) -> Field:
    """Learns from the labels that the patterns give to the candidates of a bounded sample of texts.

    The sample holds at most ``texts`` rows with a digit or @ (those with the smallest hash of their text), without the
    few of more than SAMPLE_CANDIDATES candidates. The field's features do not hold what the patterns check beyond form
    (sums of digits, ranges), so it also labels entities that they miss. Only feature numbers reach the driver.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.withColumn("key", row_key("text"))

    def chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            keys, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                chain = build_chain(text)
                if chain.start and len(chain.start) <= SAMPLE_CANDIDATES:
                    keys.append(key)
                    found.append(repr((chain.features, chain.near, chain.same, chain.alike, token_labels(chain, base_spans(text)))))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "chain"])

    low = rows.select("key").distinct().orderBy("key").limit(4 * texts)
    bound = cut_lineage(low).agg(F.max("key")).first()[0]
    if bound is None:
        return learn([], [])
    sample = rows.filter(F.col("key") <= bound).dropDuplicates(["key"]).select("key", "text").mapInArrow(chains, "key bigint, chain string")
    import ast

    parsed = [ast.literal_eval(r[0]) for r in sample.orderBy("key").limit(texts).select("chain").collect()]
    return learn([Chain([], [], *p[:4]) for p in parsed], [p[4] for p in parsed])


RESULT = pa.struct([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
                    ("base", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def find_column(spark: SparkSession, field: Field, text: Column, redact: bool = False) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base, spans, redacted) of a text column; redacted only on request."""
    held = spark.sparkContext.broadcast(field)

    @F.arrow_udf("struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base: string, spans: string, redacted: string>")
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            raw = value.as_py()
            if not raw or not _SIGN.search(raw):
                out.append({"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base": "", "spans": "",
                            "redacted": raw.decode() if redact and raw is not None else None})
                continue
            text = raw.decode()
            base, spans = all_spans(text, held.value)
            counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            out.append({"n_email": counts[0], "n_ip": counts[1], "n_card": counts[2], "n_phone": counts[3], "base": written(base),
                        "spans": written(spans), "redacted": masked(text, spans) if redact else None})
        found = pa.array(out, RESULT)
        del out
        release_memory()
        return found

    return find(text.cast("binary"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one's name stays."""
    out, free = [], 0
    for start, kind, end in spans:
        if start >= free:
            out += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def find_personal_data(documents: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (pattern matches), base and spans (kind:start:end, comma-joined) to every row.

    Spans are those of the patterns and the ones that the field adds where no pattern matched. Offsets are code
    points, ends exclusive. Null and empty texts have none. Repeated rows are judged each; an empty table gives no rows;
    columns of these names are replaced, others stay. With ``redact`` the column ``redacted`` has the text with spans masked
    (null stays null). Texts are scanned in place, never shuffled; work is linear in a text's length, since a token has edges
    only to its neighbours and to the last equal or alike token before it.
    """
    field = fit(documents, text)
    found = documents.withColumn("__found", find_column(documents.sparkSession, field, F.col(text), redact))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"] + ["redacted"] * redact
    return found.withColumns({n: F.col(f"__found.{n}") for n in names}).drop("__found")


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
