"""Operator 4: toxicity by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, held_out, parts_by_bytes, sampled, table
from .quality import labelled_ids

FOLDS, FOLD = 4, 2
CUT = 0.3
#: Labelled documents of each class that the field is trained on, at most (about; by a hash of the id).
SAMPLE = 3_000
#: Bytes of text that are learned from, at most (about); longer ones than LONGEST aren't.
SAMPLE_BYTES, LONGEST = 48 << 20, 1 << 20
#: Tokens of a training window, windows of each class; weights nearer to zero than LEAST are left out.
WINDOW, WINDOWS, LEAST = 48, 2_500, 0.02
#: Weight of the squares in the fit of documents.
RIDGE = 0.02
#: Scores of words that a worker holds.
HELD = 400_000
STEP = 256
EDGES = ".,;:!?\"'()[]{}*#%$&|-_"


def features(word: str) -> tuple[str, ...]:
    """Names of a token's features: the word, its beginnings, its end, its length."""
    w = word.strip(EDGES).lower()
    return "w" + w, "4" + w[:4], "5" + w[:5], "6" + w[:6], "s" + w[-4:], "l%d" % min(len(w), 20)


def moebius(a, b, c, d, start):
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) for all t, in steps over chunks of STEP at once.

    Each chunk's maps are composed first, so that what comes before a chunk is known exactly when
    its own values are worked out.
    """
    n = len(a)
    chunks = -(-n // STEP)
    m = np.zeros((4, chunks * STEP))
    m[0], m[3] = 1, 1
    for x, y in zip(m, (a, b, c, d)):
        x[:n] = y
    A, B, C, D = m.reshape(4, chunks, STEP).transpose(0, 2, 1)
    p, q, r, s = np.ones(chunks), np.zeros(chunks), np.zeros(chunks), np.ones(chunks)
    for t in range(STEP):
        p, q, r, s = A[t] * p + B[t] * r, A[t] * q + B[t] * s, C[t] * p + D[t] * r, C[t] * q + D[t] * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    x = np.empty(chunks)
    for k in range(chunks):
        x[k] = start
        start = (p[k] * start + q[k]) / (r[k] * start + s[k])
    out = np.empty((STEP, chunks))
    for t in range(STEP):
        x = (A[t] * x + B[t]) / (C[t] * x + D[t])
        out[t] = x
    return out.T.ravel()[:n]


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: float) -> np.ndarray:
    """Forward-backward over sequences laid end to end: the probability of state 1 at each token.

    emission: log potential of state 1 against 0; moves: 2 x 2 log potentials; begin: log potential
    of state 1 at a sequence's first token.
    """
    if not len(emission):
        return emission
    e, t = np.exp(np.clip(emission, -40, 40)), np.exp(moves)
    first = np.zeros(len(e), bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    last = np.r_[first[1:], True]
    forward = moebius(np.where(first, 0, e * t[1, 1]), np.where(first, e * np.exp(begin), e * t[0, 1]), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0]), 1.0)
    after = np.r_[e[1:], 1.0]
    a, b, c, d = np.where(last, 0, after * t[1, 1]), np.where(last, 1, t[1, 0]), np.where(last, 0, after * t[0, 1]), np.where(last, 1, t[0, 0])
    backward = moebius(a[::-1], b[::-1], c[::-1], d[::-1], 1.0)[::-1]
    odds = forward * backward
    return odds / (1 + odds)


class Field:
    """Weights of token features, of moves between states and of the start; two numbers make a document's score."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves, self.begin = np.zeros((2, 2)), 0.0
        self.bias, self.by_doc = -4.0, np.array([-4.0, 1.0, 1.0])
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def emission(self, words: list[str]) -> np.ndarray:
        known = self.words
        try:
            return np.fromiter(map(known.__getitem__, words), float, len(words))
        except KeyError:
            pass
        get, bias = self.weights.get, self.bias
        new = set(words).difference(known)
        if len(known) + len(new) > HELD:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = sum([get(f, 0.0) for f in features(w)], bias)
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def tag(self, texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
        words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = [w for x in words for w in x]
        m = marginals(self.emission(flat), lengths, self.moves, self.begin)
        return words, np.split(m, np.cumsum(lengths)[:-1]) if len(lengths) else []

    def aggregate(self, m: np.ndarray) -> list[float]:
        """Of a document's marginals: log odds of the greatest, and log expected toxic tokens."""
        top = float(m.max()) if len(m) else 0.0
        return [1.0, np.log((top + 1e-6) / (1 - top + 1e-6)) / 4, np.log(float(m.sum()) + 1e-3)]

    def score(self, parts: list[np.ndarray]) -> np.ndarray:
        x = np.array([self.aggregate(m) for m in parts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.by_doc, -40, 40)))

    def spans(self, text: str, m: np.ndarray, at: float = 0.5) -> list[tuple[int, int]]:
        """Character offsets (begin, end) of runs of tokens whose marginal is over `at`."""
        out: list[tuple[int, int]] = []
        before = -2
        for k, found in enumerate(re.finditer(r"\S+", text) if (m > at).any() else ()):
            if k < len(m) and m[k] > at:
                if before == k - 1:
                    out[-1] = (out[-1][0], found.end())
                else:
                    out.append(found.span())
                before = k
        return out


def token_labels(docs: list[tuple[str, int]]) -> list[np.ndarray]:
    """Token labels from document labels: a token is toxic if it is in a toxic document and one of its
    features is found, among these documents, almost only in toxic ones."""
    have: Counter = Counter()
    toxic: Counter = Counter()
    slots: dict[str, tuple[str, ...]] = {}
    rows = []
    for text, label in docs:
        words = text.split()
        for w in set(words).difference(slots):
            slots[w] = features(w)[:4]
        found = {f for w in set(words) for f in slots[w]}
        have.update(found)
        if label:
            toxic.update(found)
        rows.append(words)
    base = float(np.mean([y for _, y in docs]))
    # so often that chance would find fewer than one such feature
    often = max(3.0, np.log(1 + len(have)) / -np.log(base))
    sure = {f for f, n in toxic.items() if have[f] >= often and (n + base) / (have[f] + 1) > 1 - (1 - base) * 0.2}
    # a word that is in clean documents now and then is not toxic for its beginning
    plain = {w for (t, y), ws in zip(docs, rows) if not y for w in ws}
    bad = {w for w, x in slots.items() if w not in plain and not sure.isdisjoint(x)}
    return [np.array([y and w in bad for w in ws], bool) for ws, (_, y) in zip(rows, docs)]


def train(docs: list[tuple[str, int]], rounds: int = 40, seed: int = 7) -> Field:
    """Maximum conditional likelihood of the token labels in windows, by Adam; then a logistic fit of documents."""
    field, rng = Field(), np.random.default_rng(seed)
    if len({y for _, y in docs}) < 2:
        mean = np.mean([y for _, y in docs]) if docs else 0.5
        field.by_doc = np.array([np.log((mean + 1e-3) / (1 - mean + 1e-3)), 0.0, 0.0])
        return field
    tags = token_labels(docs)
    windows: dict[bool, list] = {False: [], True: []}
    for (text, _), tag in zip(docs, tags):
        words = text.split()
        for i in range(0, len(words), WINDOW):
            windows[bool(tag[i : i + WINDOW].any())].append((words[i : i + WINDOW], tag[i : i + WINDOW]))
    chosen = [w[k] for w in windows.values() for k in sorted(rng.permutation(len(w))[:WINDOWS])]
    n = len(chosen)
    slots: dict[str, list[int]] = {}
    number: dict[str, int] = {"": 0}
    size = len(features("x"))
    index, gold, mask = np.zeros((n, WINDOW, size), np.int64), np.zeros((n, WINDOW)), np.zeros((n, WINDOW), bool)
    for k, (words, tag) in enumerate(chosen):
        for i, w in enumerate(words):
            if w not in slots:
                slots[w] = [number.setdefault(f, len(number)) for f in features(w)]
            index[k, i] = slots[w]
        gold[k, : len(words)], mask[k, : len(words)] = tag, True
    place = index
    theta = np.zeros(len(number) + 6)
    theta[-6] = field.bias
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    lengths = mask.sum(1)
    pairs = mask[:, 1:]
    for step in range(1, rounds + 1):
        weights, bias, begin, moves = theta[: len(number)], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        e = np.where(mask, weights[place].sum(2) + bias, 0)
        # forward and backward in log space over all windows at once
        f = np.zeros((WINDOW, n, 2))
        f[0, :, 1] = e[:, 0] + begin
        for t in range(1, WINDOW):
            f[t] = np.logaddexp(f[t - 1][:, :1] + moves[0], f[t - 1][:, 1:] + moves[1])
            f[t, :, 1] += e[:, t]
        b = np.zeros((WINDOW, n, 2))
        for t in range(WINDOW - 2, -1, -1):
            nxt = b[t + 1] + np.stack((np.zeros(n), e[:, t + 1]), 1)
            back = np.logaddexp(nxt[:, :1] + moves[:, 0], nxt[:, 1:] + moves[:, 1])
            b[t] = np.where(mask[:, t + 1, None], back, 0)
        joint = f + b
        z = np.logaddexp(joint[0, :, 0], joint[0, :, 1])
        p = np.where(mask, np.exp(joint[:, :, 1] - z).T, 0)
        delta = np.where(mask, p - gold, 0)
        grad = np.zeros_like(theta)
        grad[: len(number)] = np.bincount(place.ravel(), weights=np.repeat(delta.ravel(), size), minlength=len(number)) / n + 2e-5 * weights
        grad[-6], grad[-5] = delta.sum() / n, delta[:, 0].sum() / n
        for x in (0, 1):
            for y in (0, 1):
                both = f[:-1, :, x] + moves[x, y] + (e[:, 1:].T if y else 0) + b[1:, :, y] - z
                seen = ((gold[:, :-1] == x) & (gold[:, 1:] == y) & pairs).sum()
                grad[-4 + 2 * x + y] = (np.where(pairs.T, np.exp(both), 0).sum() - seen) / n + 1e-3 * moves[x, y]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta - 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field.weights = {f: float(theta[k]) for f, k in number.items() if abs(theta[k]) >= LEAST}
    field.bias, field.begin, field.moves = float(theta[-6]), float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    x, y = [], np.array([y for _, y in docs], float)
    for i in range(0, len(docs), 200):
        x += [field.aggregate(m) for m in field.tag([t for t, _ in docs[i : i + 200]])[1]]
    x = np.array(x)
    loss = lambda w: np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + 0.5 * RIDGE * w @ w
    w = field.by_doc.copy()
    for _ in range(50):  # Newton steps of a ridge logistic fit, halved until they help
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(3), x.T @ (q - y) + RIDGE * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    field.by_doc = w
    return field


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    """Trained on at most about `most` labelled documents of each class outside the held-out fold."""
    ids = None
    for y in (0, 1):
        part = labelled_ids(labels.where(F.col("toxic") == y), "toxic", FOLDS, FOLD, most)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").where(f"octet_length(text) <= {LONGEST}")
    scratch = Scratch(docs.sparkSession)
    # a document of several rows counts with one of them, so there are no more rows than sampled ids
    rows = scratch.write(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = sampled(rows, SAMPLE_BYTES / max(size, 1), "bytes", "doc_id").select("text", "label").collect()
    scratch.close()
    return train(sorted((r.text, r.label) for r in found))


def tag_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """held_out, score, predicted and the offending spans of every document.

    The field tags every token of the whole text; marginals make the score (0 to 1, label 1 likelier
    the higher), runs of tokens over one half make the spans [begin, end) in characters. Null text
    counts as empty: the score of a document without tokens, no spans. Rows with equal or null
    doc_id each get a row; a document labelled more than once counts once, with its largest label,
    one of several rows counts with its least text; labels other than 0 and 1 are left out. If the sample has one class only, all scores are its
    share. Other columns are ignored. No rows: no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        model = field.value
        for batch in batches:
            for part in parts_by_bytes(batch):
                texts = [t or "" for t in column(part, "text")]
                _, found = model.tag(texts)
                spans = [[{"begin": a, "end": b} for a, b in model.spans(t, m)] for t, m in zip(texts, found)]
                yield pa.record_batch([part.column(0), pa.array(model.score(found), pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<begin: int, end: int>>")
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
