"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) per token. Emissions are sums of feature weights: the word,
its first 3 to 5 and last 3 letters. Documents are labelled, tokens are not, so the
tokens to learn from are labelled first: in toxic documents, those with a feature that
is significantly more frequent among toxic documents; all others are clean. The field
is fitted by gradient ascent on its likelihood. Forward-backward marginals over each
whole text give the offending offsets and, summed up per document and calibrated
against the document labels, its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import bounded_chunks, held_out, keyed_sample, map_rows, python_workers, table

#: The fit reads at most this many labelled documents of each label, by least hash of the id ...
FIT_DOCS = 2500
#: ... none longer than this many characters, and spans of this many tokens of them.
FIT_CHARS = 50_000
SPAN = 128
FEATURE_BITS = 18
#: Documents at or above this score are predicted toxic.
THRESHOLD = 0.3
#: Tokens with at least this marginal belong to an offending span.
SPAN_MARGINAL = 0.5
_TOKEN = re.compile(r"[^\W_]+")
_L = 64


def token_features(word: str) -> list[int]:
    w = word.lower()
    names = [f"w={w}", f"p3={w[:3]}", f"p4={w[:4]}", f"p5={w[:5]}", f"s3={w[-3:]}"]
    return [zlib.crc32(n.encode()) & ((1 << FEATURE_BITS) - 1) for n in names]


def label_features(texts: list[list[str]], toxic: np.ndarray, least_z: float = 4.0) -> set[int]:
    """Features that mark toxic documents: signed root of the G statistic of at least `least_z`."""
    pos, neg = Counter(), Counter()
    for words, y in zip(texts, toxic, strict=True):
        seen: set[int] = set()
        for w in set(words):
            seen.update(token_features(w))
        (pos if y else neg).update(seen)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    found = set()
    for f, a in pos.items():
        b = neg.get(f, 0)
        if a < 4 or a / n1 <= 8 * (b + 0.5) / n0:
            continue
        total = (a + b) / (n1 + n0)
        g = 2 * (a * np.log(a / (n1 * total)) + (b * np.log(b / (n0 * total)) if b else 0.0))
        if g > 0 and np.sqrt(g) >= least_z:
            found.add(f)
    return found


# the field --------------------------------------------------------------------------


def _scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = a + b
    return a / total, b / total


def marginals(u: np.ndarray, starts: np.ndarray, trans: np.ndarray, init: np.ndarray) -> np.ndarray:
    """P(toxic) of each token; u: log odds of emission, starts: True at a document's first token.

    Exact for sequences of any length: blocks of _L tokens are multiplied up side by
    side, the block products are chained, and each block is then passed through again.
    """
    n = len(u)
    if not n:
        return np.zeros(0)
    pad = -n % _L
    e = np.exp(np.clip(np.concatenate([u, np.zeros(pad)]), -30, 30)).reshape(-1, _L)
    new = np.concatenate([starts, np.ones(pad, dtype=bool)]).reshape(-1, _L)
    t, i0 = np.exp(trans), np.exp(init)
    # step matrix m[a][b] = t[a, b] (or the start weights) times the emission of b
    m = [[np.where(new, i0[b], t[a, b]) * (e if b else 1.0) for b in (0, 1)] for a in (0, 1)]

    def chained(order: range, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Message that enters each block, from the side that `order` begins with."""
        p = [[np.ones(len(e)), np.zeros(len(e))], [np.zeros(len(e)), np.ones(len(e))]]
        for k in order:
            x = [[m[a][b][:, k] for b in (0, 1)] for a in (0, 1)]
            if left:
                p = [[p[a][0] * x[0][b] + p[a][1] * x[1][b] for b in (0, 1)] for a in (0, 1)]
            else:
                p = [[x[a][0] * p[0][b] + x[a][1] * p[1][b] for b in (0, 1)] for a in (0, 1)]
            scale = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[v / scale for v in row] for row in p]
        flat = np.stack([p[0][0], p[0][1], p[1][0], p[1][1]], axis=1).tolist()
        v0, v1 = 0.5, 0.5
        into = []
        for p00, p01, p10, p11 in flat if left else reversed(flat):
            into.append((v0, v1))
            v0, v1 = (v0 * p00 + v1 * p10, v0 * p01 + v1 * p11) if left else (p00 * v0 + p01 * v1, p10 * v0 + p11 * v1)
            s = v0 + v1
            v0, v1 = v0 / s, v1 / s
        into = np.array(into if left else into[::-1])
        return into[:, 0], into[:, 1]

    a0, a1 = chained(range(_L), True)
    alpha = np.empty_like(e)
    for k in range(_L):
        a0, a1 = _scaled(a0 * m[0][0][:, k] + a1 * m[1][0][:, k], a0 * m[0][1][:, k] + a1 * m[1][1][:, k])
        alpha[:, k] = a1
    b0, b1 = chained(range(_L - 1, -1, -1), False)
    out = np.empty_like(e)
    for k in range(_L - 1, -1, -1):
        toxic, clean = alpha[:, k] * b1, (1 - alpha[:, k]) * b0
        out[:, k] = toxic / (toxic + clean)
        b0, b1 = _scaled(m[0][0][:, k] * b0 + m[0][1][:, k] * b1, m[1][0][:, k] * b0 + m[1][1][:, k] * b1)
    return out.reshape(-1)[:n]


def fit_field(spans: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.3, decay: float = 1e-5):
    """(weights, bias, trans, init) of the field; spans: feature ids per token (tokens x 5)."""
    n, width, size = len(spans), max(map(len, spans)), 1 << FEATURE_BITS
    feats = np.zeros((n, width, spans[0].shape[1]), dtype=np.int64)
    y, real = np.zeros((n, width)), np.zeros((n, width), dtype=bool)
    for k, (f, t) in enumerate(zip(spans, labels, strict=True)):
        feats[k, : len(f)], y[k, : len(f)], real[k, : len(f)] = f, t, True
    used, inverse = np.unique(feats[real], return_inverse=True)
    inverse = inverse.reshape(-1, feats.shape[2])
    w, bias, trans, init = np.zeros(len(used)), -2.0, np.zeros((2, 2)), np.zeros(2)
    pairs = real[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    first = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], dtype=float)
    mean, power = {}, {}
    total = real.sum()

    def climb(name: str, value, grad, step: int):
        mean[name] = 0.9 * mean.get(name, 0) + 0.1 * grad
        power[name] = 0.99 * power.get(name, 0) + 0.01 * grad**2
        return value + rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(power[name] / (1 - 0.99**step)) + 1e-8)

    for step in range(1, rounds + 1):
        u = np.zeros((n, width))
        u[real] = w[inverse].sum(axis=1) + bias
        e, t, i0 = np.exp(np.clip(u, -30, 30)), np.exp(trans), np.exp(init)
        alpha, beta = np.empty((2, n, width)), np.ones((2, n, width))
        a0, a1 = _scaled(np.full(n, i0[0]), i0[1] * e[:, 0])
        alpha[:, :, 0] = a0, a1
        for k in range(1, width):
            a0, a1 = _scaled(a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[:, k])
            alpha[:, :, k] = a0, a1
        b0 = b1 = np.ones(n)
        for k in range(width - 2, -1, -1):
            go = real[:, k + 1]
            c0, c1 = _scaled(t[0, 0] * b0 + t[0, 1] * e[:, k + 1] * b1, t[1, 0] * b0 + t[1, 1] * e[:, k + 1] * b1)
            b0, b1 = np.where(go, c0, 0.5), np.where(go, c1, 0.5)
            beta[:, :, k] = b0, b1
        gamma = alpha * beta
        gamma = gamma[1] / gamma.sum(axis=0)
        joint = [[alpha[a, :, :-1] * t[a, b] * (e[:, 1:] if b else 1.0) * beta[b, :, 1:] for b in (0, 1)] for a in (0, 1)]
        scale = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        expected = np.array([[(joint[a][b] / scale)[pairs].sum() for b in (0, 1)] for a in (0, 1)])
        error = (y - gamma)[real]
        grad = np.bincount(inverse.ravel(), weights=np.repeat(error, inverse.shape[1]), minlength=len(used)) / total - decay * w
        w = climb("w", w, grad, step)
        bias = climb("bias", bias, error.sum() / total, step)
        trans = climb("trans", trans, (seen - expected) / total - decay * trans, step)
        init = climb("init", init, (first - np.array([n - gamma[:, 0].sum(), gamma[:, 0].sum()])) / total, step)
    full = np.zeros(size)
    full[used] = w
    return full, float(bias), trans, init


# documents --------------------------------------------------------------------------


def _summary(m: np.ndarray) -> list[float]:
    """What the document score is made of: log odds that any token is toxic, and the expected number."""
    if not len(m):
        return [-12.0, 0.0]
    none = float(np.log1p(-np.minimum(m, 1 - 1e-9)).sum())
    some = -np.expm1(none)
    return [float(np.clip(np.log(max(some, 1e-12)) - none, -12, 12)), float(np.log1p(m[m > 0.05].sum()))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return c


class ToxicityModel:
    """The fitted field and its calibration; small enough to travel with each task."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, init: np.ndarray, calibration: np.ndarray):
        self.used = {int(k): float(weights[k]) for k in np.flatnonzero(np.abs(weights) > 1e-4)}
        self.bias, self.trans, self.init, self.calibration = bias, trans, init, calibration
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float:
        if len(self.cache) > 400_000:
            self.cache.clear()
        value = self.bias + sum(self.used.get(f, 0.0) for f in token_features(word))
        self.cache[word] = value
        return value

    def emissions(self, text: str) -> np.ndarray:
        """One value per token, read in slices so that a very long text stays small."""
        parts, get, at = [], self.cache.get, 0
        while at < len(text):
            to = min(len(text), at + 1_000_000)
            while to < len(text) and (text[to].isalnum() and text[to - 1].isalnum()):
                to += 1
            words = _TOKEN.findall(text[at:to])
            parts.append(np.array([v if (v := get(w)) is not None else self.emission(w) for w in words], dtype=np.float64))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0)

    def token_marginals(self, texts: list[str]) -> list[np.ndarray]:
        us = [self.emissions(t) for t in texts]
        sizes = np.array([len(u) for u in us])
        starts = np.zeros(int(sizes.sum()), dtype=bool)
        ends = np.cumsum(sizes)
        starts[(ends - sizes)[sizes > 0]] = True
        m = marginals(np.concatenate(us) if us else np.zeros(0), starts, self.trans, self.init)
        return np.split(m, ends[:-1])

    def scores(self, marginal: list[np.ndarray]) -> np.ndarray:
        x = np.array([_summary(m) for m in marginal]).reshape(-1, 2)
        z = x @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def spans(text: str, m: np.ndarray) -> list[tuple[int, int]]:
        """Character offsets of runs of tokens whose marginal is high."""
        hot = m >= SPAN_MARGINAL
        if not hot.any():
            return []
        out, before = [], False
        for is_hot, found in zip(hot, _TOKEN.finditer(text), strict=True):
            if is_hot:
                if before:
                    out[-1] = (out[-1][0], found.end())
                else:
                    out.append(found.span())
            before = is_hot
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Learn from labelled documents that are not held out; duplicate labels count as toxic if any is.

    Without a labelled document of either kind the model has no weights and scores all alike.
    """
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    sample = keyed_sample(known, "doc_id", "toxic", fit_docs)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, FIT_CHARS)).join(F.broadcast(sample), "doc_id")
    got = rows.orderBy("doc_id", "text").toPandas().drop_duplicates("doc_id")
    toxic = got["toxic"].to_numpy().astype(int)
    none = np.zeros(1 << FEATURE_BITS)
    if len(set(toxic.tolist())) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        flat = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return ToxicityModel(none, -6.0, np.zeros((2, 2)), np.zeros(2), flat)
    known: dict[str, str] = {}  # a word of many documents is held once
    words = [[known.setdefault(w, w) for w in _TOKEN.findall(t)] for t in got["text"]]
    marks = label_features(words, toxic)
    spans, labels_ = [], []
    for k, (ws, y) in enumerate(zip(words, toxic, strict=True)):
        if not ws:
            continue
        tags = np.array([bool(y) and not marks.isdisjoint(token_features(w)) for w in ws], dtype=float)
        at = int(np.flatnonzero(tags)[0]) - SPAN // 2 if tags.any() else (zlib.crc32(str(k).encode()) % max(1, len(ws) - SPAN))
        at = max(0, min(at, len(ws) - SPAN))
        if y and not tags.any():
            continue  # a toxic document without a token to point at teaches nothing about tokens
        spans.append(np.array([token_features(w) for w in ws[at : at + SPAN]]))
        labels_.append(tags[at : at + SPAN])
    if not any(t.any() for t in labels_):  # no fitted text has a token that tells: all score alike
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return ToxicityModel(none, -6.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, np.log(share / (1 - share))]))
    field = fit_field(spans, labels_)
    model = ToxicityModel(*field, np.zeros(3))
    x = []
    for _, part in bounded_chunks(got["text"].tolist()):
        x += [_summary(m) for m in model.token_marginals(part)]
    taken = Counter(toxic.tolist())
    weight = np.array([counts[t] / taken[t] for t in toxic.tolist()])
    model.calibration = _logistic(np.array(x), toxic.astype(float), weight / weight.mean())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_tokens, spans) for every row; spans: array of (start, stop) character offsets.

    Whole texts are scored. Null and empty texts have no token and get the score of a text
    without evidence. Repeated rows score alike. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** FEATURE_BITS weights

    def prepare():
        fitted = shared.value

        def score(rows):
            for _, part in bounded_chunks([t or "" for t in rows["t"]]):
                m = fitted.token_marginals(part)
                spans = ([{"start": a, "stop": b} for a, b in fitted.spans(t, x)] for t, x in zip(part, m, strict=True))
                yield [(float(p), len(x), found) for p, x, found in zip(fitted.scores(m), m, spans, strict=True)]

        return score

    return map_rows(docs, key, {"t": F.col(text)}, "score double, n_tokens long, spans array<struct<start:long,stop:long>>", prepare)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns.

    Null and empty texts and texts without a token score as texts without evidence. Rows
    of equal text stay or go together; keys play no part. Empty table: empty result.
    """
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = [shared.value.scores(shared.value.token_marginals(part)) for _, part in bounded_chunks(texts.fillna("").tolist())]
        return pd.Series(np.concatenate(own) if own else np.zeros(0))

    return docs.filter(score(F.col(text)) < threshold)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted, n_spans."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"),
    )
