"""A quality classifier by co-training.

Two views of a document: its text (hashed byte n-grams) and its metadata (source, lang,
length class), which share no feature. Each view has its own logistic classifier. In
each round a view labels the documents of an unlabelled pool that it is sure of, at its
calibrated probability, and hands them to the other view. In the end both views are
calibrated on labelled documents set aside and combined by a logistic model of their
log odds, so a view that knows little gets little weight.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import held_out, keyed_sample, map_rows, table
from memloom.llm.grams import fit_logistic, gram_counts, normed, sigmoid

#: The fit reads at most this many labelled documents of each label and pool documents, none longer than FIT_CHARS.
FIT_DOCS, FIT_POOL, FIT_CHARS = 1000, 1500, 20_000
GRAM_BITS, META_BITS = 12, 8
ROUNDS, CONFIDENT, PER_ROUND = 4, 0.95, 100


def text_view(texts: list[str]) -> np.ndarray:
    return normed(np.array([gram_counts(t, GRAM_BITS) for t in texts]).reshape(len(texts), 1 << GRAM_BITS)).astype(np.float32)


def meta_view(source: list, lang: list, chars: list) -> np.ndarray:
    """One-hot source, lang and length class (half powers of two), hashed; nulls are values of their own."""
    out = np.zeros((len(source), 1 << META_BITS), dtype=np.float32)
    for k, (s, g, n) in enumerate(zip(source, lang, chars, strict=True)):
        size = "none" if n is None or n != n or n < 0 else int(2 * math.log2(n + 1))
        for name in (f"source={s}", f"lang={g}", f"size={size}"):
            out[k, zlib.crc32(name.encode()) & ((1 << META_BITS) - 1)] = 0.577
    return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class QualityModel:
    def __init__(self, views: list[tuple], scales: list[tuple], mix: tuple, exchanged: list[int]):
        self.views, self.scales, self.mix, self.exchanged = views, scales, mix, exchanged

    def view_scores(self, xs: list[np.ndarray]) -> np.ndarray:
        """Calibrated probability of quality 1, by view."""
        out = []
        for x, (w, c), (a, b) in zip(xs, self.views, self.scales, strict=True):
            out.append(sigmoid((x @ w + c)[:, 0] * a + b))
        return np.stack(out, axis=1)

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        w, c = self.mix
        return sigmoid((_log_odds(self.view_scores(xs)) @ w + c)[:, 0])


def _scale(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    w, c = fit_logistic(z.reshape(-1, 1), y, weight, ridge=1e-3, rounds=200, rate=0.1)
    return float(w[0, 0]), float(c[0])


def co_train(xs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pool: list[np.ndarray]) -> QualityModel:
    """Fit both views; y: 0/1 of the labelled rows, weight: how many rows each stands for."""
    aside = np.arange(len(y)) % 4 == 0
    extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    free = [np.ones(len(pool[0]), dtype=bool) for _ in xs]
    exchanged = [0, 0]
    for step in range(ROUNDS + 1):
        views, scales = [], []
        for v, x in enumerate(xs):
            rows = np.concatenate([x[~aside], *(e[0] for e in extra[v])])
            marks = np.concatenate([y[~aside], *(e[1] for e in extra[v])])
            heavy = np.concatenate([weight[~aside], *(np.full(len(e[1]), weight.mean()) for e in extra[v])])
            w, c = fit_logistic(rows, marks, heavy)
            views.append((w, c))
            scales.append(_scale((x[aside] @ w + c)[:, 0], y[aside], weight[aside]))
        if step == ROUNDS or not len(pool[0]):
            break
        for v in (0, 1):  # what this view is sure of goes to the other one
            p = sigmoid((pool[v] @ views[v][0] + views[v][1])[:, 0] * scales[v][0] + scales[v][1])
            sure = np.flatnonzero(free[1 - v] & (np.maximum(p, 1 - p) >= CONFIDENT))
            sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][:PER_ROUND]
            free[1 - v][sure] = False
            extra[1 - v].append((pool[1 - v][sure], (p[sure] > 0.5).astype(float)))
            exchanged[v] += len(sure)
    model = QualityModel(views, scales, None, exchanged)
    model.mix = fit_logistic(_log_odds(model.view_scores([x[aside] for x in xs])), y[aside], weight[aside], 1e-3, 300, 0.1)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_pool: int = FIT_POOL) -> QualityModel | float:
    """Learn from documents that are not held out. With labels of one kind only: that kind's share."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {int(r[0]): r[1] for r in known.groupBy("quality").count().collect()}
    columns = ["doc_id", "text", "source", "lang", "n_chars"]
    usable = docs.select(*columns).filter(F.length("text").between(1, FIT_CHARS))
    sample = keyed_sample(known, "doc_id", "quality", fit_docs)  # bounded, so it may be broadcast
    got = usable.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").toPandas().drop_duplicates("doc_id")
    y = got["quality"].to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    ids = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    pool_ids = keyed_sample(ids.withColumn("one", F.lit(1)), "doc_id", "one", fit_pool).select("doc_id")
    pool = usable.join(F.broadcast(pool_ids), "doc_id").orderBy("doc_id", "text").toPandas().drop_duplicates("doc_id")
    weight = np.array([counts[v] / (y == v).sum() for v in y.tolist()])
    both = [[text_view(d["text"].tolist()), meta_view(d["source"].tolist(), d["lang"].tolist(), d["n_chars"].tolist())] for d in (got, pool)]
    return co_train(both[0], y.astype(float), weight / weight.mean(), both[1])


def score_quality(docs: DataFrame, model: QualityModel | float, key: str = "doc_id") -> DataFrame:
    """(key, score, text_score, meta_score) for every row; score: probability of quality 1.

    Null and empty texts are scored by what both views make of no n-grams. Null metadata
    are values of their own. Repeated rows score alike. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** GRAM_BITS + 2 ** META_BITS weights

    def prepare():
        fitted = shared.value

        def scored(rows):
            for at in range(0, len(rows["t"]), 250):
                part = {n: v[at : at + 250] for n, v in rows.items()}
                if isinstance(fitted, float):
                    yield [(fitted,) * 3] * len(part["t"])
                    continue
                xs = [text_view([t or "" for t in part["t"]]), meta_view(part["source"], part["lang"], part["n"])]
                yield np.column_stack([fitted.scores(xs), fitted.view_scores(xs)]).tolist()

        return scored

    columns = {"t": F.col("text"), "source": F.col("source"), "lang": F.col("lang"), "n": F.col("n_chars")}
    return map_rows(docs, key, columns, "score double, text_score double, meta_score double", prepare)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted, text_score, meta_score."""
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "text_score", "meta_score",
    )
