"""Learned operators: exact inference, held-out accuracy, and odd inputs."""

import inspect
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import cotraining, language, toxicity
from memloom.llm.common import held_out


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    trans, init = rng.normal(size=(2, 2)), rng.normal(size=2)

    def brute(us):
        w, z = np.zeros(len(us)), 0.0
        for y in itertools.product((0, 1), repeat=len(us)):
            e = np.exp(init[y[0]] + sum(u * b for u, b in zip(us, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z, w = z + e, w + e * np.array(y)
        return w / z

    docs = [rng.normal(size=k) * 2 for k in (3, 1, 8, 5, 11, 2)]
    starts = np.concatenate([[True] + [False] * (len(d) - 1) for d in docs])
    assert np.allclose(toxicity.marginals(np.concatenate(docs), starts, trans, init), np.concatenate([brute(d) for d in docs]))
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, bool), trans, init)) == 0


def corpus(spark, n=500):
    rng = random.Random(5)
    alphabet = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(list(alphabet))
        words = ["".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.6)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron", "scum"]))
        if not good:
            words = [w + "%%%" for w in words]
        text = " ".join(words)
        rows.append((k, text, lang, rng.choice(["s1", "s2"]), len(text)))
        labels.append((k, good, toxic))
    rows += [(n, None, None, None, None), (n + 1, "", "aa", "s1", 0), (n + 2, "123 !!", "aa", "s1", 6), (0, rows[0][1], "aa", "s1", 1), (None, "idiot", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(df, labels, truth):
    return df.filter(held_out(F.col("doc_id"))).join(labels, "doc_id").select(truth, "*").collect()


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    found = toxicity.score_toxicity(docs, model)
    assert found.count() == docs.count()
    rows = held(found, labels, "toxic")
    assert np.mean([(r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows]) > 0.95
    one = found.join(docs.select("doc_id", "text"), "doc_id").filter("size(spans) > 0").first()
    assert any(w in one.text[one.spans[0].start : one.spans[0].stop].lower() for w in ("idiot", "moron", "scum"))
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.filter("text IS NULL").count() == 1
    alike = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0)))
    assert alike.select("score").distinct().count() == 1


def test_language(spark):
    docs, _ = corpus(spark)
    model = language.fit_languages(docs)
    found = language.identify(docs, model)
    rows = found.filter(held_out(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in found.filter("doc_id >= 500").collect()}
    assert odd == {500: ("und", 0.0), 501: ("und", 0.0), 502: ("und", 0.0)}
    assert language.identify(docs.limit(0), model).count() == 0


def test_codewords():
    for n in (2, 4, 6, 9, 30):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_quality(spark):
    docs, labels = corpus(spark)
    model = cotraining.fit_quality(docs, labels)
    found = cotraining.score_quality(docs, model)
    assert found.count() == docs.count()
    rows = held(found, labels, "quality")
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in rows]) > 0.95
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, size=300).astype(float)
    view = lambda k, y: np.column_stack([y[:, None] * 2 - 1 + rng.normal(size=(len(y), 1)) * 0.2, rng.normal(size=(len(y), k))]).astype(np.float32)
    pool_y = rng.integers(0, 2, size=400).astype(float)
    model = cotraining.co_train([view(3, y), view(2, y)], y, np.ones(300), [view(3, pool_y), view(2, pool_y)])
    assert min(model.exchanged) > 0
    fresh = rng.integers(0, 2, size=200).astype(float)
    assert np.mean((model.scores([view(3, fresh), view(2, fresh)]) >= 0.5) == fresh) > 0.95


def test_toxic_rows_go_at_the_operators_threshold(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert inspect.signature(toxicity.drop_toxic).parameters["threshold"].default == toxicity.THRESHOLD
    clean = toxicity.score_toxicity(docs, model).filter(F.col("score") < toxicity.THRESHOLD)
    assert sorted(str(r.doc_id) for r in toxicity.drop_toxic(docs, model).collect()) == sorted(str(r.doc_id) for r in clean.collect())
