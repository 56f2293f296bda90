"""Queries of the learned operators, and the pipeline, against plain versions: one document, one token, one gram at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
from test_dedup import brute_fingerprint, brute_near
from test_models import corpus
from test_text import plain_agenda
from xxhash import xxh64_intdigest

import corpus_pipeline
from memloom.llm import cotraining, language, mixing, pieces, simhash, toxicity


def written(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs.collect()


def grams(text, bits=12):
    """Square roots of hashed byte n-gram counts, scaled to length 1, as a dict."""
    data, found = (text or "").lower().encode(), Counter()
    for n in (1, 2, 3):
        for k in range(len(data) - n + 1):
            found[((int.from_bytes(data[k : k + n], "big") + (n << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)] += 1
    size = math.sqrt(sum(found.values()))
    return {k: math.sqrt(v) / size for k, v in found.items()} if found else {}


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_language_query(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    sf, rows = written(spark, tmp_path, docs, labels)
    model = language.fit_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    want = []
    for r in rows:
        best, p = "und", 0.0
        if any(c.isalpha() for c in r.text or ""):
            g, losses = grams(r.text), []
            z = [sum(v * model.weights[k, j] for k, v in g.items()) + model.constants[j] for j in range(model.code.shape[1])]
            for code in model.code:
                losses.append(sum(w * math.log1p(math.exp(-(2 * b - 1) * x)) for b, x, w in zip(code, z, model.bit_weights, strict=True)))
            odds = [math.exp(min(losses) - x) for x in losses]
            p = max(odds) / sum(odds)
            best = model.languages[odds.index(max(odds))]
        want.append((str(r.doc_id), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2, best, round(p, 6)))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 6)) for r in language.op7_language(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_quality_query(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    sf, rows = written(spark, tmp_path, docs, labels)
    model = cotraining.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    want = []
    for r in rows:
        n = "none" if r.n_chars is None else int(2 * math.log2(r.n_chars + 1))
        meta = {zlib.crc32(x.encode()) & 255: 0.577 for x in (f"source={r.source}", f"lang={r.lang}", f"size={n}")}
        views = []
        for x, (w, c), (a, b) in zip((grams(r.text), meta), model.views, model.scales, strict=True):
            views.append(sigmoid((sum(v * w[k, 0] for k, v in x.items()) + c[0]) * a + b))
        odds = [math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6))) for v in views]
        w, c = model.mix
        want.append((str(r.doc_id), sigmoid(sum(x * v for x, v in zip(odds, w[:, 0], strict=True)) + c[0])))
    got = sorted((str(r.doc_id), r.score) for r in cotraining.op9_quality(spark, sf).collect())
    assert [k for k, _ in got] == sorted(k for k, _ in want)
    assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(got, sorted(want), strict=True))


def plain_toxicity(model, text):
    """(score, spans) by a forward and a backward pass over the tokens."""
    found = list(re.finditer(r"[^\W_]+", text or ""))
    e = [math.exp(max(-30, min(30, model.bias + sum(model.used.get(f, 0.0) for f in toxicity.token_features(m[0]))))) for m in found]
    t = [[math.exp(x) for x in row] for row in model.trans]
    alpha, beta = [], [(1.0, 1.0)] * len(e)
    for k, x in enumerate(e):
        a, b = (math.exp(model.init[0]), math.exp(model.init[1])) if not k else (alpha[-1][0] * t[0][0] + alpha[-1][1] * t[1][0], alpha[-1][0] * t[0][1] + alpha[-1][1] * t[1][1])
        alpha.append((a / (a + b * x), b * x / (a + b * x)))
    for k in range(len(e) - 2, -1, -1):
        b0, b1 = beta[k + 1]
        a, b = t[0][0] * b0 + t[0][1] * e[k + 1] * b1, t[1][0] * b0 + t[1][1] * e[k + 1] * b1
        beta[k] = (a / (a + b), b / (a + b))
    m = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, beta, strict=True)]
    none = sum(math.log1p(-min(x, 1 - 1e-9)) for x in m)
    some = max(-math.expm1(none), 1e-12)
    features = (max(-12, min(12, math.log(some) - none)), math.log1p(sum(x for x in m if x > 0.05))) if m else (-12.0, 0.0)
    spans = []
    for k, (x, where) in enumerate(zip(m, found, strict=True)):
        if x >= toxicity.SPAN_MARGINAL:
            if k and m[k - 1] >= toxicity.SPAN_MARGINAL:
                spans[-1] = (spans[-1][0], where.end())
            else:
                spans.append(where.span())
    c = model.calibration
    return sigmoid(features[0] * c[0] + features[1] * c[1] + c[2]), spans


def test_toxicity_query(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    sf, rows = written(spark, tmp_path, docs, labels)
    model = toxicity.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    want = sorted((str(r.doc_id), *plain_toxicity(model, r.text)) for r in rows)
    got = sorted(toxicity.op3_toxicity(spark, sf).collect(), key=lambda r: (str(r.doc_id), r.score))
    assert [str(r.doc_id) for r in got] == [k for k, _, _ in want]
    for r, (_, score, spans) in zip(got, sorted(want, key=lambda x: (x[0], x[1])), strict=True):
        assert abs(r.score - score) < 1e-6 and r.n_spans == len(spans) and r.predicted == (score >= 0.3)
    spans = {(str(r.doc_id), r.n_tokens): [(s.start, s.stop) for s in r.spans] for r in toxicity.score_toxicity(docs, model).collect()}
    assert any(spans.values()) and all(spans[str(r.doc_id), len(re.findall(r"[^\W_]+", r.text or ""))] == plain_toxicity(model, r.text)[1] for r in rows)


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(spark, 120)
    extra = [(1000 + k, r.text.replace(" ", "  ", 2), r.lang, r.source, 1) for k, r in enumerate(docs.filter("doc_id % 10 = 1 AND doc_id < 120").collect())]
    for k, r in enumerate(docs.filter("doc_id % 10 = 2 AND doc_id < 120").collect()):
        words = r.text.split(" ") * 4
        extra += [(2000 + 2 * k, " ".join(words), r.lang, r.source, 1), (2001 + 2 * k, " ".join([*words, "once", "more"]), r.lang, r.source, 1)]
    docs = docs.filter("doc_id IS NOT NULL AND NOT (doc_id = 0 AND n_chars = 1)").unionByName(spark.createDataFrame(extra, docs.schema)).coalesce(2)
    sf, rows = written(spark, tmp_path, docs, labels)
    model = toxicity.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)

    left = [r for r in rows if plain_toxicity(model, r.text)[0] < toxicity.THRESHOLD]
    assert len(left) < len(rows)
    first = {}
    for r in sorted(left, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert len(first) < len(left)
    near = {int(k) for k, _ in brute_near([(r.doc_id, r.text) for r in first.values()])}
    assert len(near) < len(first)
    kept = [r for r in first.values() if r.doc_id in near]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in kept])
    times = con.sql(mixing.OP2_SQL.replace("CAST(d.size * (", "CAST(1 * (")).fetchall()
    times = {t[0]: t[-1] for t in times}
    vocabulary, want = pieces.Pieces.load(), []
    for r in kept:
        for turn in range(times[r.doc_id]):
            key = xxh64_intdigest(str(r.doc_id).encode(), 42) + turn * 0xD6E8FEB86659FD93
            ids = None if r.text is None else vocabulary.encode(r.text, key=key)
            want.append((r.doc_id, str(ids), len(ids or [])))
    got = [(r.doc_id, str(r.ids), r.n_ids) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len({k for k, _, _ in got}) < len(got)
    assert len(set(got)) > len({k for k, _, _ in got if k})  # a repeated row draws apart
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_simhash_query(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    rows = [(None, None), (900, ""), (901, " \n"), (2, "One"), (3, "one"), (4, "One two"), (4, "one  TWO")]
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 4)):
            rows.append((rng.choice([len(rows) + 5, None]) if rng.random() < 0.1 else len(rows) + 5, " ".join(text)))
            if rng.random() < 0.7:
                text = [*text[: rng.randint(0, len(text))], rng.choice(words), *text[rng.randint(0, len(text)) :]] if rng.random() < 0.2 else [*text, rng.choice(words)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if y == old else y for y in label]
    least = {n: min((k for (k, _), m in zip(rows, label, strict=True) if m == n and k is not None), default=None) for n in label}
    want = sorted((str(k), f"{f:016x}", str(least[n])) for (k, _), f, n in zip(rows, fps, label, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op4_simhash(spark, str(tmp_path)).collect())
    assert got == want and len({c for _, _, c in want}) < len(want)


def test_pieces_query(spark, tmp_path):
    rows = [(1, "An international organisation\n\nof  standards"), (2, ""), (3, None), (None, "▁ naïve 日本 x"), (5, "x" * 70 + " the end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    model, want = pieces.Pieces.load().prepare(), []
    for k, t in rows:
        ids = None if t is None else plain_agenda(model, t, xxh64_intdigest(str(k or 0).encode(), 42), pieces.DROPOUT)
        want.append((str(k), str(ids), len(ids or []), t and hashlib.sha256(t.encode()).hexdigest() or (None if t is None else hashlib.sha256(b"").hexdigest())))
    got = [(str(r.doc_id), str(r.ids), r.n_ids, r.decoded_sha256) for r in pieces.op5_pieces(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
