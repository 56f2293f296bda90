"""Exact dedup, near dedup and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from memloom.llm import exact_dedup, graph, near_dedup, simhash, suffixes
from memloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, keep_id string"


def frame(spark, rows):
    """Documents with a column whose name clashes with one of the operators' own."""
    return spark.createDataFrame([(k, t, "en", "x") for k, t in rows], SCHEMA).repartition(3)


ROWS = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "a b c "), (2, "a b c"), (None, "a b c"), (7, "x" * 5000), (8, "x" * 5000), (9, "x" * 4999 + "y")]


def test_exact_groups(spark):
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in
                 exact_dedup.exact_dedup(frame(spark, ROWS), Scratch(spark, "t"), digest_all=True).collect())
    norm = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for k, t in ROWS]
    want, seen = [], set()
    for k, t in sorted(norm, key=lambda x: (x[0] is None, x[0] or 0)):
        same = [i for i, u in norm if u == t]
        keep = min((i for i in same if i is not None), default=None)
        want.append((k is None, k, keep, len(same), k == keep and t not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add(t) if k == keep else None
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_keep_first(spark):
    left = sorted(r.doc_id for r in exact_dedup.keep_first(frame(spark, ROWS), Scratch(spark, "t")).collect())
    assert left == [1, 3, 5, 7, 9]
    assert exact_dedup.keep_first(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_exact_keep_first_of_shared_and_null_keys(spark):
    rows = [(1, "a b"), (2, "a  b"), (2, "other"), (2, "third"), (2, "third"), (None, "a b"), (None, "own"), (None, "none"), (None, "none"), (3, "x")]
    left = exact_dedup.keep_first(frame(spark, rows), Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("1", "a b"), ("2", "other"), ("2", "third"), ("None", "own"), ("None", "none"), ("3", "x")])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 2000 + k) for k in range(50)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxh64_intdigest(x, 42) for x in ([b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for t in [None, "", " \n", "One", "One two", "É a B c", "a b c d " * 40, "w " * 100_000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("blocks", [2, 8, 14, 20, 32, 64])
def test_every_pair_meets_at_a_home(blocks):
    rng = np.random.default_rng(blocks)
    x = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 3), replace=False)) for _ in x], dtype=np.uint64)
    y = x ^ flips
    homes = simhash.visits(x, blocks)[0][: len(x)]
    anchors, who, _ = simhash.visits(y, blocks)
    reach = [set() for _ in y]
    for a, k in zip(anchors.tolist(), who.tolist(), strict=True):
        assert a not in reach[k]
        reach[k].add(a)
    assert all(h in r for h, r in zip(homes.tolist(), reach, strict=True))


def test_links_with_crowded_anchors(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, size=6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=(60, 3), dtype=np.uint64), axis=1) for c in centre]))
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = simhash.fingerprint_links(rows, Scratch(spark, "t"), hot=40)
    got = {r.node: r.root for r in graph.connected_components(found, Scratch(spark, "t")).collect()}
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([label[np.bitwise_count(fps ^ f) <= 2].min() for f in fps])
        if (new == label).all():
            break
        label = new
    groups: dict = {}
    for f, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(k, set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(v) for v in _by_root(fps.view(np.int64).tolist(), got).values()}


def _by_root(nodes, root):
    out: dict = {}
    for n in nodes:
        out.setdefault(root.get(n, n), set()).add(n)
    return out


def test_simhash_edges(spark):
    rows = [(3, None), (1, ""), (2, " "), (None, ""), (4, "Hello there world"), (5, "hello THERE world"), (5, "hello there world"), (6, "other words here")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.simhash_components(frame(spark, rows), Scratch(spark, "t")).collect())
    assert got == sorted([("3", 1), ("1", 1), ("2", 1), ("None", 1), ("4", 4), ("5", 4), ("5", 4), ("6", 6)])
    assert simhash.simhash_components(frame(spark, []), Scratch(spark, "t")).count() == 0


def brute_near(rows):
    """Rows that stay, by all pairs of five-word shingle sets."""
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    s, label = [sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted((str(k), t) for n, (k, t) in enumerate(rows) if label[n] == n)


def test_near_copies_from_0_8(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        rows.append((len(rows) + 1, " ".join(base)))
        for _ in range(3):
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 45)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((rng.choice([None, 2, len(rows) + 1]), " ".join(base).replace("w", rng.choice("wW"))))
    rows += [(500, "one two"), (501, "ONE two"), (None, ""), (502, None), (None, "alone with no key"), (None, "alone too without a key")]
    rows = list({t: (k, t) for k, t in rows}.values())
    want = brute_near(rows)
    for chunk in (near_dedup.CHUNK, 300):  # the second way deals out all but the smallest clusters
        left = near_dedup.keep_one(frame(spark, rows), Scratch(spark, "t"), chunk=chunk)
        assert left.columns == ["doc_id", "text", "lang", "keep_id"]
        got = [(str(r.doc_id), r.text) for r in left.collect()]
        assert len(got) == len(want) and sorted(k for k, _ in got) == sorted(k for k, _ in want)
    assert near_dedup.keep_one(frame(spark, []), Scratch(spark, "t")).count() == 0


def near_links(texts, p, batch=100):
    """What the anchors of all slices link, in this process: the least index of each component."""
    frames = (pd.DataFrame({"id": np.arange(k, min(k + batch, len(texts))), "t": texts[k : k + batch]}) for k in range(0, len(texts), batch))
    rows = pd.concat(near_dedup._dealt_rows(near_dedup.WIDTH, p)(frames))
    links = pd.concat([near_dedup._met(p)(group) for _, group in rows.groupby("deal")])
    return near_dedup._joined(np.arange(len(texts)), links["a"].to_numpy(), links["b"].to_numpy())


@pytest.mark.parametrize("size,changed", [(9, None), (13, [12]), (184, [20, 60, 100, 140])])
def test_near_copies_meet_at_anchors(size, changed):
    """Pairs of a similarity of just 0.8, each apart from all others: SimHash and its anchors propose every one, and little else."""
    rng = random.Random(size)
    texts = []
    for _ in range(200):
        x = [f"w{rng.randrange(100_000)}" for _ in range(size)]
        y = x[:-1] if changed is None else [f"v{rng.randrange(100_000)}" if k in changed else w for k, w in enumerate(x)]
        texts += [" ".join(x), " ".join(y)]
    for n in (len(texts), 400_000):  # the plan of a larger table deals out more finely
        root = near_links(texts, near_dedup.plan(n)).reshape(-1, 2)
        assert (root[:, 0] == root[:, 1]).all() and len(np.unique(root)) > 195


def test_near_copies_at_crowded_anchors(monkeypatch):
    """Passing over what is linked already loses no link."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(900):
        x = list(bases[k % 3] if k % 10 else [rng.choice(words) for _ in range(60)])
        x[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(x))
    p, found = near_dedup.plan(len(texts)), []
    for crowd, pairs in ((1 << 40, 1 << 20), (8, 100)):
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        monkeypatch.setattr(near_dedup, "_PAIRS", pairs)
        found.append(near_links(texts, p))
    assert (found[0] == found[1]).all() and len(np.unique(found[0])) == 93


def test_near_copies_of_a_large_cluster(spark):
    """One template, copies of copies of it, and families within the cluster that are not near."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(160):
        if k % 40 == 0:  # shares half of the template: a candidate, but no copy
            own = base[:70] + [rng.choice(words) for _ in range(50)]
        text = list(own) if k % 3 else list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - k, " ".join(text)))
    rows = list({t: (k, t) for k, t in rows}.values())
    want = brute_near(rows)
    for chunk in (near_dedup.CHUNK, 2000, 500):
        left = near_dedup.keep_one(frame(spark, rows), Scratch(spark, "t"), chunk=chunk).collect()
        assert sorted((str(r.doc_id), r.text) for r in left) == want, chunk


def test_near_copies_of_one_family_are_linked_few_times(spark, monkeypatch):
    """The links of a family are a few for each text, not some for each text and slice; twice the texts, about twice the links."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    base, given, per_text = [rng.choice(words) for _ in range(100)], [], []
    components = near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", lambda links, scratch: given.append(links.count()) or components(links, scratch))
    for n in (200, 400):
        rows = []
        for k in range(n):
            text = list(base)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((2 * n - k, " ".join(text)))
        rows += [(k, " ".join(rng.choice(words) for _ in range(100))) for k in range(20)]
        given.clear()
        left = near_dedup.keep_one(frame(spark, rows), Scratch(spark, "t")).collect()
        assert sorted((str(r.doc_id), r.text) for r in left) == brute_near(rows)
        per_text.append(sum(given) / n)
    assert max(per_text) < 6 and per_text[1] < 1.5 * per_text[0]


def brute_repeats(docs):
    first: dict = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def repeats_here(docs, loads):
    """Both rounds in this process, where constants can be changed: tasks, blocks and batches are as small as can be."""
    names = ["kind", "id", "rk", "lo", "size", "hot", "rank"]
    rows = [(k, xxh64_intdigest(str(n), 9) >> 1, (t or "")) for n, (k, t) in enumerate(docs)]
    frame = lambda batches: pa.Table.from_batches(list(batches)).to_pandas()
    batches = lambda df, n: pa.Table.from_pandas(df, preserve_index=False).to_batches(max_chunksize=n)
    loads_of = [rows[k::loads] for k in range(loads)]
    table_of = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part])], ["id", "rk", "t"])
    samples = pd.concat([frame(out) for part in loads_of if part and (out := list(suffixes._sample_rows(iter([table_of(part)]))))])
    kind = samples["spot"] // (1 << 56)
    deal = np.where(kind == suffixes.SPREAD, (samples["rank"] * 31 + samples["context"]) % 3, np.where(kind == suffixes.RANGE, samples["rk"] % 3, samples["rank"] % 3))
    first = [frame(suffixes._first_round(iter(batches(p.sort_values(["rank", "context", "id"]), 7)))) for _, p in samples.groupby(deal)]
    first = pd.concat([f for f in first if len(f)])[names]
    need, second = first[first["kind"] == 2], []
    for k in range(3):
        block = pd.DataFrame([r for r in rows if r[1] % 3 == k], columns=["id", "rk", "t"])
        second.append(suffixes._context_rows(block, need[need["rk"] % 3 == k]))
    second = pd.concat(second).astype({"kind": "int32", "rank": "int64", "id": "int64", "rk": "int64", "lo": "int64", "lead": "int32"})
    done = [frame(suffixes._second_round(iter(batches(p.sort_values(["rank", "id"]), 7)))) for _, p in second.groupby(second["rank"] % 3) if len(p)]
    gone = pd.concat([first[first["kind"] == 1], *[f for f in done if len(f)]])
    out = []
    for k, rk, t in rows:
        own = gone[gone["rk"] == rk]
        left, removed, spans = suffixes.kept_bytes(t.encode(), own["lo"].to_numpy(), own["size"].to_numpy())
        out.append((k, len(t.encode()), removed, len(spans), hashlib.sha256(left).hexdigest()))
    return sorted(out), samples, first


@pytest.mark.parametrize("piece,hot,loads", [(2_000_000, 64, 1), (120, 64, 4), (2_000_000, 2, 1), (120, 2, 5), (300, 1, 3)])
def test_repeats_in_small_parts(piece, hot, loads, monkeypatch):
    monkeypatch.setattr(suffixes._pieces, "__defaults__", (piece,))
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "_AT_ONCE", 5)
    rng = random.Random(piece + hot)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, edges, base = word(260), [word(40) for _ in range(4)], [word(rng.randint(0, 300)) for _ in range(5)]
    docs = []
    for k in range(70):
        if k % 2:
            cut = rng.choice([0, 0, 30, 120])
            t = (rng.choice(edges) if k % 3 else word(60)) + passage[cut : len(passage) - rng.choice([0, 25, 100])] + (rng.choice(edges) if k % 4 else word(60))
            t += t[20:200] if k % 7 == 0 else ""
        else:
            t = "".join((x := rng.choice(base))[(a := rng.randint(0, len(x))) : rng.randint(a, len(x))] + rng.choice("xyz") * rng.choice([0, 0, 70]) for _ in range(rng.randint(0, 5)))
        docs.append((k * 3, t))
    docs.append((docs[7][0], docs[7][1]))  # a repeated row
    rng.shuffle(docs)
    got, samples, first = repeats_here(docs, loads)
    assert got == brute_repeats(docs)
    if hot < 64:
        assert {suffixes.SPREAD, suffixes.OPEN} <= set((samples["spot"] // (1 << 56)).tolist()) and first["hot"].any()


def test_repeats(spark):
    rng = random.Random(120)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 400))) for _ in range(6)]
    docs = []
    for k in range(50):
        t = ""
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            t += x[a : rng.randint(a, len(x))] + rng.choice("xyz") * rng.choice([0, 0, 70])
        docs.append((k * 3, t if rng.random() < 0.95 else None))
    docs.append(docs[7])
    got = suffixes.remove_repeats(frame(spark, docs), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_repeats(docs)


def test_repeats_twice_in_one_document(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = word(600), word(600)
    docs = [(1, p + word(90)), (3, word(70) + q[:300]), (5, word(80) + p + word(90) + p + word(60)), (6, q + word(9) + q), (6, word(80) + q), (9, q + p + q)]
    rows = spark.createDataFrame([(k, t, "en", "x") for k, t in docs], SCHEMA).repartition(len(docs), "text")
    got = suffixes.remove_repeats(rows, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_repeats(docs)
    one = spark.createDataFrame([(k, t, "en", "x") for k, t in docs], SCHEMA).coalesce(1)
    assert sorted(map(str, suffixes.remove_repeats(one, Scratch(spark, "t")).collect())) == sorted(map(str, got))


def test_repeats_of_a_passage_that_all_share(spark):
    """One passage in nearly all documents, each with edges of its own or of a few others."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edges = word(300), [word(40) for _ in range(6)]
    docs = []
    for k in range(200):
        cut = rng.choice([0, 0, 0, 30, 120])
        middle = passage[cut : len(passage) - rng.choice([0, 0, 25, 100])]
        docs.append((2 * k + 1, (rng.choice(edges) if k % 3 else word(60)) + middle + (rng.choice(edges) if k % 4 else word(60)) + (middle if k % 7 == 0 else "")))
    for parts in (1, 8):
        rows = spark.createDataFrame([(k, t, "en", "x") for k, t in docs], SCHEMA).repartition(parts)
        got = suffixes.remove_repeats(rows, Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_repeats(docs)


def test_repeats_of_nothing(spark):
    assert suffixes.remove_repeats(frame(spark, []), Scratch(spark, "t")).count() == 0
