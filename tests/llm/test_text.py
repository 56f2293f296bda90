"""Mixing, pieces, repetition, quotations and the pipeline against plain versions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from memloom.llm import mixing, pieces, quotes, repetition
from memloom.llm.common import Scratch


def sql(text, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(text)


def as_rows(df, names):
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("bits", [4, 12])
def test_mix(spark, tmp_path, bits):
    rng = random.Random(bits)
    docs = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 300])), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(300)] + [(5, "w w", "a"), (None, "w", "b"), (301, None, "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = df.select("doc_id", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))), F.lit(0)).alias("size"), "source")
    got = mixing.mix(rows, Scratch(spark, "t"), level_bits=bits)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    q = con.sql(mixing.OP2_SQL)
    want = sorted(str(tuple(dict(zip(q.columns, r, strict=True))[n] for n in names)) for r in q.fetchall())
    assert as_rows(got, names) == want


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 60):
        sizes = {f"s{k:03d}" if k else None: rng.choice([0, 1, 5, 40, 1000, 90_000]) for k in range(n)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, Scratch(spark, "t")).collect()}
        order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
        weight, total = {k: i % 3 + 1 for i, k in enumerate(order)}, sum(sizes.values())
        want, open_ = {}, set(order)
        while open_:  # the excess is reshared until none is above
            level = (total - sum(want.values())) / sum(weight[k] for k in open_)
            above = {k for k in open_ if weight[k] * level > 3 * sizes[k]}
            if not above:
                want |= {k: weight[k] * level for k in open_}
                break
            want |= {k: 3 * sizes[k] for k in above}
            open_ -= above
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want)
        assert abs(sum(got.values()) - total) <= 1e-6 * max(1, total)


def test_mix_draws_rows(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "ab"[k % 5 == 0], k) for k in range(200)], "doc_id long, text string, source string, target long")
    drawn = mixing.draw(docs, Scratch(spark, "t"))
    assert drawn.columns == docs.columns
    sized = mixing.mix(docs.select("doc_id", (F.col("doc_id") % 7 + 1).alias("size"), "source"), Scratch(spark, "t"))
    times = {r.doc_id: r.taken // r.size for r in sized.collect()}
    assert {r[0]: r[1] for r in drawn.groupBy("doc_id").count().collect()} == {k: n for k, n in times.items() if n}
    assert mixing.draw(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_pieces_equal_the_library_without_dropout():
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = pieces.Pieces.load().prepare()
    rng = random.Random(2)
    parts = [" ", "  ", "a", "the", "\n", "é", "日本", "\t", "ing", ".", "😀", "\0", "   ", "\r\n", "tion", "x" * 60]
    for k in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert own.encode(text, dropout=0) == sp.encode(text)
        for dropout in (0.1, 0.5, 1.0):
            for t in (text, text + pieces.MARK + text):
                assert own.decode(own.encode(t, key=k, dropout=dropout)) == t


def test_pieces_vary_and_repeat():
    own = pieces.Pieces.load().prepare()
    text = "international standards organisation " * 50
    plain, one, two = own.encode(text, dropout=0), own.encode(text, key=1), own.encode(text, key=2)
    assert one == pieces.Pieces.load().encode(text, key=1) and one != two and len(one) > len(plain)


def test_each_occurrence_has_skips_of_its_own():
    own = pieces.Pieces.load().prepare()
    one = " international"
    plain, n = tuple(own.encode(one.strip(), dropout=0)), 20_000
    ids = own.encode(" ".join([one.strip()] * n), key=5)
    forms, at = {}, 0
    while at < len(ids):  # a form ends where the text of its pieces does
        end = at + 1
        while own.decode([own.ids[pieces.MARK]] + ids[at:end]).strip() != one.strip():
            end += 1
        forms[tuple(ids[at:end])] = forms.get(tuple(ids[at:end]), 0) + 1
        at = end
    rng = random.Random(2)
    drawn = [own.segment(one, sum(1 << k for k in range(40) if rng.random() < 0.1)) for _ in range(n)]
    assert len(forms) > 20 and abs(forms[plain] - drawn.count(plain)) < 0.02 * n
    fresh = pieces.Pieces.load()
    assert fresh.encode(" ".join([one.strip()] * n), key=5) == ids
    long = "ab" * 300
    assert own.decode(own.encode(long, key=1)) == long and len({tuple(own.encode(long, key=k)) for k in range(20)}) > 10


def mix(h):
    """The keyed hash, in plain whole numbers."""
    m = (1 << 64) - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 33


def plain_agenda(model, text, key, dropout):
    """Merge-dropout the plain way: one list of symbols, one candidate at a time, one draw each."""
    m, golden, out = (1 << 64) - 1, 0x9E3779B97F4A7C15, []
    score = {p: s for p, s, is_byte in model.vocabulary if p and not is_byte}
    limit = int(dropout * (1 << 32))

    def draw(own, k):
        if k >= 24:  # beyond the first ones, blocks of 32 with keys of their own
            block = (k - 24) // 32
            own, k = own + block * 32 + 1, (k - 24) % 32
        h = mix(own + (k // 2 * 2 + 1) * golden & m)
        return (h >> 32 * (k % 2)) & 0xFFFFFFFF

    for place, segment in enumerate(re.findall(r" *[^ \n]+|\n| +", " " + text) if text else []):
        own = mix(place + key * golden + pieces.SEED * 0xC2B2AE3D27D4EB4F & m)
        symbols = [pieces.MARK if c == " " else None if c == pieces.MARK else c for c in segment]
        refused, came = set(), 0
        ids = list(range(len(symbols)))  # identities, so that a refused pair stays refused until one of it changes
        fresh = len(ids)
        while True:
            best = None
            for k in range(len(symbols) - 1):
                if symbols[k] is None or symbols[k + 1] is None or (ids[k], ids[k + 1]) in refused:
                    continue
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, k)
            if best is None:
                break
            k, came = best[1], came + 1
            if draw(own, came - 1) < limit:
                refused.add((ids[k], ids[k + 1]))
                continue
            symbols[k : k + 2], ids[k : k + 2] = [symbols[k] + symbols[k + 1]], [fresh]
            fresh += 1
        for s in symbols:
            if s in model.ids:
                out.append(model.ids[s])
            else:
                out += [model.byte_id[b] for b in (pieces.MARK if s is None else s).encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.6, 1.0])
def test_pieces_equal_a_plain_agenda(dropout):
    own = pieces.Pieces.load().prepare()
    rng = random.Random(9)
    parts = [" ", "  ", "international", "the", "\n", "é", "日本", "\t", "ing", ".", "😀", "\0", "▁", "tion", "abab" * 9, "x" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "▁", " " * 70]
    for k, t in enumerate(texts):
        assert own.encode(t, key=k, dropout=dropout) == plain_agenda(own, t, k, dropout), repr(t)


def test_pieces_of_many_and_of_long_texts(monkeypatch):
    own = pieces.Pieces.load()
    texts = ["a text of its own " * k for k in range(40)] + ["", "Wörter ohne Ende " * 500]
    want = [own.encode(t, key=k) for k, t in enumerate(texts)]
    for load, segments, kept, rows in ((100, 7, 300_000, 5), (10_000, 50, 3, 100_000)):
        monkeypatch.setattr(pieces, "LOAD_CHARS", load)
        monkeypatch.setattr(pieces, "LOAD_SEGMENTS", segments)
        monkeypatch.setattr(pieces, "KEPT", kept)
        monkeypatch.setattr(pieces, "_ROWS", rows)
        ids, sizes = own.encode_many(texts, range(len(texts)))
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
        assert own.decode_many(ids, sizes) == texts


def test_pieces_on_spark(spark):
    rows = [(1, "Hello  world\n"), (2, ""), (3, None), (None, "▁ x"), (1, "Hello  world\n")]
    vocabulary = pieces.Pieces.load()
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary)
    back = pieces.decode(encoded, vocabulary)
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, rows))
    assert encoded.filter("doc_id = 2 AND size(ids) = 0").count() == 1 and encoded.filter("doc_id = 3 AND ids IS NULL").count() == 1
    same = pieces.encode(spark.createDataFrame([(1, "international organisation " * 30)] * 3, "doc_id long, text string").coalesce(1), vocabulary, turns=True, back=True)
    assert same.select("ids").distinct().count() == 3 and same.select("text").distinct().count() == 1


def test_repetition_rules(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "one", " \n \n", "a b c d e " * 3, "same line\nsame line\nother #$ <b>\n", "x " * 5000] + [
        " ".join(rng.choice("abcdé") for _ in range(rng.randint(5, 200))) + rng.choice(["", "\nz\nz"]) for _ in range(60)
    ] + [" ".join(str(rng.randrange(10**6)) for _ in range(100)) for _ in range(5)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[4]])], "doc_id long, text string")
    (tmp_path / "t").mkdir()
    df.coalesce(1).write.parquet(str(tmp_path / "t/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/documents.parquet/*.parquet'")
    q = con.sql(repetition.OP6_SQL)
    names = sorted(q.columns)
    want = sorted(str(tuple(dict(zip(q.columns, r, strict=True))[n] for n in names)) for r in q.fetchall())
    assert as_rows(repetition.op6_repetition(spark, str(tmp_path / "t")), names) == want
    assert repetition.repetition_rules(df.limit(0)).count() == 0


def test_quotations(spark, tmp_path):
    rng = random.Random(3)
    said = ["The disk is full again.", "Try to clear the cache", "  Mixed   CASE words ", "Ok", "Second paragraph.\nwith two lines", "", "Übrigens ja"]
    rows = []
    for c in range(25):
        old: list[str] = []
        for t in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.5 and old:
                    depth = rng.randint(1, 3)
                    parts.append("\n".join(rng.choice(["> ", ">", " > "]) * depth + line for line in rng.choice(old).split("\n")))
                    parts += ["On Monday Bob wrote:"] * (rng.random() < 0.2)
                elif rng.random() < 0.2:
                    parts.append("> > > > > > > > > > deep\n> > > > > > > > > deep too\n> un known")
                else:
                    old.append(rng.choice(said) + rng.choice(["", f" no {rng.randint(0, 99)}"]))
                    parts.append(old[-1])
                parts += [""] * (rng.random() < 0.4)
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(parts) if rng.random() < 0.95 else None))
    rows += [(None, 1, "user", "> Ok"), (3, None, "user", "> Ok"), *rows[:5]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    q = con.sql(quotes.OP1_SQL)
    names = sorted(q.columns)
    want = sorted(str(tuple(dict(zip(q.columns, r, strict=True))[n] for n in names)) for r in q.fetchall())
    got = quotes.op1_quotations(spark, str(tmp_path))
    assert as_rows(got, names) == want and got.filter("depth > 1").count() > 0
