"""Null and large ids, empty tables, nulls in any column, ties, repeats, clashing columns, very long texts: all operators."""

import pytest
from pyspark.sql import functions as F

from memloom.llm import cotraining, exact_dedup, language, mixing, near_dedup, pieces, quotes, repetition, simhash, suffixes, toxicity
from memloom.llm.common import Scratch, word_count

BIG = (1 << 53) + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _norm string, _k long, t string"
ROWS = [
    (BIG, "one text of its own, with some words in it", "en", "a", 42, "x", "y", 1, "z"),
    (None, "another text without a key but with words", None, None, None, None, None, None, None),
    (None, "a third text, also without a key at all here", "en", "a", 5, "x", "y", 1, "z"),
    (BIG + 2, None, "en", None, None, "x", "y", 1, "z"), (BIG + 4, "", "de", "b", 0, "x", "y", 1, "z"),
    (BIG + 6, "... !!! 123 ---", "de", "b", 0, "x", "y", 1, "z"), (7, "tie", "en", "a", 3, "x", "y", 1, "z"), (7, "tie", "en", "a", 3, "x", "y", 1, "z"),
    (BIG + 8, "long words all the way " * 45_000, "en", "a", 1_000_000, "x", "y", 1, "z"), (-3, "x" * 300_000, "en", "a", 300_000, "x", "y", 1, "z"),
]
LABELS = "doc_id long, quality int, toxic int"


def frames(spark, rows=ROWS, labels=()):
    return spark.createDataFrame(list(rows), SCHEMA).repartition(2), spark.createDataFrame(list(labels), LABELS)


def per_row(spark, docs, labels):
    """The operators that give a row for each row."""
    scratch = Scratch(spark, "odd")
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source")
    vocabulary = pieces.Pieces.load()
    encoded = pieces.encode(docs, vocabulary)
    return {
        "mix": mixing.mix(sized, scratch),
        "toxicity": toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)),
        "simhash": simhash.simhash_components(docs, scratch),
        "pieces": encoded, "back": pieces.decode(encoded, vocabulary),
        "repetition": repetition.repetition_rules(docs),
        "language": language.identify(docs, language.fit_languages(docs)),
        "exact": exact_dedup.exact_dedup(docs, scratch),
        "quality": cotraining.score_quality(docs, cotraining.fit_quality(docs, labels)),
        "repeats": suffixes.remove_repeats(docs, scratch),
    }


def ids(df):
    return sorted(str(r[0]) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("case", ["labelled", "unlabelled", "bare"])
def test_every_row_comes_back_with_its_id(spark, case):
    rows = ROWS if case != "bare" else [(k, "... !!! 123", None, None, None, None, None, None, None) for k in (None, BIG, 1, 2, 3, 5)]
    labels = [] if case == "unlabelled" else [(BIG, 1, 1), (BIG + 2, 0, 0), (BIG + 4, None, None), (7, 0, 1), (7, 1, 0), (BIG + 6, 0, 0), (1, 1, 1), (2, 0, 0), (3, 1, 1), (None, 1, 1)]
    docs, known = frames(spark, rows, labels)
    want = sorted(str(r[0]) for r in rows)
    for name, found in per_row(spark, docs, known).items():
        assert ids(found) == want, name


def test_empty_tables(spark):
    for name, found in per_row(spark, *frames(spark, [])).items():
        assert found.count() == 0, name
    docs, labels = frames(spark, [])
    for kept in (
        toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels)), exact_dedup.keep_first(docs, Scratch(spark, "odd")),
        near_dedup.keep_one(docs, Scratch(spark, "odd")), mixing.draw(docs, Scratch(spark, "odd")),
    ):
        assert kept.count() == 0 and kept.columns == docs.columns
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link_quotations(chats, Scratch(spark, "odd")).count() == 0


def test_filters_keep_ids_and_columns(spark):
    docs, labels = frames(spark, [*ROWS, (BIG + 10, "one  text of its own, with some\twords in it", "en", "a", 1, "x", "y", 1, "z")])
    left = exact_dedup.keep_first(docs, Scratch(spark, "odd"))
    assert left.columns == docs.columns
    # the copy and the repeat go, and of the null and the empty text the one with the larger id
    assert ids(left) == sorted(["None", "None", str(BIG), str(BIG + 2), str(BIG + 6), "7", str(BIG + 8), "-3"])
    near = near_dedup.keep_one(left, Scratch(spark, "odd"))
    assert near.columns == docs.columns and ids(near) == ids(left)
    drawn = mixing.draw(near, Scratch(spark, "odd"))
    assert drawn.columns == docs.columns and set(ids(drawn)) <= set(ids(near))
    calm = toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))
    assert calm.columns == docs.columns
