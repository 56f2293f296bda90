"""Documents through toxicity, exact dedup, near dedup, mixing and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Extra columns of documents pass through them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from memloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents; rows at operator 3's threshold or above go.

    Null, empty and letterless texts stay unless texts without evidence score that high. Rows of
    equal text fare alike. Without labels all score alike. Empty table: empty result.
    """
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; null ids are larger than any.

    Null text is an empty one. Rows that share an id are judged by their texts; of rows equal in
    both one stays. Empty table: empty result.
    """
    return exact_dedup.keep_first(docs, Scratch(spark, "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the one with the smallest doc_id stays.

    SimHash and anchor-point covering propose, sets of shingles decide. Null ids are larger than
    any; ties go by a hash of the text. Texts without words are copies of each other; shorter texts
    are compared by all their words. Empty table: empty result.
    """
    return near_dedup.keep_one(docs, Scratch(spark, "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of the remaining documents takes them, 0 to 3 times.

    Null and empty texts have size 0 and cost nothing. A null source is one of its own, the last.
    Rows that share an id are taken together. Empty table: empty result.
    """
    return mixing.draw(docs, Scratch(spark, "mix"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of every row of the mix; rows that the mix repeats draw apart.

    Null text: null ids, n_ids 0; empty text: no ids. Empty table: empty result.
    """
    encoded = pieces.encode(docs, pieces.Pieces.load(), turns=True)
    return encoded.withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the conditional random field nor the piece agenda.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written before the next one reads it; what a stage or its input took goes with it."""
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch.passing():
            after = kept.keep(stage(spark, docs, sf_dir))
        if n:
            kept.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
