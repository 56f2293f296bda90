"""Exact dedup by progressive refinement (DataFrame functions only).

Texts are equal when they are identical after each run of white space is one space.
Rows are grouped by the length of that text; lengths that occur once need nothing
more. The rest are grouped by a hash of the first PREFIX characters, and only rows
whose (length, prefix hash) occurs more than once have their whole text hashed. The
surviving keys reach the second scan as a bitmap, so whole texts are never shuffled; with
more keys than a bitmap holds, every row hashes its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import SPACE, KeyFilter, Scratch, drop_rows, packed, table

#: Characters of the prefix hash.
PREFIX = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def exact_dedup(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", digest_all: bool = False
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, row) for every row of `docs`.

    Of equal texts the row with the smallest key stays; a null key is larger than any.
    Null text counts as empty. Rows that repeat key and text are numbered in `row` (0, 1,
    ...), and of those only number 0 can stay. text_sha256 is null for rows that need no
    whole-text hash, unless `digest_all`. Empty table: empty result.
    """
    norm = normalised(F.col(text))
    base = docs.select(F.col(key).alias("_key"), norm.alias("_norm")).select(
        "_key", F.length("_norm").alias("n"), F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("prefix"), "_norm"
    )
    by_length = base.select("n", "prefix").groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    # a length with one row is settled; so is, among the others, a prefix with one row
    lengths = by_length.groupBy("n").agg(F.sum("rows").alias("of_length")).filter("of_length > 1").select("n")
    survivors = by_length.filter("rows > 1").join(lengths, "n", "left_semi").select("n", "prefix")
    survivors = scratch.keep(survivors.select(F.xxhash64("n", "prefix").alias("h")))  # counted, then made a filter: texts are read once
    found = KeyFilter.of(survivors, scratch)
    scan = base.withColumn("survives", F.lit(True)) if found is None else found.suspects(base, F.xxhash64("n", "prefix"), "survives")
    digest = F.sha2(F.col("_norm").cast("binary"), 256)
    narrow = scan.select(
        "_key", "n", "prefix", "survives", (digest if digest_all else F.when(F.col("survives"), digest)).alias("sha")
    )
    # rows that repeat key and text become one row with a count: no group of copies meets in a task
    narrow = scratch.keep(narrow.groupBy("_key", "n", "prefix", "survives", "sha").agg(F.count(F.lit(1)).alias("times")))
    least = F.min(F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("id")))
    groups = narrow.filter("survives").groupBy("n", "prefix", "sha").agg(least["id"].alias("keep_id"), F.sum("times").alias("group_size"))
    # written, so that the join has plain exchanges on both sides and a hot group can be split
    groups = scratch.keep(groups.filter("group_size > 1"))
    out = narrow.join(groups, ["n", "prefix", "sha"], "left")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    keep_id = F.when(F.col("group_size").isNull(), F.col("_key")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_key").alias(key), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_key").eqNullSafe(keep_id) & (F.col("row") == 0)).alias("kept"), F.col("sha").alias("text_sha256"), "row",
    )


def keep_first(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of equal texts the row with the smallest key; a null key is larger than any other. Null
    text counts as empty. Of rows that repeat key and text one stays; rows that share a key
    but not their text are judged one by one. Empty table: empty result.
    """
    found = exact_dedup(docs, scratch, key, text)
    found = scratch.keep(found.select(F.col(key).alias("_key"), "kept", "row", "text_sha256"))
    rows = packed(docs, _key=F.col(key), _sha=F.sha2(normalised(F.col(text)).cast("binary"), 256))
    dropped = found.filter(~F.col("kept") & (F.col("row") == 0)).select("_key", F.col("text_sha256").alias("_sha")).distinct()
    # rows that were not hashed are alone: they are never among the dropped
    left = drop_rows(rows, scratch.keep(dropped), ["_key", "_sha"], scratch)
    if found.filter("row > 0").isEmpty():
        return left
    repeats = found.filter("row > 0").select(F.col("_key").alias("_again")).distinct()
    rows = packed(left, _key=F.col(key), _sha=F.sha2(normalised(F.col(text)).cast("binary"), 256))
    again = F.col("_key").eqNullSafe(F.col("_again"))
    singles, many = rows.join(repeats, again, "left_anti"), rows.join(repeats, again, "left_semi")
    one = many.groupBy("_key", "_sha").agg(F.first("_row").alias("_row"))
    return singles.select("_row.*").unionAll(one.select("_row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup(docs, Scratch(spark, "exact"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), n AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS k,
         COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
         FIRST_VALUE(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM n
"""
