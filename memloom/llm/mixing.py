"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row has a 60-bit hash of its id. A source that must give `r` times its own
size takes every row floor(r) times and, once more, the rows whose hash lies at or
below a threshold. The threshold is found without a sort: words are summed by
(source, top hash bits), the bucket in which the budget ends is refined by the next
bits, and only rows of that bucket are read again. The same hash serves any budget,
so the rows of a smaller budget are among those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import Scratch, table, word_count
from memloom.operators.graph import numbered

#: Of the row hash: bits in all, and bits that each refinement adds.
HASH_BITS, LEVEL_BITS = 60, 12
#: A source gives no more than this many times its own size.
MOST_TIMES = 3


def row_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long; null keys hash as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, source: str = "source", most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, weight, target) of a table of (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... A target is
    min(most_times * source_size, weight * level), where the level is such that the
    targets sum to all sizes: what sources at their cap leave is reshared by weight until
    none is above. Places are numbered over range partitions and each round is one sum over
    the sources, so there may be very many of them.
    """
    rows = sizes.select(F.col(source).alias("source"), "source_size", F.lit(0).alias("_all"))
    rows = numbered(rows, "_all", [F.col("source").isNull(), F.col("source").cast("binary")], "_place").drop("_all")
    rows = rows.select("source", "source_size", ((F.col("_place") - 1) % 3 + 1).alias("weight"), (F.col("source_size") * most_times).alias("cap"))
    rows = scratch.keep(rows)
    level = 0.0
    while True:
        # a source whose share at this level is above its cap is closed; levels only rise
        closed = F.col("weight") * F.lit(level) > F.col("cap")
        rest = F.sum("source_size") - F.coalesce(F.sum(F.when(closed, F.col("cap"))), F.lit(0))
        found = rows.agg((rest / F.sum(F.when(~closed, F.col("weight")))).alias("level")).first()["level"]
        if found is None or found <= level:  # no rows, or all are at their cap
            break
        level = found
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return rows.select(F.col("source").alias(source), "source_size", "weight", target.alias("target"))


def mixing_plan(
    rows: DataFrame, scratch: Scratch, most_times: int = MOST_TIMES, level_bits: int = LEVEL_BITS
) -> tuple[DataFrame, int]:
    """(a row per source, shift) of rows (size, source, hash).

    Of a source, rows count `turns` times, and once more if hash >> shift is below `limit`.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, scratch)
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("turns", F.least(F.floor(ratio), F.lit(most_times)).cast("long"))
    # what is left for the hashed part; -1 marks a bucket that is found out to the last bit
    plan = plan.withColumn("left", F.col("target") - F.col("turns") * F.col("source_size"))
    plan = scratch.keep(plan.withColumn("prefix", F.lit(0).cast("long")))

    for bits in range(level_bits, HASH_BITS + 1, level_bits):
        shift = HASH_BITS - bits
        bucket = F.shiftright("hash", shift)
        open_ = plan.select(F.col("source").alias("_source"), "prefix", "left")
        found = rows.join(open_, F.col("source").eqNullSafe(F.col("_source")))
        if bits > level_bits:
            found = found.filter(F.shiftright("hash", shift + level_bits) == F.col("prefix"))
        sums = found.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        # at most 2 ** level_bits rows of a source, whatever the number of documents
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
        edge = sums.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "low", "high")).alias("e"))
        edge = edge.select(
            F.col("source").alias("_source"), F.col("e.bucket").alias("bucket"),
            (F.col("e.upto") - F.col("e.words")).alias("before"), F.col("e.words").alias("words"),
            (F.col("e.low") == F.col("e.high")).alias("single"),
        )
        # no edge: the whole bucket fits, which only happens where the budget is the whole source
        plan = plan.drop("words", "single").join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "turns",
            F.coalesce("bucket", (F.col("prefix") + 1) * 2**level_bits).alias("prefix"),
            F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.col("left") - F.col("before")).alias("left"),
            F.col("words"), F.coalesce("single", F.lit(True)).alias("single"),
        )
        plan = scratch.keep(plan)
        done = plan.filter(~F.col("single")).isEmpty()
        if done or bits == HASH_BITS:
            break
    # the row at the edge counts if that comes nearer to the target
    takes_edge = F.coalesce(F.col("left") * 2 > F.col("words"), F.lit(False))
    limit = F.col("prefix") + takes_edge.cast("long")
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "turns", limit.alias("limit"))
    return plan, shift


def _times(shift: int, most_times: int) -> Column:
    below = (F.shiftright("hash", shift) < F.col("limit")) & (F.col("turns") < most_times)
    return F.col("turns") + below.cast("long")


def mix(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", size: str = "size", source: str = "source",
    most_times: int = MOST_TIMES, level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """(key, size, source_size, target, taken) for every row of `docs` (key, size, source).

    taken = size * (full turns + 1 if the hash is within the threshold). A source's
    sum of taken is within one row (or one group of rows with equal ids) of its target,
    on the nearer side. Null source: one source of its own, last. Size 0 (null or empty
    texts): taken 0. Rows with equal ids share a hash and so are taken together. Empty
    table: empty result. Reruns agree: nothing depends on the order of rows.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(size).cast("long").alias("size"), F.col(source).alias("source"),
        row_hash(F.col(key)).alias("hash"),
    )
    rows = scratch.keep(rows)
    plan, shift = mixing_plan(rows, scratch, most_times, level_bits)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(
        F.col("_key").alias(key), "size", "source_size", "target", (F.col("size") * _times(shift, most_times)).alias("taken")
    )


def draw(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", most_times: int = MOST_TIMES) -> DataFrame:
    """The rows of the mix, with all columns of `docs`: each row as often as the mix takes it.

    Only a row per source is joined to the texts, which stay where they are.
    """
    sized = docs.select(word_count(F.col(text)).alias("size"), "source", row_hash(F.col(key)).alias("hash"))
    plan, shift = mixing_plan(scratch.keep(sized), scratch, most_times)
    # the row is packed, so that no column of it can clash with those of the plan
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_own"), row_hash(F.col(key)).alias("hash"))
    out = out.join(plan, F.col("_own").eqNullSafe(F.col("_source"))).withColumn("_times", _times(shift, most_times))
    out = out.filter("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select("_row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source")
    return mix(rows, Scratch(spark, "mix"))


#: The plain way, for the check: sort each source by hash and take rows while they fit.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-
]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), n AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), weight, source NULLS LAST) AS k FROM s
), fill AS (
  SELECT 0 AS k, CAST(SUM(source_size) AS DOUBLE) AS rest, CAST(SUM(weight) AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS level FROM n
  UNION ALL
  SELECT n.k, rest - 3 * source_size, w - weight,
         CASE WHEN level IS NULL AND rest / w * weight <= 3 * source_size THEN rest / w ELSE level END
  FROM fill JOIN n ON n.k = fill.k + 1
), t AS (
  SELECT n.source, source_size, LEAST(3.0 * source_size, weight * (SELECT MAX(level) FROM fill)) AS target FROM n
), u AS (
  SELECT *, LEAST(FLOOR(target / GREATEST(source_size, 1)), 3) AS turns FROM t
), g AS (
  SELECT source, h, SUM(size) AS words FROM d GROUP BY source, h
), c AS (
  SELECT g.*, SUM(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g
), m AS (
  SELECT c.source, c.h, turns < 3 AND
         (upto <= target - turns * source_size
          OR (upto - words <= target - turns * source_size AND 2 * (target - turns * source_size - (upto - words)) > words)) AS more
  FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source
)
SELECT d.doc_id, d.size, u.source_size, u.target,
       CAST(d.size * (u.turns + CASE WHEN m.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
       JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h
"""
