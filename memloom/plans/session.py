"""Session settings the plans rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepared(spark: SparkSession) -> SparkSession:
    """UTC, and a checkpoint folder: the cluster's if it names one, our own only on a local machine.

    Rules cost far more than the bytes of their texts suggest, so small shuffles are not put
    together into fewer tasks than there are cores. What is broadcast is small as measured, not as
    guessed: the size of exploded rows is guessed at that of the texts they came from.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if most != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    prepared(df.sparkSession)
    return df.checkpoint()


def told(rows: DataFrame, on: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` joined with what `answer` makes of each distinct value of a column: one that recurs is judged once.

    `answer` gets a table of that column alone and gives rows that have it; a row of `rows` is
    repeated, or dropped, as its value is there. Names of other columns must differ.
    """
    rows = cut(rows)
    # the explode of one element keeps filters of `answer` from being pushed below the distinct
    values = rows.select(on).distinct().select(F.explode(F.array(on)).alias(on))
    answers = answer(values).withColumnRenamed(on, "_told")
    return rows.join(answers, F.col(on).eqNullSafe(F.col("_told"))).drop("_told")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores, four parts each, if its rows come in fewer or unlike parts: a row group is read by one task.

    The rows of each part are counted from file footers.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    full, rows, most = sizes.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return df if full >= parts and most * full <= 3 * rows else df.repartition(max(parts, 2 * df.rdd.getNumPartitions()))
