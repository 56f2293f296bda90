"""The memory store: versioned Parquet, partitioned by category; a version is written before it is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.plans.session import prepared

ITEMS = "category string, ord long, text string, session string, item_date date, source string"
MARKERS = "session string, status string, reviewed_at timestamp, accepted map<string,bigint>"


class Store:
    """Tables under one root that Spark can read and write (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepared(spark), root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        """Versions that were written to their end, oldest first."""
        return [v for v in self._numbers(table) if self._written(f"{self.root}/{table}/v{v}")]

    def _written(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def read(self, table: str, schema: str) -> DataFrame:
        """The current version; an empty table before the first write."""
        have = self.versions(table)
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{have[-1]}")

    def replace(self, table: str, rows: DataFrame, partition_by: str | None = None) -> None:
        """Write the next version; readers see it once it is whole. Older versions are the backups.

        Of two writers that start from the same version one fails: its folder is there already.
        """
        writer = rows.write.mode("errorifexists")
        writer = writer.partitionBy(partition_by) if partition_by else writer
        writer.parquet(f"{self.root}/{table}/v{max(self._numbers(table), default=0) + 1}")

    def _numbers(self, table: str) -> list[int]:
        """Versions that were begun."""
        fs, p = self._fs(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def prune(self, table: str, backups: int = 5) -> None:
        """Delete all but the current version and the backups before it."""
        for v in self.versions(table)[: -1 - backups]:
            fs, p = self._fs(f"{self.root}/{table}/v{v}")
            fs.delete(p, True)

    def back(self, table: str) -> None:
        """Drop the current version."""
        have = self.versions(table)
        if have:
            fs, p = self._fs(f"{self.root}/{table}/v{have[-1]}")
            fs.delete(p, True)

    def items(self) -> DataFrame:
        return self.read("memory", ITEMS)

    def markers(self) -> DataFrame:
        """The last marker of each session, of a log that is only ever added to."""
        fs, p = self._fs(f"{self.root}/markers")
        if not fs.exists(p):
            return self.spark.createDataFrame([], MARKERS)
        log = self.spark.read.schema(MARKERS).parquet(f"{self.root}/markers")
        last = F.max_by(F.struct("status", "reviewed_at", "accepted"), F.col("reviewed_at"))
        return log.groupBy("session").agg(last.alias("m")).select("session", "m.*")

    def put_items(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in ITEMS.split(", ")]
        self.replace("memory", rows.select(*columns), "category")

    def mark(self, sessions: DataFrame, status: str, accepted: dict[str, int]) -> None:
        """Mark all of `sessions` (session) by one append."""
        pairs = [F.lit(x) for kv in accepted.items() for x in (kv[0], F.lit(kv[1]).cast("bigint"))]
        counts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
        rows = sessions.select("session", F.lit(status).alias("status"), F.current_timestamp().alias("reviewed_at"), counts.alias("accepted"))
        rows.write.mode("append").parquet(f"{self.root}/markers")
