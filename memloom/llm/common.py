"""What the training-data operators share: the shared folder, words, the held-out split."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the word contract, as a Java character class and as Python characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows per Arrow batch: bounds what a Python worker holds at once when texts are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; one of our own only on a lone local machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return at.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor loses none of them.

    They go when `clear` is called or, at the latest, when the application ends. The session
    is told to delete shuffle files with the query that made them.
    """

    _open: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        # shuffle files of a written table go with its query, not when the driver collects garbage
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self._folder()[0].deleteOnExit(self._folder()[1])
        if Scratch._open is not None:
            Scratch._open.append(self)

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def clear(self) -> None:
        """Delete all tables; nothing may read them any more."""
        fs, path = self._folder()
        fs.delete(path, True)

    @staticmethod
    @contextmanager
    def passing() -> Iterator[None]:
        """What is made within is cleared at its end."""
        before, Scratch._open = Scratch._open, []
        try:
            yield
        finally:
            made, Scratch._open = Scratch._open, before
            for scratch in made:
                scratch.clear()

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}"
        writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.startswith(("file:", "/")) or self.root in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                if self.root.split("://")[-1].split("file:")[-1] in folder:
                    path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A filter has this many bits for each key, and between these powers of two in all.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 22, 27


class KeyFilter:
    """A bitmap over hashes of keys, broadcast to a scan; a bit that two keys share only makes a row suspect in vain.

    Its size follows the number of keys, up to 2 ** MOST_BITS bits in 2 ** (MOST_BITS - 6)
    rows of two longs. Beyond that it is None: callers then join, and shuffle, all rows.
    """

    def __init__(self, bitmap: DataFrame, bits: int):
        self.bitmap, self.bits = bitmap, bits

    @staticmethod
    def of(hashes: DataFrame, scratch: Scratch, most_bits: int = MOST_BITS) -> KeyFilter | None:
        """From a table of one column of hashes (longs)."""
        hashes = hashes.toDF("h")
        n = hashes.count()
        bits = max(LEAST_BITS, (BITS_A_KEY * n - 1).bit_length() if n else 0)
        if bits > most_bits:
            return None
        bit = F.pmod("h", F.lit(1 << bits))
        cells = hashes.select(F.shiftright(bit, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b"))
        return KeyFilter(scratch.keep(cells.groupBy("cell").agg(F.bit_or("b").alias("bits"))), bits)

    def suspects(self, rows: DataFrame, h: Column, name: str) -> DataFrame:
        """`rows` with a boolean column: whether the bit of the hash `h` is set."""
        bit = F.pmod(h, F.lit(1 << self.bits))
        bitmap = F.broadcast(self.bitmap.withColumnsRenamed({"cell": "_cell", "bits": "_bits"}))
        out = rows.withColumn("_bit", bit).withColumn("_cell", F.shiftright("_bit", 6)).join(bitmap, "_cell", "left")
        is_set = F.coalesce(F.getbit(F.col("_bits"), (F.col("_bit") % 64).cast("int")) == 1, F.lit(False))
        return out.withColumn(name, is_set).drop("_cell", "_bit", "_bits")


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """(_row, ...): each row as one struct, so that no column of it clashes with those beside it."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *(c.alias(n) for n, c in more.items()))


def drop_rows(rows: DataFrame, dropped: DataFrame, keys: list[str], scratch: Scratch, most_bits: int = MOST_BITS) -> DataFrame:
    """Of `rows` (_row and `keys`) those whose keys are not in `dropped` (the same keys, all nulls equal), unpacked.

    Most rows stay where they are: only rows that a filter of the dropped first keys marks
    are joined, and so shuffled, with their texts, and only for them the other keys are made.
    """
    dropped = dropped.select(*(F.col(k).alias(f"_gone_{k}") for k in keys))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
        same = one if same is None else same & one
    found = KeyFilter.of(dropped.select(F.xxhash64(dropped.columns[0])).distinct(), scratch, most_bits)
    if found is None:
        return rows.join(dropped, same, "left_anti").select("_row.*")
    marked = found.suspects(rows, F.xxhash64(keys[0]), "_suspect")
    left = marked.filter("_suspect").join(dropped, same, "left_anti")
    return marked.filter("NOT _suspect").select("_row.*").unionAll(left.select("_row.*"))


_SHIPPED: set[str] = set()


def python_workers(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors, wherever they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_rows(docs: DataFrame, key: str, columns: dict[str, Column], fields: str, prepare: Callable) -> DataFrame:
    """(key, *fields) of every row, made in Python of `columns`.

    `prepare()` runs once a task and gives a function of lists of the columns' values (by
    name) that yields rows as tuples, or lists of tuples, in order. The key goes by in
    Arrow as it is, of any type: pandas would make a float of a long beside a null.
    """
    python_workers(docs.sparkSession)
    kinds, names = to_arrow_schema(StructType.fromDDL(fields)), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = prepare()
        for batch in batches:
            at = 0
            for rows in made({n: batch.column(k + 1).to_pylist() for k, n in enumerate(names)}):
                values = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                arrays = [pa.array(list(v), type=f.type) for v, f in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *arrays], ["_k", *kinds.names])
                at += len(rows)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), *(c.alias(n) for n, c in columns.items()))
    return rows.mapInArrow(run, f"_k {kind}, {fields}").withColumnRenamed("_k", key)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def bounded_chunks(texts: Iterable[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about `most` characters; a longer text stands alone."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


#: A sample has at most this many labels, the commonest.
MOST_LABELS = 1000


def keyed_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, by least hash of `key`: the same rows on every run.

    At most twice that many rows come back in all cases, so the result may be broadcast.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000))
    rows = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    common = rows.groupBy(label).count().orderBy(F.col("count").desc(), label).limit(MOST_LABELS)
    counts = {r[0]: r[1] for r in common.collect()}
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        keep = keep | ((F.col(label) == F.lit(value)) & (h < int(1e6 * min(1.0, per_label / n))))
    return rows.filter(keep).orderBy(h, key).limit(2 * per_label * max(1, len(counts)))
