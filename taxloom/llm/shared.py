"""Small helpers the operators share: checkpoints, tables and row batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's spark.checkpoint.dir.

    In local mode, where one machine is all there is, an unset folder becomes a
    temporary one; on a cluster it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-taxloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it is done, not when the driver's JVM collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of one batch of the Parquet reader, and bytes of a row group: texts and sets of shingles are long rows, and hashes fill no dictionary.
READ_ROWS, ROW_GROUP = 256, 16 << 20


def _read_few_rows_at_a_time(spark: SparkSession) -> None:
    """A column's batch is one array in the heap; 4,096 long rows make it a huge one. A setting of the session, since Spark reads it when a query runs."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def write(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet under `path`, read back."""
    spark = df.sparkSession
    _read_few_rows_at_a_time(spark)
    with _shuffles_end_with_their_query(spark):
        df.write.option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


class Scratch:
    """Tables in the shared folder that cut lineage, within a `with` block.

    A table goes when `drop` names it, and all go with the block: what an
    operator returns is therefore kept by `keep` before the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/taxloom-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        """Drops the tables, and lets Spark drop what their queries left in the executors' memory.

        Broadcasts of finished queries, file readers' settings among them, stay
        there until the driver's JVM has collected what refers to them, which
        Spark itself sees to every half hour (spark.cleaner.periodicGC.interval).
        """
        remove(self.spark, self.folder)
        self.spark.sparkContext._jvm.System.gc()

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        out = write(df, path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.paths:
            if any(table is t for t in tables):
                remove(self.spark, path)


def keep(df: DataFrame) -> DataFrame:
    """A checkpoint, for what a result goes on reading.

    Spark deletes it with the session's folder, or sooner where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    with _shuffles_end_with_their_query(df.sparkSession):
        return df.checkpoint(eager=True)


#: Values of a key that are joined by broadcast at most.
HOT_KEYS = 4096


def join_counted(left: DataFrame, right: DataFrame, on: str, how: str = "inner", rows: int = 0) -> DataFrame:
    """left joined with right (inner or left), which has one small row for each value of `on` and in `n` how many rows of left have it.

    Values that hold more than a HOT_KEYS-th of all rows are no more than
    HOT_KEYS, so these go by broadcast, and rows of a hot value stay where they
    are; the rest is shuffled, as are values of `rows` rows or fewer. Both are
    read twice: they should be tables.
    """
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = (F.col("n") * HOT_KEYS > F.lit(total)) & (F.col("n") > rows)
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def by_bitmap(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose `on` may be among that of keys, and rows whose `on` is not, nulls among them.

    A bitmap of hashes, 1 MB at most, is broadcast, so that where few rows have
    a partner, few are shuffled when the former are joined.
    """
    h = F.pmod(F.xxhash64(on), F.lit(1 << 23))
    bit = F.expr("shiftleft(1L, cast(bitmap_hash & 63 as int))")
    bits = keys.filter(F.col(on).isNotNull()).select(h.alias("bitmap_hash")).select(F.shiftright("bitmap_hash", 6).alias("bitmap_word"), bit.alias("bit")).groupBy("bitmap_word").agg(F.bit_or("bit").alias("bitmap_bits"))
    marked = df.withColumn("bitmap_hash", h).withColumn("bitmap_word", F.shiftright("bitmap_hash", 6)).join(F.broadcast(bits), "bitmap_word", "left")
    held = F.col(on).isNotNull() & F.coalesce(F.col("bitmap_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(held).select(*df.columns), marked.filter(~held).select(*df.columns)


def bucket_of(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package beside the driver's copy, whatever folder the session runs in.

    A cluster without a common path ships the package (--py-files) instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Bytes of one Arrow batch; a batch is held by the JVM and, as arrays and lists, by its Python worker.
BATCH_BYTES = 4 << 20


def _hand_back() -> None:
    """Gives free memory back to the system: Spark reuses its Python workers, and an idle one should not hold what a task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def streamed(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_BYTES at most (a setting of the session, since Spark reads it when a query runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _hand_back()

    importable(df.sparkSession)
    _read_few_rows_at_a_time(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def batched(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """As streamed, with a function from one record batch to one; `done` runs when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield fn(batch)
        finally:
            if done:
                done()

    return streamed(df, run, schema)
