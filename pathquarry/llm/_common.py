"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at a time at most (one row may be larger).
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ours; they are read when a plan runs, so they stay lowered.  Smaller ones stay as they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that a worker has freed back to the system: workers stay, and others share their executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(run):
    """run(batches), with release() when a task has read all of them."""

    def inner(batches):
        yield from run(batches)
        release()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pathquarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n, self.held = 0, set()

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self._delete(df._scratch_path)

    def keep_only(self, df: DataFrame) -> DataFrame:
        """Delete all tables but this one, from which everything that follows is read."""
        for path in self.held - {df._scratch_path}:
            self._delete(path)
        return df

    def _delete(self, path: str) -> None:
        self.held.discard(path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def of_keys(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A shuffled table of keys in fewer partitions: their number is set for texts, and each becomes a file.

    An eighth of them, and not more than one for each 100,000 rows where their number is known.
    """
    few = max(1, shuffle_partitions(df.sparkSession) // 8)
    return df.coalesce(few if rows is None else max(1, min(few, -(-rows // 100_000))))


def is_empty_text(col):
    return F.coalesce(col, F.lit(""))
