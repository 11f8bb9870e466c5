"""Lists of paths as files: newline or NUL after each path, any bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, raw, view


def read(spark: SparkSession, path: str, null: bool = False, index_name: str = "list", index_ord: int = 0) -> DataFrame:
    """A catalog (see search) of the paths in the files; empty items are skipped.

    Files split at the separator across tasks; Latin-1 keeps every byte.
    """
    rows = spark.read.option("lineSep", "\0" if null else "\n").option("encoding", "ISO-8859-1").option("header", False).option("quote", "").option("sep", "\x01\x02\x03").option("mode", "PERMISSIVE").schema("line string").csv(path)
    rows = rows.where("line is not null and line <> ''")
    return rows.select(F.lit(index_name).alias("index_name"), F.lit(index_ord).alias("index_ord"), F.monotonically_increasing_id().alias("entry_id"), raw(F.col("line")).alias("path"), raw(basename(F.col("line"))).alias("name"))


def of_bytes(spark: SparkSession, paths: list[bytes], index_name: str = "list", index_ord: int = 0) -> DataFrame:
    rows = spark.createDataFrame([(index_name, index_ord, i, bytearray(p)) for i, p in enumerate(paths)], "index_name string, index_ord int, entry_id long, path binary")
    return rows.withColumn("name", raw(basename(view("path"))))


def merge(old: DataFrame, new: DataFrame, scope: str | bytes) -> DataFrame:
    """Paths of old outside a subtree, with those of new, each once in byte order."""
    from ..functions.paths import under

    kept = old.select("path").where(~under(view("path"), scope))
    return kept.unionByName(new.select("path")).distinct().orderBy("path")
