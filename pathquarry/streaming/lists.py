"""Path lists that arrive as files, matched as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, view
from ..plans.compile import predicate
from ..plans.syntax import parse


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of paths, BINARY, from text files of UTF-8 paths that appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.where("value <> ''").select(F.encode("value", "UTF-8").alias("path"))


def matching(paths: DataFrame, patterns: list[str], case_sensitive: bool = False, whole_path: bool = False) -> DataFrame:
    """Works on streams and tables alike: the predicate keeps no state."""
    path = view("path")
    return paths.where(predicate(parse(patterns, case_sensitive, whole_path), basename(path), path))
