"""Writing results: a path a line, NUL-terminated, JSON, or a table of counts."""

from __future__ import annotations

import json
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(paths: DataFrame) -> DataFrame:
    """json: an object for each path, as write_paths gives it; bytes that are no UTF-8 are replaced."""
    return paths.select(F.to_json(F.struct(F.make_valid_utf8(F.col("path").cast("string")).alias("path"))).alias("json"))


def write_paths(paths: DataFrame, out: BinaryIO, null: bool = False, as_json: bool = False) -> int:
    """Rows stream through the driver one partition at a time.  JSON replaces bytes that are no UTF-8."""
    if null and as_json:
        raise ValueError("null and JSON output exclude each other")
    n = 0
    if as_json:
        out.write(b"[")
    for row in paths.toLocalIterator(prefetchPartitions=False):
        path = bytes(row.path)
        if as_json:
            out.write((b"," if n else b"") + json.dumps({"path": path.decode("utf-8", "replace")}, ensure_ascii=False, separators=(",", ":")).encode())
        else:
            out.write(path + (b"\0" if null else b"\n"))
        n += 1
    if as_json:
        out.write(b"]\n")
    return n


def write_counts(ranking: DataFrame, total: int, out: BinaryIO, notes: BinaryIO) -> None:
    rows = ranking.collect()  # at most the ranking's limit
    out.write(f"{'ENTRIES':>12}  DIRECTORY\n".encode())
    for row in rows:
        out.write(f"{row.n:>12,}  ".encode() + bytes(row.dir) + b"\n")
    notes.write(f"total: {total:,}\n".encode())
