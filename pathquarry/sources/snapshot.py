"""Snapshots of directory trees: immutable Parquet tables and a pointer to the current ones.

entries      entry_id, rel_dir (raw path below the root, '' for the root), name, is_dir; one row stands for the root itself
directories  rel_path, stamp (device, inode, seconds of the last changes)
grams        gram, block: the trigrams of the folded names in each block of 4096 entry_ids, sorted by gram

Rows are sorted by directory, so that Parquet's dictionaries hold each path
about once and reading them needs no join.  Searches look the trigrams that a
name must hold up in grams and read the blocks that have them all, by ranges of
entry_id that Parquet's statistics skip by.  A reader keeps the tables it
started with; publishing writes new ones and then renames the pointer, and then
removes all but the new and the last snapshot.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from urllib.parse import urlsplit
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import raw, trigrams, view
from .config import Filters, IndexConfig

FORMAT = 1
ENTRIES = "entry_id long, rel_dir binary, name binary, is_dir boolean"
DIRECTORIES = "rel_path binary, stamp binary"
GRAMS = "gram string, block long"
#: Entry ids of a block, as a power of two; ranges of blocks that a scan is given at most; entries below which a scan needs no lookup.
BLOCK_BITS, MOST_RANGES, SCAN_BELOW = 12, 512, 200_000


class SnapshotError(RuntimeError):
    """A snapshot is missing, foreign or locked."""


class Files:
    """Hadoop's file system calls, so that snapshots can lie wherever Spark can write."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def move(self, source: str, target: str) -> None:
        p, fs = self._at(source)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(p, self.jvm.org.apache.hadoop.fs.Path(target), options)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


@dataclass(frozen=True)
class Manifest:
    format_version: int
    snapshot: str
    root: str
    filters: Filters
    entry_count: int


class Store:
    """The snapshots of one index, in the folder that its configuration calls its database."""

    def __init__(self, spark: SparkSession, index: IndexConfig):
        self.spark, self.index, self.files = spark, index, Files(spark)
        self.path = index.database

    def manifest(self) -> Manifest | None:
        if not self.files.exists(f"{self.path}/CURRENT"):
            if self.files.exists(self.path) and not self.files.exists(f"{self.path}/snapshots"):
                raise SnapshotError(f"{self.path} is there but is no snapshot folder; it is left alone")
            return None
        found = json.loads(self.files.read(f"{self.path}/CURRENT"))
        if found.get("format_version") != FORMAT:
            raise SnapshotError(f"{self.path} has format {found.get('format_version')}, not {FORMAT}; build it again")
        return Manifest(**found | {"filters": Filters(**{k: tuple(v) for k, v in found["filters"].items()})})

    def required(self) -> Manifest:
        found = self.manifest()
        if found is None:
            raise SnapshotError(f"index {self.index.name} has no snapshot at {self.path}")
        return found

    def entries(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/snapshots/{manifest.snapshot}/entries")

    def directories(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.schema(DIRECTORIES).parquet(f"{self.path}/snapshots/{manifest.snapshot}/directories")

    def candidates(self, manifest: Manifest, grams: set[str]) -> list[tuple[int, int]] | None:
        """Ranges of entry_id (both ends included) that hold every entry whose name has all the grams; None: all of them, or too many ranges."""
        at = f"{self.path}/snapshots/{manifest.snapshot}/grams"
        if not grams or not self.files.exists(at):
            return None
        hit = self.spark.read.schema(GRAMS).parquet(at).where(F.col("gram").isin(*sorted(grams)))
        found = hit.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("block").limit(16 * MOST_RANGES + 1).collect()
        ranges: list[tuple[int, int]] = []
        for block in sorted(r.block for r in found):
            low, high = block << BLOCK_BITS, (block + 1 << BLOCK_BITS) - 1
            if ranges and ranges[-1][1] + 1 == low:
                ranges[-1] = (ranges[-1][0], high)
            else:
                ranges.append((low, high))
        return None if len(found) > 16 * MOST_RANGES or len(ranges) > MOST_RANGES else ranges

    def sweep(self) -> None:
        """Remove work tables and pointers that broken runs left.  Only for the holder of the lock, before it works."""
        for name in self.files.names(f"{self.path}/snapshots"):
            if name.startswith("work-"):
                self.files.delete(f"{self.path}/snapshots/{name}")
        for name in self.files.names(self.path):
            if name.startswith("CURRENT."):
                self.files.delete(f"{self.path}/{name}")

    def lock(self) -> _Lock:
        return _Lock(self)

    def publish(self, entries: DataFrame, directories: DataFrame) -> Manifest:
        """Write new tables, check them, and point to them.  The snapshot before stays for those who read it."""
        name = uuid.uuid4().hex
        before = self.manifest()
        at = f"{self.path}/snapshots/{name}"
        ordered = entries.select("rel_dir", "name", "is_dir").orderBy("rel_dir", "name").select(F.monotonically_increasing_id().alias("entry_id"), "rel_dir", "name", "is_dir")
        ordered.write.option("compression", "zstd").parquet(f"{at}/entries")
        directories.select("rel_path", "stamp").orderBy("rel_path").write.option("compression", "zstd").parquet(f"{at}/directories")
        written = self.spark.read.schema(ENTRIES).parquet(f"{at}/entries")
        component = view("name")
        wrong = (F.length("name") == 0) | component.contains("/") | component.contains("\0") | component.isin(".", "..")
        count, bad = written.agg(F.count("*"), F.coalesce(F.sum((wrong & (view("name") != "")).cast("long")), F.lit(0))).first()
        if bad:
            raise SnapshotError(f"{bad} entries have impossible names")
        # Neighbours in order share most trigrams, so that a task sends a few rows for each block.
        per_block = written.select(F.shiftright("entry_id", BLOCK_BITS).alias("block"), F.explode(trigrams(component)).alias("gram")).distinct()
        per_block.select("gram", "block").orderBy("gram", "block").write.option("compression", "zstd").parquet(f"{at}/grams")
        found = Manifest(FORMAT, name, self.index.root, self.index.filters, count)
        self.files.write(f"{self.path}/CURRENT.{name}", json.dumps(asdict(found)))
        self.files.move(f"{self.path}/CURRENT.{name}", f"{self.path}/CURRENT")
        for old in self.files.names(f"{self.path}/snapshots"):
            if old not in (name, before and before.snapshot) and not old.startswith("work-"):
                self.files.delete(f"{self.path}/snapshots/{old}")
        return found

    def catalog(self, index_ord: int = 0, grams: set[str] = frozenset(), scan_below: int = SCAN_BELOW) -> DataFrame:
        """index_name, index_ord, entry_id, path, name; paths stand below the root that is configured now.

        With grams, rows whose names lack one of them may be left out.
        """
        manifest = self.required()
        rows = self.entries(manifest)
        ranges = self.candidates(manifest, grams) if manifest.entry_count >= scan_below else None
        if ranges is not None:
            inside = F.lit(False)
            for low, high in ranges:
                inside = inside | F.col("entry_id").between(low, high)
            rows = rows.where(inside)
        root = self.index.root
        stem = root if root.endswith("/") else f"{root}/"
        own = F.encode(F.lit(root), "UTF-8")
        inner = F.when(F.length("rel_dir") == 0, F.col("name")).otherwise(F.concat("rel_dir", F.encode(F.lit("/"), "UTF-8"), "name"))
        is_root = (F.length("rel_dir") == 0) & (F.length("name") == 0)
        return rows.select(
            F.lit(self.index.name).alias("index_name"), F.lit(index_ord).alias("index_ord"), "entry_id",
            F.when(is_root, own).otherwise(F.concat(F.encode(F.lit(stem), "UTF-8"), inner)).alias("path"),
            F.when(is_root, raw(F.substring_index(view(own), "/", -1))).otherwise(F.col("name")).alias("name"),
        )


class _Lock:
    """One writer at a time.

    On a local file system the operating system holds the lock and releases it
    when its process ends, however it ends.  Elsewhere it is a file that only one
    can create, naming its owner; a crash leaves it behind, and a store without
    exclusive creation needs one writer by arrangement.
    """

    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.path}.lock"
        at = urlsplit(self.path)
        self.local = at.path if at.scheme in ("", "file") else None
        self.held = None

    def __enter__(self):
        if self.local is not None:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.held = os.open(self.local, os.O_RDWR | os.O_CREAT | os.O_CLOEXEC, 0o644)
            try:
                fcntl.flock(self.held, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as error:
                os.close(self.held)
                raise SnapshotError(f"{self.store.path} is being updated") from error
            return
        try:
            self.store.files.write(self.path, f"{os.uname().nodename} {os.getpid()}", overwrite=False)
        except Exception as error:
            owner = ""
            with contextlib.suppress(Exception):
                owner = f" by {self.store.files.read(self.path)}"
            raise SnapshotError(f"{self.store.path} is being updated{owner} (or {self.path} was left behind)") from error

    def __exit__(self, *_):
        if self.held is not None:
            os.close(self.held)  # the file stays: another may be waiting at it
            self.held = None
        elif self.local is None:
            self.store.files.delete(self.path)
