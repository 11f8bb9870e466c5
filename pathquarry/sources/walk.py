"""Reading directory trees level by level, each level a distributed listing.

Links are recorded and never followed, but the root may be one.  Executors must
see the tree, as a shared mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import comparable, is_absolute
from .config import Filters

#: Entries of a batch that a listing gives.
ROWS = 10_000
LISTED = "rel_path binary, stamp binary, state string, name binary, is_dir boolean"


def stamp(path: bytes, follow: bool = False) -> bytes:
    """Device, inode and whole seconds of the last changes."""
    s = os.stat(path, follow_symlinks=follow)
    return struct.pack("<4Q", s.st_dev, s.st_ino, int(s.st_mtime) & (1 << 64) - 1, int(s.st_ctime) & (1 << 64) - 1)


def _full(root: bytes, rel: bytes) -> bytes:
    return os.path.join(root, rel) if rel else root


def is_directory(path: bytes, follow: bool = False) -> bool:
    import stat

    return stat.S_ISDIR(os.stat(path, follow_symlinks=follow).st_mode)


class Rules:
    """What a build leaves out; paths may be absolute or below the root."""

    def __init__(self, root: str, filters: Filters, own: tuple[str, ...] = ()):
        root_key = comparable(os.fsencode(root))
        self.dirs = {os.fsencode(d) for d in filters.exclude_dirs}
        self.paths = set()
        for p in (*filters.exclude_paths, *own):
            key = comparable(os.fsencode(p) if is_absolute(os.fsencode(p)) else os.path.join(root_key, os.fsencode(p)))
            if key.startswith(root_key.removesuffix(b"/") + b"/"):
                self.paths.add(key[len(root_key.removesuffix(b"/")) + 1 :])
        self.files = {f.lower() for f in filters.exclude_files}
        self.extensions = {e.lstrip(".").lower() for e in filters.exclude_extensions}

    def drops(self, rel: bytes, name: bytes, is_dir: bool) -> bool:
        return (is_dir and name in self.dirs) or rel in self.paths

    def drops_below(self, rel: bytes) -> bool:
        """Whether a stored path lies at or below something left out."""
        parts = rel.split(b"/") if rel else []
        return any(p in self.dirs for p in parts) or any(b"/".join(parts[: i + 1]) in self.paths for i in range(len(parts)))


def listing(root: str, rules: Rules, known: bool = False):
    """For mapInArrow over rel_path: a row for each entry, and a row of state alone for each directory."""
    top = os.fsencode(root)

    def rows(rel: bytes) -> Iterator[tuple]:
        path, follow = _full(top, rel), rel == b""
        try:
            if not is_directory(path, follow):
                yield rel, None, "gone", None, None
                return
            before = stamp(path, follow)
            with os.scandir(path) as items:
                found = sorted((x.name, x.is_dir(follow_symlinks=False)) for x in items)
            if stamp(path, follow) != before:
                yield rel, None, "changing", None, None
                return
        except (FileNotFoundError, NotADirectoryError):
            yield rel, None, "gone", None, None
            return
        except OSError:
            yield rel, None, "unreadable", None, None
            return
        yield rel, before, "read", None, None
        for name, is_dir in found:
            inner = os.path.join(rel, name) if rel else name
            if not rules.drops(inner, name, is_dir):
                yield rel, before, "entry", name, is_dir

    def run(batches):
        for b in batches:
            found = (r for rel in b.column("rel_path").to_pylist() for r in rows(rel))
            while part := list(islice(found, ROWS)):
                columns = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.bool_()), strict=True)], ["rel_path", "stamp", "state", "name", "is_dir"])

    return run


def below(rel: str = "rel_path", name: str = "name"):
    return F.when(F.length(rel) == 0, F.col(name)).otherwise(F.concat(rel, F.encode(F.lit("/"), "UTF-8"), name))


def walk(spark: SparkSession, root: str, rules: Rules, frontier: DataFrame, scratch, jobs: int = 8) -> DataFrame:
    """Listings (see LISTED) of the directories in frontier and all below; scratch(df) writes a table and reads it again."""
    levels = []
    while True:
        level = scratch(frontier.select("rel_path").repartition(jobs).mapInArrow(listing(root, rules), LISTED))
        levels.append(level)
        frontier = level.where("state = 'entry' and is_dir").select(below().alias("rel_path"))
        if frontier.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
