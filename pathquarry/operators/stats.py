"""Directories ranked by the entries they hold, directly or in all levels below."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, comparable, is_root, parent, raw, resolve_user, view
from ..options import StatsOptions
from ..sources.config import Config
from ..sources.snapshot import Files, SnapshotError, Store
from . import filters
from .search import union


def direct_counts(paths: DataFrame) -> DataFrame:
    """dir (text view) and direct: how many paths have it as parent."""
    return paths.select(parent(view("path")).alias("dir")).where("dir is not null").groupBy("dir").agg(F.count("*").alias("direct"))


def roll_up(direct: DataFrame) -> DataFrame:
    """dir, direct, recursive.  Only directories are spread over their ancestors, weighted by their counts; the root has no recursive count."""
    above = F.when(is_root(F.col("dir")), F.array("dir")).otherwise(ancestors(F.col("dir")))
    spread = direct.select(F.col("dir").alias("own"), F.col("direct").alias("n"), F.explode(above).alias("dir"))
    own, below = F.when(F.col("dir") == F.col("own"), F.col("n")), F.when(~is_root(F.col("own")), F.col("n"))
    return spread.groupBy("dir").agg(F.coalesce(F.sum(own), F.lit(0)).alias("direct"), F.coalesce(F.sum(below), F.lit(0)).alias("recursive"))


def count_directories(paths: DataFrame, distinct: bool = False) -> DataFrame:
    """distinct: a path that several indexes hold counts once."""
    paths = paths.select("path")
    return roll_up(direct_counts(paths.distinct() if distinct else paths))


def ranked(counts: DataFrame, scope: bytes | None = None, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """dir and n, most first, then by bytes.

    Without a scope, recursive counts equal to the largest are left out: the
    chain of directories that hold everything says nothing.
    """
    kind = "recursive" if recursive else "direct"
    found = counts.where(F.col(kind) > 0)
    key = comparable(scope) if scope is not None else None
    if key is not None and key.strip(b"/"):
        text = key.decode("latin-1")
        found = found.where((F.col("dir") == text) | F.col("dir").startswith(f"{text}/"))
    elif recursive:
        largest = counts.agg(F.max("recursive").alias("largest"))  # one row
        found = found.crossJoin(F.broadcast(largest)).where("recursive < largest")
    found = found.select(raw(F.col("dir")).alias("dir"), F.col(kind).alias("n")).orderBy(F.desc("n"), "dir")
    return found if limit is None else found.limit(limit)


def total(paths: DataFrame, counts: DataFrame, scope: bytes | None = None, distinct: bool = False) -> int:
    """All paths, or what lies below the scope (not the scope itself), whatever the ranking counts."""
    if scope is None or not comparable(scope).strip(b"/"):
        paths = paths.select("path")
        return (paths.distinct() if distinct else paths).count()
    row = counts.where(F.col("dir") == comparable(scope).decode("latin-1")).select("recursive").first()
    return row.recursive if row else 0


def from_snapshot(store: Store, index_ord: int = 0) -> DataFrame:
    """Counts of one index from the directories of its entries, without building a path for each.

    Entries that lie in no directory of the snapshot, or a number of entries that
    is not the one it was published with, are errors.
    """
    manifest = store.required()
    rows = store.entries(manifest)
    held, homes = rows.count(), rows.where(F.length("name") > 0).select("rel_dir").distinct()
    if held != manifest.entry_count:
        raise SnapshotError(f"{store.path} holds {held} entries, not {manifest.entry_count}")
    stray = homes.join(store.directories(manifest).select(F.col("rel_path").alias("rel_dir")), "rel_dir", "left_anti").first()
    if stray:
        raise SnapshotError(f"{store.path} has entries in {bytes(stray.rel_dir)!r}, which it does not list")
    root = store.index.root.rstrip("/") or "/"
    per = rows.where(F.length("name") > 0).groupBy("rel_dir").agg(F.count("*").alias("direct"))
    stem = "" if root == "/" else root
    rel = view("rel_dir")
    stem = stem.encode().decode("latin-1")
    own = per.select(F.when(rel == "", F.lit(stem or "/")).otherwise(F.concat(F.lit(f"{stem}/"), rel)).alias("dir"), "direct")
    top = store.spark.range(1).select(parent(F.lit(root.encode().decode("latin-1"))).alias("dir"), F.lit(1).cast("long").alias("direct")).where("dir is not null")
    return roll_up(own.unionByName(top).groupBy("dir").agg(F.sum("direct").alias("direct")))


class Cache:
    """Counts kept by selection (names of indexes), valid for the snapshots and filters they were made from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _short(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def get(self, selection: list[str], fingerprint: str, make) -> DataFrame:
        files, at = Files(self.spark), f"{self.path}/{self._short(json.dumps(selection))}"
        known = json.loads(files.read(f"{at}/KEY")) if files.exists(f"{at}/KEY") else None
        name = self._short(fingerprint)
        if known is None or known["counts"] != name:
            make().write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{name}")
            files.write(f"{at}/KEY", json.dumps({"selection": selection, "counts": name}))
            for old in files.names(at):
                if old not in (name, "KEY"):
                    files.delete(f"{at}/{old}")
        return self.spark.read.parquet(f"{at}/{name}")

    def purge(self, names: set[str]) -> int:
        """Remove counts of selections with an index that is not among the names, and what has no key; how many."""
        files, gone = Files(self.spark), 0
        for at in files.names(self.path):
            key = f"{self.path}/{at}/KEY"
            if not files.exists(key) or not names.issuperset(json.loads(files.read(key))["selection"]):
                files.delete(f"{self.path}/{at}")
                gone += 1
        return gone


def stats(spark: SparkSession, config: Config, options: StatsOptions = StatsOptions(), cache: str | None = None) -> tuple[DataFrame, int]:
    """Ranked directories and the total.  The ignore list does not apply."""
    config = config.for_search()
    chosen = config.select(options.indexes)
    order = {x.name: k for k, x in enumerate(config.indexes)}
    stores = [Store(spark, x) for x in chosen]
    scope = resolve_user(options.scope) if options.scope is not None else None
    distinct = len(chosen) > 1
    plain = not distinct and not chosen[0].filters.exclude_extensions and not chosen[0].filters.exclude_files
    again = options.reapply_exclude_paths
    alone = plain and not (again and chosen[0].filters.exclude_paths)
    paths = union([s.catalog(order[s.index.name]) for s in stores])
    if not alone:
        paths = paths.where(~filters.is_excluded(view("path"), chosen, with_paths=again is not False))

    def make() -> DataFrame:
        return from_snapshot(stores[0]) if alone else count_directories(paths, distinct)

    fingerprint = lambda: json.dumps([[x.name, x.root, repr(x.filters), s.required().snapshot] for x, s in zip(chosen, stores, strict=True)] + [again])
    before = fingerprint()
    if cache:
        kept = Cache(spark, cache)
        counts = kept.get([x.name for x in chosen], before, make)
        kept.purge({x.name for x in config.indexes})
    else:
        counts = make()
    found = ranked(counts, scope, options.recursive, options.limit), total(paths, counts, scope, distinct)
    if fingerprint() != before:
        raise RuntimeError("an index changed while its statistics were read")
    return found
