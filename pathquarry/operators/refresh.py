"""Building snapshots and refreshing them where directories changed."""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import resolve, under, view
from ..options import RefreshReport
from ..sources.config import Config, Filters, IndexConfig
from ..sources.snapshot import DIRECTORIES, ENTRIES, SnapshotError, Store
from ..sources.walk import Rules, _full, below, is_directory, listing, stamp, walk

MOST_JOBS = 256


class _Scratch:
    def __init__(self, store: Store):
        self.spark, self.files, self.root, self.n = store.spark, store.files, f"{store.path}/snapshots/work-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def close(self) -> None:
        self.files.delete(self.root)


def _stamps(root: str):
    """For mapInArrow over directories: how each stands now."""
    top = os.fsencode(root)

    def one(rel: bytes, old: bytes) -> str:
        path = _full(top, rel)
        try:
            if not is_directory(path, rel == b""):
                return "gone"
            if stamp(path, rel == b"") != old:
                return "changed"
            return "same"
        except (FileNotFoundError, NotADirectoryError):
            return "gone"
        except OSError:
            return "unreadable"

    def run(batches):
        for b in batches:
            states = [one(r, s) for r, s in zip(b.column("rel_path").to_pylist(), b.column("stamp").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rel_path"), b.column("stamp"), pa.array(states, pa.string())], ["rel_path", "stamp", "state"])

    return run


def _split(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries = listed.where("state = 'entry'").select(F.col("rel_path").alias("rel_dir"), "name", "is_dir")
    return entries, listed.where("state = 'read'").select("rel_path", "stamp")


def _steady(listed: DataFrame) -> None:
    moved = listed.where("state = 'changing'").select("rel_path").first()
    if moved:
        raise SnapshotError(f"directory {bytes(moved.rel_path)!r} changed while it was read; the snapshot stays as it was")


def _own(store: Store) -> tuple[str, ...]:
    return (store.path, f"{store.path}.lock")


def _root_row(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(bytearray(), bytearray(), True)], "rel_dir binary, name binary, is_dir boolean")


def build(store: Store, jobs: int = 8) -> RefreshReport:
    spark, root, scratch = store.spark, store.index.root, _Scratch(store)
    if not os.path.isdir(root):
        raise SnapshotError(f"root {root} is missing")
    try:
        start = spark.createDataFrame([(bytearray(),)], "rel_path binary")
        listed = walk(spark, root, Rules(root, store.index.filters, _own(store)), start, scratch, jobs)
        _steady(listed)
        entries, directories = _split(listed)
        if listed.where("state in ('unreadable', 'gone') and length(rel_path) = 0").first():
            raise SnapshotError(f"root {root} cannot be read")
        skipped = listed.where("state in ('unreadable', 'gone')").count()
        found = store.publish(entries.unionByName(_root_row(spark)), directories)
        return RefreshReport(found.entry_count, directories.count(), 0, skipped, True)
    finally:
        scratch.close()


def only_added(old: Filters, new: Filters) -> bool:
    return set(old.exclude_dirs) <= set(new.exclude_dirs) and set(old.exclude_paths) <= set(new.exclude_paths)


def prune(entries: DataFrame, directories: DataFrame, root: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Stored rows without what the rules leave out; files with the name of an excluded directory stay."""
    path = view(below("rel_dir"))
    gone_dir = lambda rel: (reduce(lambda a, b: a | b, [F.arrays_overlap(F.split(rel, "/", -1), F.array(*[F.lit(d.decode("latin-1")) for d in sorted(rules.dirs)]))]) if rules.dirs else F.lit(False)) | reduce(lambda a, b: a | b, [(rel == p.decode("latin-1")) | rel.startswith(p.decode("latin-1") + "/") for p in sorted(rules.paths)], F.lit(False))
    own = F.col("is_dir") & view("name").isin(*[d.decode("latin-1") for d in sorted(rules.dirs)]) if rules.dirs else F.lit(False)
    exact = reduce(lambda a, b: a | b, [(path == p.decode("latin-1")) for p in sorted(rules.paths)], F.lit(False))
    return entries.where(~(gone_dir(view("rel_dir")) | own | exact)), directories.where(~gone_dir(view("rel_path")))


def refresh(store: Store, scopes: tuple[str, ...] = (), jobs: int = 8) -> RefreshReport:
    """Read again what changed.  Without a snapshot, or after exclusions were taken back, everything is read."""
    spark, index = store.spark, store.index
    root = index.root
    before = store.manifest()
    if before is None:
        if scopes:
            raise SnapshotError(f"index {index.name} must be built before a folder of it is refreshed")
        return build(store, jobs)
    if before.root != root:
        raise SnapshotError(f"the root of {index.name} changed from {before.root} to {root}; build it anew")
    same_rules = all(set(getattr(before.filters, k)) == set(getattr(index.filters, k)) for k in ("exclude_dirs", "exclude_paths"))
    if scopes and not same_rules:
        raise SnapshotError("exclusions changed; refresh the whole index first")
    if not only_added(before.filters, index.filters):
        return build(store, jobs)
    rules, scratch = Rules(root, index.filters, _own(store)), _Scratch(store)
    try:
        entries, directories = store.entries(before).select("rel_dir", "name", "is_dir"), store.directories(before)
        pruned, parents = False, None
        if not same_rules:
            n, stored = before.entry_count, entries
            entries, directories = prune(entries, directories, root, rules)
            pruned = entries.count() != n
            if pruned:  # directories that list what is left out now are read again
                lost = stored.where("is_dir and length(name) > 0").join(entries.where("is_dir"), ["rel_dir", "name"], "left_anti")
                parents = lost.select(F.col("rel_dir").alias("rel_path")).distinct().join(directories.select("rel_path"), "rel_path", "left_semi").withColumn("listed", F.lit(True))
        inside = F.lit(True)
        if scopes:
            top = resolve(root)
            rels = []
            for s in scopes:
                full = resolve(os.path.realpath(s) if os.path.exists(s) else s)
                if not (full == top or full.startswith(top.removesuffix(b"/") + b"/")):
                    raise SnapshotError(f"{s} does not lie in {root}")
                rel = full[len(top.removesuffix(b"/")) + 1 :] if full != top else b""
                if rules.drops_below(rel):
                    raise SnapshotError(f"{s} is excluded")
                if not os.path.isdir(s):
                    raise SnapshotError(f"{s} is no directory")
                rels.append(rel)
            if b"" not in rels:
                inside = reduce(lambda a, b: a | b, [under(view("rel_path"), r, plain=True) for r in rels])
        states = scratch(directories.where(inside).repartition(jobs).mapInArrow(_stamps(root), DIRECTORIES + ", state string"))
        if parents is not None:
            again = F.when((F.col("state") == "same") & F.col("listed"), "changed").otherwise(F.col("state"))
            states = scratch(states.join(parents, "rel_path", "left").withColumn("state", again).drop("listed"))
        if states.where("state = 'gone' and length(rel_path) = 0").first():
            raise SnapshotError(f"root {root} is missing")
        changed = states.where("state = 'changed'").select("rel_path")
        listed = scratch(changed.repartition(jobs).mapInArrow(listing(root, rules), LISTED_SCHEMA))
        _steady(listed)
        kept = states.where("state in ('same', 'unreadable')").select("rel_path")
        known = states.select("rel_path")
        fresh = listed.where("state = 'entry' and is_dir").select(below().alias("rel_path")).join(known, "rel_path", "left_anti")
        # A listed directory without a row could not be read last time: it is tried again.
        lost = entries.where("is_dir and length(name) > 0").select(below("rel_dir").alias("rel_path")).join(directories.select("rel_path"), "rel_path", "left_anti")
        fresh = scratch(fresh.unionByName(lost.where(inside).join(states.where("state <> 'same'").select(F.col("rel_path")), "rel_path", "left_anti")).distinct())
        found = walk(spark, root, rules, fresh, scratch, jobs) if not fresh.isEmpty() else None
        if found is not None:
            _steady(found)
            listed = listed.unionByName(found)
        new_entries, new_directories = _split(listed)
        outside = directories.where(~inside).select("rel_path")
        reused = kept.unionByName(outside)
        whole = entries.where("length(name) > 0").join(reused.withColumnRenamed("rel_path", "rel_dir"), "rel_dir", "left_semi")
        counted = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        skipped = counted.get("unreadable", 0) + counted.get("gone", 0) + listed.where("state in ('unreadable', 'gone')").count()
        scanned = new_directories.count()
        if not scanned and not counted.get("gone") and not pruned:
            if before.filters == index.filters:
                return RefreshReport(before.entry_count, 0, counted.get("same", 0), skipped, False)
        after = store.publish(whole.unionByName(new_entries).unionByName(_root_row(spark)), directories.join(reused, "rel_path", "left_semi").unionByName(new_directories))
        return RefreshReport(after.entry_count, scanned, counted.get("same", 0), skipped, True)
    finally:
        scratch.close()


LISTED_SCHEMA = "rel_path binary, stamp binary, state string, name binary, is_dir boolean"


def update(spark: SparkSession, config: Config, names: tuple[str, ...] = (), folders: tuple[str, ...] = (), jobs: int = 8, missing_only: bool = False) -> dict[str, RefreshReport]:
    """Refresh the named indexes, or the indexes that own the folders (the one with the longest root)."""
    config = config.for_update()
    jobs = max(1, min(MOST_JOBS, jobs))
    wanted: dict[str, list[str]] = {x.name: [] for x in config.select(names)} if not folders else {}
    tops = sorted({resolve(f) for f in folders})
    tops = [t for t in tops if not any(t != o and t.startswith(o.removesuffix(b"/") + b"/") for o in tops)]
    for t in tops:
        owners = [x for x in config.select(names) if t == resolve(x.root) or t.startswith(resolve(x.root).removesuffix(b"/") + b"/")]
        if not owners:
            raise SnapshotError(f"no index holds {os.fsdecode(t)}")
        wanted.setdefault(max(owners, key=lambda x: len(x.root)).name, []).append(os.fsdecode(t))
    reports = {}
    for x in config.indexes:
        if x.name in wanted:
            store = Store(spark, x)
            if missing_only and store.manifest() is not None:
                continue
            with store.lock():
                store.sweep()
                reports[x.name] = refresh(store, tuple(wanted[x.name]), jobs)
    return reports


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path and what became of each directory of two tables (rel_path, stamp)."""
    both = old.withColumnRenamed("stamp", "was").join(new.withColumnRenamed("stamp", "now"), "rel_path", "full_outer")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return both.select("rel_path", state.alias("state"))


def replace_subtree(old: DataFrame, new: DataFrame, scope: str | bytes) -> DataFrame:
    """Rows of old outside a subtree and rows of new inside it; both have path."""
    inside = under(view("path"), scope)
    return old.where(~inside).unionByName(new.where(inside)).distinct()


__all__ = ["ENTRIES", "IndexConfig", "build", "difference", "only_added", "prune", "refresh", "replace_subtree", "update"]
