"""Filters on catalogs: scope, extension, kind, ignored names, exclusions, existence."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import as_view, extension, file_name, fold, folded, is_absolute, resolve, under, view
from ..sources.config import IndexConfig


def in_scope(path: Column, scope: str | bytes) -> Column:
    return under(path, resolve(scope))


def has_extension(path: Column, names: tuple[str, ...]) -> Column:
    """By the operating system's notion: `.py` has none.  All leading dots of a wanted name are dropped."""
    return F.coalesce(fold(extension(path)).isin(*{folded(as_view(x.lstrip("."))) for x in names}), F.lit(False))


def is_file(path: Column) -> Column:
    """The kind is inferred: what has an extension is a file."""
    return F.coalesce(extension(path) != "", F.lit(False))


def is_ignored(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a component equals one of the names; `.` and `..` are no components."""
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(as_view(n)) for n in names])) if names else F.lit(False)


def is_excluded(path: Column, indexes: tuple[IndexConfig, ...], with_paths: bool = True) -> Column:
    """By the filters of the index with the longest root that holds the path."""
    if not any(x.filters.exclude_paths or x.filters.exclude_files or x.filters.exclude_extensions for x in indexes):
        return F.lit(False)
    chain = None
    for x in sorted(indexes, key=lambda x: -len(os.fsencode(x.root))):
        own = F.lit(False)
        if with_paths:
            for p in x.filters.exclude_paths:
                own = own | under(path, p if is_absolute(os.fsencode(p)) else os.path.join(x.root, p))
        if x.filters.exclude_files:
            own = own | F.coalesce(fold(file_name(path)).isin(*{folded(as_view(f)) for f in x.filters.exclude_files}), F.lit(False))
        if x.filters.exclude_extensions:
            own = own | has_extension(path, x.filters.exclude_extensions)
        holds = under(path, x.root)
        chain = F.when(holds, own) if chain is None else chain.when(holds, own)
    return chain.otherwise(F.lit(False))


def existing(catalog: DataFrame) -> DataFrame:
    """Rows whose path is there now, links followed; executors must see the file system."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([os.path.exists(p) for p in b.column("path").to_pylist()], pa.bool_()))

    return catalog.mapInArrow(run, catalog.schema)


def visible(catalog: DataFrame, indexes: tuple[IndexConfig, ...] = (), scope=None, extensions=(), files=False, dirs=False, ignored=()) -> DataFrame:
    path = view("path")
    keep = ~is_excluded(path, indexes)
    if scope is not None:
        keep = keep & in_scope(path, scope)
    if extensions:
        keep = keep & has_extension(path, extensions)
    if files or dirs:
        keep = keep & (is_file(path) if files else ~is_file(path))
    return catalog.where(keep & ~is_ignored(path, tuple(ignored)))
