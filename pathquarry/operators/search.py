"""Searching catalogs.

A catalog has index_name, index_ord (place of the index in the configuration),
entry_id (order within the index), path and name, the last two BINARY.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import as_view, fold, folded, view
from ..options import SearchOptions
from ..plans import patterns
from ..plans.anchors import anchors, required_trigrams
from ..plans.compile import name_filter, predicate
from ..plans.syntax import parse
from ..sources.config import Config, IndexConfig
from ..sources.snapshot import Store
from . import filters


def union(catalogs: list[DataFrame]) -> DataFrame:
    """All rows of all indexes: a path that two indexes hold stays twice."""
    return reduce(lambda a, b: a.unionByName(b), catalogs)


def matches(catalog: DataFrame, options: SearchOptions, indexes: tuple[IndexConfig, ...] = ()) -> DataFrame:
    """Rows that match, with their branch; nothing is ordered or cut."""
    name, path = view("name"), view("path")
    if options.regex:
        target = path if options.whole_path else name
        tests = [patterns.regex(target, os.fsencode(p), not options.case_sensitive) for p in options.patterns]
        found = catalog.where(reduce(lambda a, b: a & b, tests)).withColumn("branch", F.lit(0))
        once = False
    else:
        node = parse(list(options.patterns), options.case_sensitive, options.whole_path)
        early = name_filter(node, name)
        found = catalog if early is None else catalog.where(early)
        found = found.where(predicate(node, name, path))
        starts = anchors(node)
        branch = F.lit(0)
        if len(starts) > 1:
            holds = [fold(name if a.by_name else path).contains(folded(as_view(a.text))) for a in starts]
            branch = F.coalesce(*[F.when(h, F.lit(k)) for k, h in enumerate(holds)], F.lit(len(starts)))
        found = found.withColumn("branch", branch)
        once = len(starts) > 1
    found = filters.visible(found, indexes, options.scope, options.extensions, options.files, options.dirs, options.ignored)
    if once:  # a path that several branches or indexes give is given where it came first
        order = Window.partitionBy("path").orderBy("branch", "index_ord", "entry_id")
        found = found.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return filters.existing(found) if options.existing else found


def page(found: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice of the rows in order of branch, index and entry; with a limit Spark keeps only that many rows of each task.  All rows need no order."""
    if not offset and limit is None:
        return found
    ordered = found.orderBy("branch", "index_ord", "entry_id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit) if limit is not None else ordered


def search_catalog(catalog: DataFrame, options: SearchOptions, indexes: tuple[IndexConfig, ...] = ()) -> DataFrame:
    return page(matches(catalog, options, indexes), options.offset, options.limit).select("path")


def name_grams(options: SearchOptions) -> set[str]:
    """Trigrams that the names of all matches hold."""
    return set() if options.regex else required_trigrams(parse(list(options.patterns), options.case_sensitive, options.whole_path), by_name=True)


def catalogs(spark: SparkSession, config: Config, names: tuple[str, ...] = (), grams: set[str] = frozenset()) -> tuple[DataFrame, tuple[IndexConfig, ...]]:
    chosen = config.select(names)
    order = {x.name: k for k, x in enumerate(config.indexes)}
    return union([Store(spark, x).catalog(order[x.name], grams) for x in chosen]), chosen


def search(spark: SparkSession, config: Config, options: SearchOptions) -> DataFrame:
    """The paths that match, BINARY; in order if there is an offset or a limit."""
    catalog, chosen = catalogs(spark, config.for_search(), options.indexes, name_grams(options))
    return search_catalog(catalog, options, chosen)
