"""Trigram postings: which entries hold a three-byte string, as an optional first filter of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import trigrams, view
from ..options import SearchOptions
from ..plans.anchors import required_trigrams
from ..plans.syntax import parse
from ..sources.config import IndexConfig
from .search import page, search_catalog


def build(catalog: DataFrame) -> DataFrame:
    """gram, index_name, entry_id: one row for each distinct trigram of a path; write it bucketed or sorted by gram."""
    return catalog.select("index_name", "entry_id", F.explode(trigrams(view("path"))).alias("gram"))


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def candidates(postings: DataFrame, grams: set[str]) -> DataFrame:
    """Entries that hold all the grams; the lists meet in one aggregation that combines on the map side."""
    hit = postings.where(F.col("gram").isin(*sorted(grams)))
    return hit.groupBy("index_name", "entry_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("index_name", "entry_id")


def search(catalog: DataFrame, postings: DataFrame, options: SearchOptions, indexes: tuple[IndexConfig, ...] = ()) -> DataFrame:
    """As search_catalog; the query itself still decides."""
    grams = set() if options.regex else required_trigrams(parse(list(options.patterns), options.case_sensitive, options.whole_path))
    if grams:
        catalog = catalog.join(candidates(postings, grams), ["index_name", "entry_id"], "left_semi")
    return search_catalog(catalog, options, indexes)


__all__ = ["build", "candidates", "frequencies", "page", "search"]
