"""Registered queries over a path catalog derived from `documents`, each with SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, extension, fold, last_suffix, parent, raw, trigram_key, trigrams, under, view
from ..operators import filters, output, postings, refresh, stats
from ..operators.search import matches, name_grams, search_catalog, union
from ..options import SearchOptions
from ..sources.config import Config, Filters, IndexConfig
from ..sources.snapshot import Store

KINDS, SUFFIXES = ("soil", "Rain", "ERA5", "report"), (".nc", ".TIF", ".csv", ".tar.gz", "")

PATHS = """SELECT doc_id AS entry_id, '/data/' || source || '/' || lang || '/' || (CASE doc_id % 4 WHEN 0 THEN 'soil' WHEN 1 THEN 'Rain' WHEN 2 THEN 'ERA5' ELSE 'report' END)
 || '_station_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || (CASE doc_id % 5 WHEN 0 THEN '.nc' WHEN 1 THEN '.TIF' WHEN 2 THEN '.csv' WHEN 3 THEN '.tar.gz' ELSE '' END) AS path FROM documents"""
CATALOG = f"WITH p AS ({PATHS}), c AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)"


def catalog(spark: SparkSession, sf_dir: str, index_name: str = "docs", index_ord: int = 0) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(len(values))) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), pick(KINDS), F.lit("_station_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), pick(SUFFIXES))
    d = d.select(F.lit(index_name).alias("index_name"), F.lit(index_ord).alias("index_ord"), F.col("doc_id").alias("entry_id"), F.encode(path, "UTF-8").alias("path"))
    return d.withColumn("name", raw(basename(view("path"))))


def _text(found: DataFrame) -> DataFrame:
    return found.select(F.decode("path", "UTF-8").alias("path"))


def _search(*patterns: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _text(matches(catalog(spark, sf_dir), SearchOptions(patterns, **options)))


def _where(condition: str) -> str:
    return f"{CATALOG} SELECT path FROM c WHERE {condition}"


LOW, EXT = "lower(name)", "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) END"

#: name -> (query, SQL)
SEARCHES = {
    "term_ci": (_search("soil"), _where(f"contains({LOW}, 'soil')")),
    "term_cs": (_search("Rain", case_sensitive=True), _where("contains(name, 'Rain')")),
    "term_path": (_search("path:src1"), _where("contains(lower(path), 'src1')")),
    "term_with_slash": (_search("en/soil"), _where("contains(lower(path), 'en/soil')")),
    "glob_prefix": (_search("rain*"), _where(f"starts_with({LOW}, 'rain')")),
    "glob_suffix": (_search("*.nc"), _where(f"ends_with({LOW}, '.nc')")),
    "glob_contains": (_search("*station_00001*"), _where(f"contains({LOW}, 'station_00001')")),
    "glob_inner": (_search("era5*2.csv"), _where(f"regexp_full_match({LOW}, 'era5.*2\\.csv')")),
    "glob_class": (_search("*[0-4].[ct]*"), _where(f"regexp_full_match({LOW}, '.*[0-4]\\.[ct].*')")),
    "glob_class_negated": (_search("soil*[^0-4].*"), _where(f"regexp_full_match({LOW}, 'soil.*[^0-4]\\..*')")),
    "glob_qmark": (_search("????_station_00000??.*"), _where(f"regexp_full_match({LOW}, '...._station_00000..\\..*')")),
    "glob_all": (_search("*"), _where("true")),
    "regex_name": (_search(r"^(soil|rain)_.*\d{3}\.(nc|csv)$", regex=True), _where(f"regexp_matches({LOW}, '^(soil|rain)_.*\\d{{3}}\\.(nc|csv)$')")),
    "regex_path": (_search(r"/src1\d/", "tif$", regex=True, whole_path=True), _where("regexp_matches(lower(path), '/src1\\d/') AND regexp_matches(lower(path), 'tif$')")),
    "regex_term": (_search(r"regex:^era5_.*6\.", "!csv"), _where(f"regexp_matches({LOW}, '^era5_.*6\\.') AND NOT contains({LOW}, 'csv')")),
    "expr_and": (_search("soil station"), _where(f"contains({LOW}, 'soil') AND contains({LOW}, 'station')")),
    "expr_or": (_search("soil | rain"), _where(f"contains({LOW}, 'soil') OR contains({LOW}, 'rain')")),
    "expr_not": (_search("station !soil"), _where(f"contains({LOW}, 'station') AND NOT contains({LOW}, 'soil')")),
    "expr_group": (_search("<soil | rain> exts:nc,tif !path:src1"), _where(f"(contains({LOW}, 'soil') OR contains({LOW}, 'rain')) AND regexp_matches({LOW}, '\\.(nc|tif)$') AND NOT contains(lower(path), 'src1')")),
    "expr_quoted": (_search('"soil_station" | "ext:nc"'), _where(f"contains({LOW}, 'soil_station') OR contains({LOW}, 'ext:nc')")),
    "exts_expr": (_search("ext:.nc;gz"), _where(f"regexp_matches({LOW}, '\\.(nc|gz)$')")),
    "exts_option": (_search("*", extensions=("TIF", ".csv")), _where(f"{EXT} IN ('tif', 'csv')")),
    "kind_files": (_search("*", files=True), _where(f"coalesce({EXT}, '') <> ''")),
    "kind_dirs": (_search("*", dirs=True), _where(f"coalesce({EXT}, '') = ''")),
    "scope_path": (_search("*", scope="/data/src1"), _where("path = '/data/src1' OR starts_with(path, '/data/src1/')")),
    "ignore_dirs": (_search("*", ignored=("de", "src3")), _where("NOT list_has_any(string_split(path, '/'), ['de', 'src3'])")),
}


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes that overlap in src1 and its like."""
    a, b = catalog(spark, sf_dir, "a", 0), catalog(spark, sf_dir, "b", 1)
    return union([a.where(view("path").startswith("/data/src1")), b.where(view("path").contains("/en/"))])


_TWO = f"{CATALOG}, u AS (SELECT 0 AS i, * FROM c WHERE starts_with(path, '/data/src1') UNION ALL SELECT 1 AS i, * FROM c WHERE contains(path, '/en/'))"
_OWNERS = (
    IndexConfig("outer", "/data", "/x/a", Filters(exclude_extensions=("nc",), exclude_paths=("src2",), exclude_files=("Rain_station_0000005.NC",))),
    IndexConfig("inner", "/data/src1", "/x/b", Filters(exclude_paths=("fr",))),
)


def union_indexes(spark, sf_dir):
    return _text(matches(_two(spark, sf_dir), SearchOptions(("station",))))


def or_dedup(spark, sf_dir):
    return _text(matches(_two(spark, sf_dir), SearchOptions(("soil | rain",))))


def page_offset_limit(spark, sf_dir):
    return _text(search_catalog(_two(spark, sf_dir), SearchOptions(("rain | soil",), offset=7, limit=25)))


def index_select(spark, sf_dir):
    config = Config((IndexConfig("a", "/data", "/x/a"), IndexConfig("b", "/data", "/x/b")))
    chosen = [x.name for x in config.select(("b", "b"))]
    return _text(matches(_two(spark, sf_dir).where(F.col("index_name").isin(chosen)), SearchOptions(("soil",))))


def json_rows(spark, sf_dir):
    found = matches(catalog(spark, sf_dir), SearchOptions(("rain",)))
    return output.json_rows(found).select(F.get_json_object("json", "$.path").alias("path"))


_stores: dict[tuple[str, str], Store] = {}


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """The derived paths as a published snapshot, once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='pathquarry-')}"
        store = Store(spark, IndexConfig("docs", "/data", f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"))
        p = view("path")
        files = catalog(spark, sf_dir).select(F.substring_index(F.substring(p, F.lit(7), F.length(p)), "/", 2).alias("rel"), view("name").alias("name"))
        dirs = files.select(F.explode(F.array(F.struct(F.lit("").alias("rel"), F.substring_index("rel", "/", 1).alias("name")), F.struct(F.substring_index("rel", "/", 1).alias("rel"), F.substring_index("rel", "/", -1).alias("name")))).alias("x")).select("x.*").distinct()
        top = spark.range(1).select(F.lit("").alias("rel"), F.lit("").alias("name"))
        entries = files.withColumn("is_dir", F.lit(False)).unionByName(dirs.unionByName(top).withColumn("is_dir", F.lit(True)))
        known = dirs.select(F.when(F.col("rel") == "", F.col("name")).otherwise(F.concat_ws("/", "rel", "name")).alias("rel_path")).unionByName(top.select(F.col("rel").alias("rel_path")))
        store.publish(entries.select(raw(F.col("rel")).alias("rel_dir"), raw(F.col("name")).alias("name"), "is_dir"), known.select(raw(F.col("rel_path")).alias("rel_path"), F.lit(b"0").alias("stamp")))
        _stores[key] = store
    return _stores[key]


def store_catalog(spark, sf_dir):
    return _store(spark, sf_dir).catalog().select(F.decode("path", "UTF-8").alias("path"), F.decode("name", "UTF-8").alias("name"))


def store_search(spark, sf_dir):
    """By the stored trigrams, whatever the size."""
    options = SearchOptions(("station_00001 ext:csv",))
    return _text(search_catalog(_store(spark, sf_dir).catalog(grams=name_grams(options), scan_below=0), options))


def store_stats(spark, sf_dir):
    return stats.from_snapshot(_store(spark, sf_dir)).where("recursive > 0").select("dir", "direct", "recursive")


def store_total(spark, sf_dir):
    store = _store(spark, sf_dir)
    counts = stats.from_snapshot(store)
    return spark.range(1).select(F.lit(stats.total(store.catalog(), counts)).alias("all_paths"), F.lit(stats.total(store.catalog(), counts, b"/data/src1")).alias("below"))


def exclusions_owner(spark, sf_dir):
    return _text(filters.visible(catalog(spark, sf_dir), _OWNERS))


def _counts(spark, sf_dir):
    return stats.count_directories(catalog(spark, sf_dir))


def _dirs(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(F.decode("dir", "UTF-8").alias("dir"), *columns)


def dir_direct(spark, sf_dir):
    return stats.direct_counts(catalog(spark, sf_dir)).select("dir", F.col("direct").alias("n"))


def dir_recursive(spark, sf_dir):
    return _counts(spark, sf_dir).where("recursive > 0").select("dir", "direct", "recursive")


def dir_top(spark, sf_dir):
    return _dirs(stats.ranked(_counts(spark, sf_dir), None, True, 10), "n")


def dir_top_scoped(spark, sf_dir):
    return _dirs(stats.ranked(_counts(spark, sf_dir), b"/data/src1", True, 10), "n")


def dir_top_direct(spark, sf_dir):
    return _dirs(stats.ranked(_counts(spark, sf_dir), None, False, 10), "n")


def dir_union_distinct(spark, sf_dir):
    return stats.count_directories(_two(spark, sf_dir), distinct=True).where("recursive > 0").select("dir", "direct", "recursive")


def total_scoped(spark, sf_dir):
    return spark.range(1).select(F.lit(stats.total(catalog(spark, sf_dir), _counts(spark, sf_dir), b"/data/src1")).alias("total"))


def trigram_table(spark, sf_dir):
    return postings.build(catalog(spark, sf_dir)).select("entry_id", trigram_key(F.col("gram")).alias("gram"))


def posting_counts(spark, sf_dir):
    return postings.frequencies(postings.build(catalog(spark, sf_dir)))


def posting_search(spark, sf_dir):
    options = SearchOptions(("era5 ext:csv path:src2",))
    return _text(search_catalog(_store(spark, sf_dir).catalog(grams=name_grams(options), scan_below=0), options))


def posting_entries(spark, sf_dir):
    """The entry-level filter, over postings made on the spot."""
    c = catalog(spark, sf_dir)
    return _text(postings.search(c, postings.build(c), SearchOptions(("era5 ext:csv path:src2",))))


def path_parts(spark, sf_dir):
    p = view("path")
    return catalog(spark, sf_dir).select("entry_id", basename(p).alias("name"), last_suffix(basename(p)).alias("suffix"), extension(p).alias("extension"), parent(p).alias("dir"), F.size(ancestors(parent(p))).alias("depth"), fold(basename(p)).alias("folded"))


def url_match(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    c = pages.select(F.lit("pages").alias("index_name"), F.lit(0).alias("index_ord"), F.col("page_id").alias("entry_id"), F.encode("url", "UTF-8").alias("path"))
    return _text(matches(c.withColumn("name", raw(basename(view("path")))), SearchOptions(("path:example.com !ref= !*.html",))))


def part_quoted(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = part.select(F.lit("part").alias("index_name"), F.lit(0).alias("index_ord"), F.col("p_partkey").alias("entry_id"), F.encode("p_name", "UTF-8").alias("path"))
    return matches(c.withColumn("name", F.col("path")), SearchOptions(('"small widget"',))).select(F.col("entry_id").alias("p_partkey"))


def _tree(spark, sf_dir, late: bool) -> DataFrame:
    """A derived directory table: stamps change with the year of the newest order that a part of the documents would have."""
    dirs = catalog(spark, sf_dir).groupBy(parent(view("path")).alias("rel_path")).agg(F.count("*").alias("n"), F.max("entry_id").alias("m"))
    stamp = F.concat("n", F.lit(":"), F.when((F.col("m") % 3 == 0) & F.lit(late), "b").otherwise("a"))
    return dirs.where((F.col("m") % 7 != 1) if late else (F.col("m") % 5 != 1)).select("rel_path", stamp.alias("stamp"))


def snapshot_diff(spark, sf_dir):
    return refresh.difference(_tree(spark, sf_dir, False), _tree(spark, sf_dir, True))


def subtree_replace(spark, sf_dir):
    c = catalog(spark, sf_dir).select("path")
    new = c.where(~view("path").endswith(".nc"))
    return _text(refresh.replace_subtree(c, new, "/data/src1"))


def exclusion_prune(spark, sf_dir):
    from ..sources.walk import Rules

    c = catalog(spark, sf_dir).select(raw(F.substring(parent(view("path")), F.lit(7), F.length(view("path")))).alias("rel_dir"), "name", F.lit(False).alias("is_dir"))
    empty = c.select(F.col("rel_dir").alias("rel_path"), F.col("rel_dir").alias("stamp")).limit(0)
    kept, _ = refresh.prune(c, empty, "/data", Rules("/data", Filters(exclude_dirs=("de",), exclude_paths=("src4", "/data/src5/en"))))
    return kept.select(F.concat(F.lit("/data/"), view("rel_dir"), F.lit("/"), view("name")).alias("path"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(matches(catalog(spark, sf_dir), SearchOptions(("<soil | rain> exts:nc,tif !backup",))))


_SPREAD = "d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM {src} GROUP BY 1), a AS (SELECT '/' || array_to_string(list_slice(string_split(dir, '/'), 2, i + 1), '/') AS dir, n, CASE WHEN i + 1 = len(string_split(dir, '/')) THEN n ELSE 0 END AS own FROM (SELECT dir, n, unnest(range(1, len(string_split(dir, '/')))) AS i FROM d)), r AS (SELECT dir, CAST(sum(own) AS BIGINT) AS direct, CAST(sum(n) AS BIGINT) AS recursive FROM a GROUP BY dir)"
_R = f"{CATALOG}, {_SPREAD.format(src='c')}"
_TREE = "(SELECT dir AS rel_path, count(*) || ':' || CASE WHEN max(entry_id) % 3 = 0 AND {late} THEN 'b' ELSE 'a' END AS stamp, max(entry_id) AS m FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM c) GROUP BY dir HAVING max(entry_id) % {k} <> 1)"
_GRAMS = f"{CATALOG}, g AS (SELECT DISTINCT entry_id, substring(lower(path), i, 3) AS gram FROM (SELECT entry_id, path, unnest(range(1, length(path) - 1)) AS i FROM c))"

#: The files, their directories and the root.
_ALL = f"{CATALOG}, e AS (SELECT path FROM c UNION ALL SELECT DISTINCT regexp_extract(path, '^(/[^/]*/[^/]*/[^/]*)/', 1) AS path FROM c UNION ALL SELECT DISTINCT regexp_extract(path, '^(/[^/]*/[^/]*)/', 1) FROM c UNION ALL SELECT '/data')"

OTHERS = {
    "union_indexes": (union_indexes, f"{_TWO} SELECT path FROM u WHERE contains({LOW}, 'station')"),
    "or_dedup": (or_dedup, f"{_TWO} SELECT DISTINCT path FROM u WHERE contains({LOW}, 'soil') OR contains({LOW}, 'rain')"),
    "page_offset_limit": (page_offset_limit, f"{_TWO} SELECT path FROM (SELECT path, min(CASE WHEN contains({LOW}, 'rain') THEN 0 ELSE 1 END) AS b, min(i) AS i, min(entry_id) AS e FROM u WHERE contains({LOW}, 'soil') OR contains({LOW}, 'rain') GROUP BY path) ORDER BY b, i, e LIMIT 25 OFFSET 7"),
    "index_select": (index_select, f"{_TWO} SELECT path FROM u WHERE i = 1 AND contains({LOW}, 'soil')"),
    "exclusions_owner": (exclusions_owner, f"{CATALOG} SELECT path FROM c WHERE NOT (CASE WHEN starts_with(path, '/data/src1/') THEN starts_with(path, '/data/src1/fr/') ELSE starts_with(path, '/data/src2/') OR {LOW} = 'rain_station_0000005.nc' OR ends_with({LOW}, '.nc') END)"),
    "dir_direct": (dir_direct, f"{CATALOG} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM c GROUP BY 1"),
    "dir_recursive": (dir_recursive, f"{_R} SELECT dir, direct, recursive FROM r"),
    "dir_top": (dir_top, f"{_R} SELECT dir, recursive AS n FROM r WHERE recursive < (SELECT max(recursive) FROM r) ORDER BY n DESC, dir LIMIT 10"),
    "dir_top_scoped": (dir_top_scoped, f"{_R} SELECT dir, recursive AS n FROM r WHERE dir = '/data/src1' OR starts_with(dir, '/data/src1/') ORDER BY n DESC, dir LIMIT 10"),
    "dir_top_direct": (dir_top_direct, f"{_R} SELECT dir, direct AS n FROM r WHERE direct > 0 ORDER BY n DESC, dir LIMIT 10"),
    "dir_union_distinct": (dir_union_distinct, f"{_TWO}, x AS (SELECT DISTINCT path FROM u), {_SPREAD.format(src='x')} SELECT dir, direct, recursive FROM r"),
    "total_scoped": (total_scoped, f"{CATALOG} SELECT count(*) AS total FROM c WHERE starts_with(path, '/data/src1/')"),
    "trigrams": (trigram_table, f"{_GRAMS} SELECT entry_id, CAST(ascii(gram[1]) * 65536 + ascii(gram[2]) * 256 + ascii(gram[3]) AS INTEGER) AS gram FROM g"),
    "posting_counts": (posting_counts, f"{_GRAMS} SELECT gram, count(*) AS n FROM g GROUP BY gram"),
    "json_rows": (json_rows, _where(f"contains({LOW}, 'rain')")),
    "store_catalog": (store_catalog, f"{_ALL} SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM e"),
    "store_search": (store_search, _where(f"contains({LOW}, 'station_00001') AND ends_with({LOW}, '.csv')")),
    "store_stats": (store_stats, f"{_ALL}, {_SPREAD.format(src='e')} SELECT dir, direct, recursive FROM r WHERE dir <> '/'"),
    "store_total": (store_total, f"{_ALL} SELECT (SELECT count(*) FROM e) AS all_paths, (SELECT count(*) FROM e WHERE starts_with(path, '/data/src1/')) AS below"),
    "posting_entries": (posting_entries, _where(f"contains({LOW}, 'era5') AND ends_with({LOW}, '.csv') AND contains(lower(path), 'src2')")),
    "posting_search": (posting_search, _where(f"contains({LOW}, 'era5') AND ends_with({LOW}, '.csv') AND contains(lower(path), 'src2')")),
    "path_parts": (path_parts, f"{CATALOG} SELECT entry_id, name, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) END AS suffix, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '\\.([^.]*)$', 1) END AS extension, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CAST(len(string_split(path, '/')) - 2 AS INTEGER) AS depth, lower(name) AS folded FROM c"),
    "url_match": (url_match, "SELECT url AS path FROM (SELECT url, lower(regexp_extract(url, '([^/]*)$', 1)) AS n FROM pages) WHERE contains(lower(url), 'example.com') AND NOT contains(n, 'ref=') AND NOT ends_with(n, '.html')"),
    "part_quoted": (part_quoted, "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small widget')"),
    "regex_nested": (_search(r"^(soil|(ra+i)+n)+_(s?t?a?)+tion_(\d+)+\.", regex=True), _where(f"regexp_matches({LOW}, '^(soil|(ra+i)+n)+_(s?t?a?)+tion_(\\d+)+\\.')")),
    "snapshot_diff": (snapshot_diff, f"{CATALOG} SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN n.stamp IS NULL THEN 'gone' WHEN o.stamp IS NULL THEN 'new' WHEN o.stamp = n.stamp THEN 'same' ELSE 'changed' END AS state FROM {_TREE.format(late='false', k=5)} o FULL OUTER JOIN {_TREE.format(late='true', k=7)} n ON o.rel_path = n.rel_path"),
    "subtree_replace": (subtree_replace, _where("NOT (starts_with(path, '/data/src1/') AND ends_with(path, '.nc'))").replace("SELECT path FROM c", "SELECT DISTINCT path FROM c")),
    "exclusion_prune": (exclusion_prune, _where("NOT (contains(path, '/de/') OR starts_with(path, '/data/src4/') OR starts_with(path, '/data/src5/en/'))")),
    "flagship": (flagship, _where(f"(contains({LOW}, 'soil') OR contains({LOW}, 'rain')) AND regexp_matches({LOW}, '\\.(nc|tif)$') AND NOT contains({LOW}, 'backup')")),
}

ALL = SEARCHES | OTHERS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}


__all__ = ["ALL", "catalog", "flagship", "oracle_sql", "queries", "trigrams", "under"]
