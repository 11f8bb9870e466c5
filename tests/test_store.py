import json
import multiprocessing
import os
import re
import signal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathquarry import cli
from pathquarry.functions.paths import raw, view
from pathquarry.operators import output, refresh, search, stats
from pathquarry.options import SearchOptions, StatsOptions
from pathquarry.plans import patterns
from pathquarry.plans.syntax import QueryError
from pathquarry.sources import config as configs
from pathquarry.sources import snapshot, walk
from pathquarry.sources.config import Filters, IndexConfig
from pathquarry.sources.pathlist import of_bytes
from pathquarry.sources.snapshot import SnapshotError, Store

CONFIG = 'outdir = "{out}"\n[filters]\nexclude_dirs = [{dirs}]\n[[index]]\nname = "main"\nroot = "{root}"\n'


def configured(tmp_path, dirs=""):
    return configs.parse(CONFIG.format(out=tmp_path / "db", root=tmp_path / "root", dirs=dirs))


def tree(tmp_path, *files):
    for f in files:
        at = tmp_path / "root" / f
        at.parent.mkdir(parents=True, exist_ok=True)
        at.touch()
    return tmp_path / "root"


def names(spark, config, *words):
    root = config.indexes[0].root.encode() + b"/"
    return sorted(bytes(r.path).removeprefix(root) for r in search.search(spark, config, SearchOptions(words)).collect())


def report(spark, config, **options):
    return refresh.update(spark, config, **options)["main"]


def content(path):
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs}


def test_added_directory_exclusion_reads_parents_again(spark, tmp_path):
    tree(tmp_path, "raw/deep/raw/shared.nc", "kept/deep/shared.nc", "raw-other/shared.nc", "kept/raw")
    report(spark, configured(tmp_path))
    fewer = configured(tmp_path, '"raw"')
    found = report(spark, fewer)
    assert (found.scanned, found.reused) == (1, 3)  # only the root lists an excluded directory
    assert len(names(spark, fewer, "shared.nc")) == 2 and names(spark, fewer, "raw") == [b"kept/raw", b"raw-other"]
    store = Store(spark, fewer.indexes[0])
    assert store.directories(store.required()).count() == 4
    assert report(spark, fewer).scanned == 0
    report(spark, configured(tmp_path))  # an exclusion taken back
    assert len(names(spark, fewer, "shared.nc")) == 3


def test_exclusion_that_matches_nothing(spark, tmp_path):
    tree(tmp_path, "kept.nc")
    report(spark, configured(tmp_path))
    more = configured(tmp_path, '"not-present"')
    assert report(spark, more).scanned == 0
    before = content(tmp_path / "db")
    assert report(spark, more).scanned == 0 and content(tmp_path / "db") == before


def test_missing_folder_and_changed_root(spark, tmp_path):
    root = tree(tmp_path, "left/a.nc", "right/b.nc")
    config = configured(tmp_path)
    report(spark, config)
    before = content(tmp_path / "db")
    with pytest.raises(SnapshotError):
        refresh.update(spark, config, folders=(str(root / "missing"),))
    other = configs.parse(CONFIG.format(out=tmp_path / "db", root=tmp_path, dirs=""))
    with pytest.raises(SnapshotError):
        refresh.update(spark, other)
    assert content(tmp_path / "db") == before


def test_directory_replaced_by_a_link(spark, tmp_path):
    root = tree(tmp_path, "nested/old.nc")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret.nc").touch()
    config = configured(tmp_path)
    report(spark, config)
    (root / "nested" / "old.nc").unlink()
    (root / "nested").rmdir()
    (root / "nested").symlink_to(tmp_path / "outside")
    # The stamp of the parent as it is now, as after a change within one second.
    store = Store(spark, config.indexes[0])
    now = store.required()
    stamps = store.directories(now).withColumn("stamp", F.when(F.length("rel_path") == 0, F.lit(walk.stamp(os.fsencode(root), True))).otherwise(F.col("stamp")))
    store.publish(store.entries(now), stamps)
    found = report(spark, config)
    assert (found.reused, found.skipped) == (1, 1)
    assert names(spark, config, "secret.nc") == [] and names(spark, config, "old.nc") == []


def test_unreadable_and_changing_directories(tmp_path, monkeypatch):
    """The listing by itself; a refresh keeps what it holds of an unreadable directory and refuses a changing one."""
    root = tree(tmp_path, "blocked/hidden.txt", "open/seen.txt")
    own, calls = os.scandir, []

    def scandir(path):
        if path.endswith(b"blocked"):
            raise PermissionError(path)
        return own(path)

    monkeypatch.setattr(walk.os, "scandir", scandir)
    run = walk.listing(str(root), walk.Rules(str(root), Filters()))
    listed = lambda *rels: [r for b in run([pa.RecordBatch.from_arrays([pa.array(rels, pa.binary())], ["rel_path"])]) for r in b.to_pylist()]
    assert [(r["state"], r["stamp"]) for r in listed(b"blocked")] == [("unreadable", None)]
    assert [(r["state"], r["name"]) for r in listed(b"", b"open")] == [("read", None), ("entry", b"blocked"), ("entry", b"open"), ("read", None), ("entry", b"seen.txt")]
    assert [r["state"] for r in listed(b"none")] == ["gone"]
    monkeypatch.setattr(walk, "stamp", lambda path, follow=False: calls.append(1) or bytes([len(calls)]))
    assert [r["state"] for r in listed(b"open")] == ["changing"]
    monkeypatch.setattr(walk, "ROWS", 2)
    monkeypatch.undo()
    assert len(listed(b"")) == 3


def test_init_only_what_is_missing(spark, tmp_path):
    tree(tmp_path, "a.nc")
    config = configured(tmp_path)
    assert set(refresh.update(spark, config, missing_only=True)) == {"main"}
    assert refresh.update(spark, config, missing_only=True) == {}


def test_old_snapshots_go(spark, tmp_path):
    root = tree(tmp_path, "a.nc")
    config = configured(tmp_path)
    store = Store(spark, config.indexes[0])
    held = []
    for k in range(4):
        (root / f"new{k}.nc").touch()
        s = os.stat(root)
        os.utime(root, (s.st_atime, s.st_mtime + 5 + k))
        report(spark, config)
        held.append(store.required().snapshot)
        (tmp_path / "db" / "main.db" / "snapshots" / "work-left").mkdir()
    (tmp_path / "db" / "main.db" / "CURRENT.left").touch()
    (root / "last.nc").touch()
    s = os.stat(root)
    os.utime(root, (s.st_atime, s.st_mtime + 50))
    report(spark, config)
    there = set(os.listdir(tmp_path / "db" / "main.db" / "snapshots"))
    assert there == {held[-1], store.required().snapshot}
    assert not [x for x in os.listdir(tmp_path / "db" / "main.db") if x.startswith("CURRENT.") and x != "CURRENT"]


def _hold(path, ready):
    store = type("S", (), {"path": path})()
    snapshot._Lock(store).__enter__()
    ready.set()
    signal.pause()


def test_lock_of_a_killed_process_is_free(spark, tmp_path):
    (tmp_path / "db").mkdir()
    store = Store(spark, IndexConfig("x", "/x", str(tmp_path / "db" / "x.db")))
    context = multiprocessing.get_context("fork")
    ready = context.Event()
    child = context.Process(target=_hold, args=(store.path, ready))
    child.start()
    assert ready.wait(20)
    with pytest.raises(SnapshotError), store.lock():
        pass
    os.kill(child.pid, signal.SIGKILL)
    child.join()
    with store.lock(), pytest.raises(SnapshotError), store.lock():
        pass
    with store.lock():
        pass


def test_stored_trigrams(spark, tmp_path, monkeypatch):
    store = Store(spark, IndexConfig("x", "/x", f"file://{tmp_path}/x.db"))
    rows = spark.range(40_000).select(F.concat(F.lit("d"), (F.col("id") % 40).cast("string")).alias("d"), F.concat(F.lit("File_"), F.col("id").cast("string"), F.when(F.col("id") == 777, "_Needle").otherwise(""), F.lit(".nc")).alias("n"))
    entries = rows.select(raw(F.col("d")).alias("rel_dir"), raw(F.col("n")).alias("name"), F.lit(False).alias("is_dir"))
    store.publish(entries, spark.range(40).select(raw(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("rel_path"), F.lit(b"0").alias("stamp")))
    manifest = store.required()
    ranges = store.candidates(manifest, search.name_grams(SearchOptions(("needle",))))
    assert len(ranges) == 1
    options = SearchOptions(("needle ext:nc",))
    monkeypatch.setattr(snapshot, "SCAN_BELOW", 0)
    some = store.catalog(grams=search.name_grams(options), scan_below=0)
    assert 0 < some.count() <= 1 << snapshot.BLOCK_BITS
    assert "entry_id" in some._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("]")[0]
    assert [bytes(r.path) for r in search.search_catalog(some, options).collect()] == [b"/x/d17/File_777_Needle.nc"]
    for words in (("file_1234",), ("FILE_1*9.nc !needle",), ("needle | file_39999",), ("path:d17 needle",), ("zzz",)):
        o = SearchOptions(words)
        assert sorted(bytes(r.path) for r in search.search_catalog(store.catalog(grams=search.name_grams(o), scan_below=0), o).collect()) == sorted(bytes(r.path) for r in search.search_catalog(store.catalog(), o).collect())
    monkeypatch.setattr(snapshot, "MOST_RANGES", 0)
    assert store.candidates(manifest, search.name_grams(SearchOptions(("needle",)))) is None


def test_counts_are_checked(spark, tmp_path):
    tree(tmp_path, "a/b.nc", "c.nc")
    config = configured(tmp_path)
    report(spark, config)
    store = Store(spark, config.indexes[0])
    now = store.required()
    at = tmp_path / "db" / "main.db" / "CURRENT"
    text = at.read_text()
    at.write_text(json.dumps(json.loads(text) | {"entry_count": now.entry_count + 1}))
    (at.parent / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(SnapshotError):
        stats.stats(spark, config)
    at.write_text(text)
    store.publish(store.entries(now), store.directories(now).where("length(rel_path) = 0"))
    with pytest.raises(SnapshotError):
        stats.stats(spark, config)


def test_cached_counts(spark, tmp_path):
    root = tree(tmp_path, "a/b.nc", "c.nc")
    config, kept = configured(tmp_path), str(tmp_path / "counts")
    report(spark, config)
    get = lambda: {bytes(r.dir): r.n for r in stats.stats(spark, config, StatsOptions(recursive=False), cache=kept)[0].collect()}
    first = get()
    assert get() == first and len(os.listdir(kept)) == 1
    (root / "d.nc").touch()
    s = os.stat(root)
    os.utime(root, (s.st_atime, s.st_mtime + 5))
    report(spark, config)
    assert get() != first  # another snapshot
    assert len([x for x in os.listdir(os.path.join(kept, os.listdir(kept)[0])) if not x.startswith((".", "KEY"))]) == 1
    stats.Cache(spark, kept).get(["gone"], "x", lambda: spark.range(1))
    assert len(os.listdir(kept)) == 2
    get()
    assert len(os.listdir(kept)) == 1


def test_all_rows_need_no_order(spark):
    catalog = of_bytes(spark, [b"/a", b"/b"]).selectExpr("'x' index_name", "0 index_ord", "1L entry_id", "path", "path name")
    plan = lambda **k: search.search_catalog(catalog, SearchOptions(("*",), **k))._jdf.queryExecution().toString()
    assert "Sort" not in plan() and ("TakeOrdered" in plan(limit=1) or "Sort" in plan(limit=1))


def test_json_rows(spark):
    found = [r.json for r in output.json_rows(of_bytes(spark, [b'/a"b', b"/bad\xff", "/é".encode()])).collect()]
    assert [json.loads(x)["path"] for x in found] == ['/a"b', "/bad�", "/é"]


def test_nested_repetition_takes_linear_time(spark):
    paths = [b"/x/" + b"a" * 40 + b"!", b"/x/aaaa", b"/x/bad\xffaa", b"/x/Abab"]
    catalog = of_bytes(spark, paths).select(F.lit("x").alias("index_name"), F.lit(0).alias("index_ord"), F.lit(1).cast("long").alias("entry_id"), "path", raw(F.substring_index(view("path"), "/", -1)).alias("name"))
    for expression, ignore in ((r"^(a+)+$", True), (r"^(?:(a|b)+)*$", True), (r"(a|aa)+\xff", True), (r"(\w+a)+[$!]", True), (r"^(A[ab]*)+$", False), (r"(ÿ|a)+$", True)):
        found = {bytes(r.path) for r in search.search_catalog(catalog, SearchOptions((expression,), regex=True, case_sensitive=not ignore)).collect()}
        flags = re.I if ignore else 0
        plain = re.compile(expression.encode().replace(b"$", rb"\Z") if not expression.endswith("[$!]") else expression.encode(), flags)
        assert found == {p for p in paths if plain.search(p.split(b"/")[-1][:-20] + p.split(b"/")[-1][-1:] if len(p) > 30 else p.split(b"/")[-1])}, expression
    with pytest.raises(QueryError):
        patterns.regex(F.col("name"), rb"(?x)(a +)+")


def test_saved_configurations(tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    monkeypatch.delenv("PATHQUARRY_CONFIG", raising=False)
    for name in ("one", "two"):
        (tmp_path / f"{name}.toml").write_text(f'outdir = "/o"\n[[index]]\nname = "{name}"\nroot = "/x"\n')
    assert cli.run(["config", "list"]) == 0 and capsys.readouterr().out == "locate: none\nupdatedb: none\n"
    monkeypatch.chdir(tmp_path)
    assert cli.run(["config", "set", "locate", "one.toml"]) == 0 and cli.run(["config", "set", "index", str(tmp_path / "two.toml")]) == 0
    capsys.readouterr()
    assert cli.run(["config", "list"]) == 0 and capsys.readouterr().out == f"locate: {tmp_path}/one.toml\nupdatedb: {tmp_path}/two.toml\n"
    assert cli.run(["updatedb", "list"]) == 0 and capsys.readouterr().out == "two\t/x\t/o/two.db\n"
    with pytest.raises(configs.ConfigError):
        cli.run(["config", "set", "other", "one.toml"])
    with pytest.raises(FileNotFoundError):
        cli.run(["config", "set", "locate", "none.toml"])
    assert configs.discover("/given", {}) == "/given"
