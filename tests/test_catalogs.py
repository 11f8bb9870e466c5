import io
import os
import random
from collections import Counter

import pytest

from pathquarry import cli
from pathquarry.operators import output, refresh, search, stats
from pathquarry.options import SearchOptions, StatsOptions
from pathquarry.sources import config as configs
from pathquarry.sources import ignored, pathlist
from pathquarry.sources.pathlist import of_bytes
from pathquarry.sources.snapshot import SnapshotError, Store
from pathquarry.streaming import lists


def naive(paths):
    direct, recursive = Counter(), Counter()
    for p in paths:
        own = _parent(p)
        if own is None:
            continue
        direct[own] += 1
        while own is not None and own.strip(b"/"):
            recursive[own] += 1
            own = _parent(own)
    return direct, recursive


def _parent(p):
    if b"/" not in p:
        return None
    body = p.rstrip(b"/") if p.strip(b"/") else p
    if p.endswith(b"/") and p.strip(b"/"):
        return body
    head = p[: p.rindex(b"/")].rstrip(b"/")
    return head or p[: len(p) - len(p.lstrip(b"/"))]


def test_counts(spark):
    rng = random.Random(42)
    paths = [b"/", b"/a", b"//a", b"/a/new\nline", b"/a/invalid\xff/file", b"relative/file", b"/a//b"]
    paths += [b"/" + b"/".join(b"n%d" % rng.randrange(20) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    paths += paths[:100]
    direct, recursive = naive(paths)
    rows = stats.count_directories(of_bytes(spark, paths)).collect()
    assert {r.dir.encode("latin-1"): r.direct for r in rows if r.direct} == dict(direct)
    assert {r.dir.encode("latin-1"): r.recursive for r in rows if r.recursive} == dict(recursive)


def test_ranking(spark):
    df = of_bytes(spark, [b"/tree", b"/tree/left", b"/tree/a", b"/tree/left/file", b"/tree/left/file2", b"/tree/empty"])
    counts = stats.count_directories(df)
    assert [(bytes(r.dir), r.n) for r in stats.ranked(counts, None, False).collect()] == [(b"/tree", 3), (b"/tree/left", 2), (b"/", 1)]
    assert [(bytes(r.dir), r.n) for r in stats.ranked(counts).collect()] == [(b"/tree/left", 2)]  # the largest is hidden
    assert [(bytes(r.dir), r.n) for r in stats.ranked(counts, b"/tree").collect()] == [(b"/tree", 5), (b"/tree/left", 2)]
    assert stats.total(df, counts) == 6 and stats.total(df, counts, b"/tree") == 5 and stats.total(df, counts, b"/none") == 0


CONFIG = """
outdir = "{out}"
[filters]
exclude_dirs = ["excluded"]
exclude_extensions = ["tmp"]
[[index]]
name = "main"
root = "{root}"
"""


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "root"
    for d in ("nested", "excluded"):
        (root / d).mkdir(parents=True)
    for name in (b"soil_ERA5.nc", b"SOIL.csv", b"nested/rain.nc", b"nested/line\nfile.txt", "中文.nc".encode(), b"excluded/hidden.nc", b"ignore.tmp", b"bad_\xff.nc"):
        with open(os.path.join(os.fsencode(root), name), "w"):
            pass
    (root / "loop").symlink_to(root)
    (root / "nested" / "excluded").touch()  # a file with the name of an excluded directory
    path = tmp_path / "config.toml"
    path.write_text(CONFIG.format(out=tmp_path / "db", root=root))
    return root, path


def names(spark, config, *patterns, **options):
    root = config.indexes[0].root.encode()
    return sorted(bytes(r.path).removeprefix(root + b"/") for r in search.search(spark, config, SearchOptions(patterns, **options)).collect())


def later(*paths):
    for p in paths:
        s = os.stat(p)
        os.utime(p, (s.st_atime, s.st_mtime + 5))


def test_build_and_refresh(spark, place):
    root, path = place
    config = configs.load(str(path))
    store = Store(spark, config.indexes[0])
    with pytest.raises(SnapshotError):
        store.required()
    first = refresh.update(spark, config)["main"]
    assert first.published and first.scanned == 2
    every = names(spark, config, "*")
    assert every == sorted([str(root).encode(), b"SOIL.csv", b"bad_\xff.nc", b"loop", b"nested", b"nested/excluded", b"nested/line\nfile.txt", b"nested/rain.nc", b"soil_ERA5.nc", "中文.nc".encode()])
    before = store.manifest()
    assert before.entry_count == len(every) + 1  # ignore.tmp is stored and hidden
    again = refresh.update(spark, config)["main"]
    assert not again.published and again.reused == 2 and store.manifest() == before

    os.rename(root / "nested" / "rain.nc", root / "nested" / "after.nc")
    (root / "nested" / "deep").mkdir()
    (root / "nested" / "deep" / "new.nc").touch()
    later(root / "nested")
    third = refresh.update(spark, config, folders=(str(root / "nested"),))["main"]
    assert third.published and third.scanned == 2
    assert {b"nested/after.nc", b"nested/deep/new.nc"} <= set(names(spark, config, "*")) and b"nested/rain.nc" not in names(spark, config, "*")

    import shutil

    shutil.rmtree(root / "nested")
    later(root)
    refresh.update(spark, config)
    assert not [n for n in names(spark, config, "*") if n.startswith(b"nested")]
    with pytest.raises(SnapshotError):
        refresh.update(spark, config, folders=(str(root / "missing"),))
    (store_lock := store.lock()).__enter__()
    with pytest.raises(SnapshotError):
        refresh.update(spark, config)
    store_lock.__exit__()


def test_added_exclusion_equals_fresh_build(spark, place, tmp_path):
    root, path = place
    for d in ("raw/deep/raw", "kept/deep", "raw-other"):
        (root / d).mkdir(parents=True)
        (root / d / "x.nc").touch()
    (root / "kept" / "raw").touch()
    refresh.update(spark, configs.load(str(path)))
    path.write_text(path.read_text().replace('["excluded"]', '["excluded", "raw"]\nexclude_paths = ["nested/rain.nc", "kept/deep"]'))
    config = configs.load(str(path))
    with pytest.raises(SnapshotError):
        refresh.update(spark, config, folders=(str(root / "kept"),))
    refresh.update(spark, config)
    pruned = names(spark, config, "*")
    assert b"kept/raw" in pruned and b"raw-other/x.nc" in pruned and not [n for n in pruned if n.startswith((b"raw/", b"kept/deep", b"nested/rain"))]
    fresh = configs.parse(path.read_text().replace(str(tmp_path / "db"), str(tmp_path / "db2")))
    refresh.update(spark, fresh)
    assert names(spark, fresh, "*") == pruned


def test_stats_of_snapshot(spark, place, tmp_path):
    root, path = place
    config = configs.load(str(path))
    refresh.update(spark, config)
    ranking, total = stats.stats(spark, config, StatsOptions(recursive=False), cache=str(tmp_path / "stats"))
    assert {bytes(r.dir): r.n for r in ranking.collect()} == {str(root).encode(): 6, str(root / "nested").encode(): 3, str(root.parent).encode(): 1} and total == 10
    alone = Store(spark, config.indexes[0])
    a = {r.dir: (r.direct, r.recursive) for r in stats.from_snapshot(alone).collect()}
    b = {r.dir: (r.direct, r.recursive) for r in stats.count_directories(alone.catalog()).collect()}
    assert a == b
    assert stats.stats(spark, config, StatsOptions(scope=str(root / "nested")), cache=str(tmp_path / "stats"))[1] == 3


def test_outputs(spark):
    df = of_bytes(spark, [b"/a", b"/bad\xff"]).select("path")
    out = io.BytesIO()
    output.write_paths(df, out)
    assert out.getvalue() == b"/a\n/bad\xff\n"
    out = io.BytesIO()
    output.write_paths(df, out, null=True)
    assert out.getvalue() == b"/a\0/bad\xff\0"
    out = io.BytesIO()
    output.write_paths(df, out, as_json=True)
    assert out.getvalue() == '[{"path":"/a"},{"path":"/bad�"}]\n'.encode()
    out = io.BytesIO()
    output.write_paths(df.limit(0), out, as_json=True)
    assert out.getvalue() == b"[]\n"


def test_config():
    text = 'outdir = "/o"\n[filters]\nexclude_paths = ["a"]\nexclude_dirs = ["d"]\n[[index]]\nname = "x"\nroot = "/x"\n[[index]]\nname = "y"\nroot = "C:/y"\ndatabase = "/z/y"\nexclude_paths = []\n'
    config = configs.parse(text)
    assert [x.database for x in config.indexes] == ["/o/x.db", "/z/y"] and config.indexes[1].filters.exclude_paths == () and config.indexes[1].filters.exclude_dirs == ("d",)
    assert [x.name for x in config.select(("y", "x", "y"))] == ["x", "y"]
    for bad in (text.replace('"x"\n', '"y"\n'), text.replace('"/x"', '"x"'), text.replace('["d"]', '["d/e"]'), text.replace('name = "x"', 'name = ".."'), "outdir = '/o'", text.replace("/z/y", "/o/x.db")):
        with pytest.raises(configs.ConfigError):
            configs.parse(bad)
    with pytest.raises(configs.ConfigError):
        config.select(("none",))


def test_ignored(tmp_path):
    config = str(tmp_path / "c.toml")
    assert ignored.add(config, ["b", "a", "b"]) == ["a", "b"]
    for bad in ("", ".", "..", "x/y"):
        with pytest.raises(ValueError):
            ignored.add(config, ["ok", bad])
    assert ignored.load(config) == ["a", "b"] and ignored.remove(config, ["a", "zz"]) == ["b"]
    (tmp_path / "ignore.json").write_text("{")
    with pytest.raises(ValueError):
        ignored.load(config)


def test_path_lists(spark, tmp_path):
    (tmp_path / "lines").write_bytes(b'/a/b.nc\n\n/bad\xff"x\n/c,d\n')
    assert sorted(bytes(r.path) for r in pathlist.read(spark, str(tmp_path / "lines")).collect()) == [b"/a/b.nc", b'/bad\xff"x', b"/c,d"]
    (tmp_path / "nul").write_bytes(b"/a\nb\0/c\0")
    assert sorted(bytes(r.path) for r in pathlist.read(spark, str(tmp_path / "nul"), null=True).collect()) == [b"/a\nb", b"/c"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("/a/soil.nc\n/a/rain.nc\n")
    q = lists.matching(lists.arriving(spark, str(tmp_path / "in")), ["soil"]).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [bytes(r.path) for r in spark.table("arrived").collect()] == [b"/a/soil.nc"]


def test_command_line(tmp_path, capsys):
    assert cli.with_command(["-n20", "soil"]) == ["locate", "-n20", "soil"]
    assert cli.with_command(["-c", "x", "--dirs", "soil"]) == ["-c", "x", "locate", "--dirs", "soil"]
    assert cli.with_command(["stats"]) == ["stats"]
    path = tmp_path / "c.toml"
    path.write_bytes(b'# keep\r\nengine = "rust" # why\r\noutdir = "/o"\r\n[[index]]\r\nname = "x"\r\nroot = "/x"\r\n')
    assert cli.run(["-c", str(path), "config", "engine", "plocate"]) == 0
    assert path.read_bytes().startswith(b'# keep\r\nengine = "plocate" # why\r\n')
    with pytest.raises(SystemExit):
        cli.run(["-c", str(path), "locate", "a", "--json", "-0"])
    assert cli.run(["-c", str(path), "ignore", "add", "cache"]) == 0 and capsys.readouterr().out.endswith("cache\n")
