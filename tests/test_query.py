import random

import pytest
from oracle import matches as plain
from pyspark.sql import functions as F

from pathquarry.functions.paths import basename, comparable, resolve, under, view
from pathquarry.operators import filters, postings
from pathquarry.operators.search import matches, search_catalog
from pathquarry.options import SearchOptions
from pathquarry.plans.anchors import anchors, branches, longest_run, required_trigrams
from pathquarry.plans.compile import name_filter, predicate
from pathquarry.plans.patterns import regex_pattern
from pathquarry.plans.syntax import And, Extension, Not, Or, QueryError, Term, Word, lex, parse
from pathquarry.sources.config import Filters, IndexConfig
from pathquarry.sources.pathlist import merge, of_bytes

ROOT = b"/tmp/soil_parent/data"
NAMES = [b"rain_folder", b"soil.nc", b"SOIL.csv", b"rain.nc", b"soil_rain.nc", b"backup_soil.nc", b"my report.nc", b"a ! b.txt", b"rain_folder/other.nc", "中文.nc".encode(), b"script.PY", b"not.py.bak", b".py", b"literal.[ab]", b"single.x", b"bad_\xff.nc", b"new\nline.nc", b"soil.nc\n"]
TREE = [ROOT] + [ROOT + b"/" + n for n in NAMES]


@pytest.fixture(scope="module")
def tree(spark):
    return of_bytes(spark, TREE).cache()


def found(df):
    return sorted(bytes(r.path).removeprefix(ROOT + b"/") for r in df.collect())


GOLDEN = {
    "soil": [b"SOIL.csv", b"backup_soil.nc", b"soil.nc", b"soil.nc\n", b"soil_rain.nc"],
    "soil rain": [b"soil_rain.nc"],
    "soil !rain !csv": [b"backup_soil.nc", b"soil.nc", b"soil.nc\n"],
    "soil*.nc": [b"soil.nc", b"soil_rain.nc"],
    '"my report"': [b"my report.nc"],
    '"a ! b"': [b"a ! b.txt"],
    "exts:py": [b".py", b"script.PY"],
    "ext:[ab]": [b"literal.[ab]"],
    "?????e.x": [b"single.x"],
    "中文": ["中文.nc".encode()],
    "path:rain_folder !<exts:nc>": [b"rain_folder"],
    "rain_folder/": [b"rain_folder/other.nc"],
    "<soil | rain> ext:csv": [b"SOIL.csv"],
    "bad_?.nc": [b"bad_\xff.nc"],
    r"regex:^soil\.nc$": [b"soil.nc"],
}


@pytest.mark.parametrize("query", GOLDEN)
def test_golden(tree, query):
    assert found(matches(tree, SearchOptions((query,)))) == GOLDEN[query]


def test_options(tree):
    assert found(matches(tree, SearchOptions(("SOIL",), case_sensitive=True))) == [b"SOIL.csv"]
    assert len(found(matches(tree, SearchOptions(("soil_parent",), whole_path=True)))) == len(TREE)
    assert found(matches(tree, SearchOptions(("*",), extensions=("..py",)))) == [b"script.PY"]
    assert b".py" in found(matches(tree, SearchOptions(("*",), dirs=True)))
    assert found(matches(tree, SearchOptions(("*",), scope=ROOT + b"/./x/../rain_folder/"))) == [b"rain_folder", b"rain_folder/other.nc"]
    assert found(matches(tree, SearchOptions(("other",), ignored=("rain_folder",)))) == []
    assert found(matches(tree, SearchOptions(("soil", "rain"), regex=True))) == [b"soil_rain.nc"]
    with pytest.raises(ValueError):
        SearchOptions(("a",), files=True, dirs=True)
    with pytest.raises(ValueError):
        SearchOptions(("a",), limit=0)


@pytest.mark.parametrize("query", ["a |", "<>", "<a", "a >", "!", '"a', '""', "ext:", "folder:", "file:x", "path:", "exts:,pdf", "exts:pdf,,docx", "ext:a/b", "a\x0cb", " ".join("a" * 257)])
def test_errors(query):
    with pytest.raises(QueryError):
        parse([query])


@pytest.mark.parametrize("pattern", ["[abc", "[]", "x[!]", r"regex:a(?=b)", r"regex:(a)\1", "regex:a++", "regex:[a"])
def test_pattern_errors(tree, pattern):
    with pytest.raises(QueryError):
        matches(tree, SearchOptions((pattern,)))


def test_tokens_and_precedence():
    assert lex(["a!b"]) == [Word(b"a", False), b"!", Word(b"b", False)]
    assert lex(['"ext:a" b"c d"e']) == [Word(b"ext:a", True), Word(b"bc de", False)]
    t = lambda x: Term(x, False)
    assert parse(["a | b c !d"]) == Or(t(b"a"), And(And(t(b"b"), t(b"c")), Not(t(b"d"))))
    assert parse(["ext:.nc;tif"]) == Extension((b"nc", b"tif"))


def test_anchors():
    assert longest_run(b"ab*[xyz]cde?f") == b"cde"
    assert longest_run(b"*?[a]") is None
    assert [a.text for a in anchors(parse(["soil | SOIL"]))] == [b"soil", b"SOIL"]
    assert anchors(parse(["soil | !rain"])) == []
    assert [a.text for a in anchors(parse(["abc xyz"]))] == [b"xyz"]  # of equal ones the later
    assert branches(parse(["|".join(f"w{i}" for i in range(65))])) == [None]
    assert required_trigrams(parse(["SOIL*x rain"])) == {"soi", "oil", "rai", "ain"}
    assert required_trigrams(parse(["soil | rain"])) == set()


def test_against_plain_evaluation(spark):
    rng = random.Random(42)
    parts = [b"soil", b"SOIL", b"a", b".", b"nc", b"\xff", b"\xe9", b"\xc9", b"\n", b" ", b"-", b"]", b"["]
    paths = [b"/".join([b""] + [b"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]) for _ in range(300)]
    df = of_bytes(spark, paths).cache()
    queries = ["soil", "*soil*", "soil*", "*nc", "**nc**", "a?", "*[a-n]*", "[^a]*", "*[]*" if False else "?[n]?", "soil | !a", "path:a*nc", "ext:nc", "<soil !nc> | ext:a", "!<soil | a>", "regex:a.c", "regex:^so", "regex:l$", "é", "a/s", "*.*", "soil*a*"]
    name, path = view("name"), view("path")
    for sensitive in (False, True):
        trees = [parse([q], sensitive) for q in queries]
        rows = df.select("path", *[predicate(t, name, path).alias(f"q{i}") for i, t in enumerate(trees)], *[(F.lit(True) if (early := name_filter(t, name)) is None else early).alias(f"n{i}") for i, t in enumerate(trees)]).collect()
        for r in rows:
            for i, t in enumerate(trees):
                assert r[f"q{i}"] == plain(t, bytes(r.path)), (queries[i], bytes(r.path))
                assert r[f"n{i}"] or not r[f"q{i}"]


def test_pages_are_slices(spark):
    a = of_bytes(spark, [b"/r/%s%d" % (w, i) for i in range(20) for w in (b"soil", b"rain")], "a", 0)
    b = of_bytes(spark, [b"/r/%s%d" % (w, i) for i in range(10, 30) for w in (b"soil", b"rain")], "b", 1)
    both = a.unionByName(b)
    whole = [b"/r/%s%d" % (w, i) for w in (b"rain", b"soil") for i in range(30)]  # by branch, index and entry
    assert sorted(bytes(r.path) for r in search_catalog(both, SearchOptions(("rain | soil",))).collect()) == sorted(whole)  # all rows come in any order
    for offset, limit in ((0, 5), (7, 25), (55, 50), (100, 3)):
        assert [bytes(r.path) for r in search_catalog(both, SearchOptions(("rain | soil",), offset=offset, limit=limit)).collect()] == whole[offset : offset + limit]
    assert matches(both, SearchOptions(("soil",))).count() == 40  # one branch: what two indexes hold stays twice


def test_existing(spark, tmp_path):
    (tmp_path / "here.nc").touch()
    df = of_bytes(spark, [str(tmp_path / n).encode() for n in ("here.nc", "gone.nc")])
    assert [bytes(r.path).rsplit(b"/", 1)[1] for r in search_catalog(df, SearchOptions(("nc",), existing=True, limit=5)).collect()] == [b"here.nc"]


def test_exclusions(spark):
    outer = IndexConfig("o", "/data", "/d1", Filters(exclude_extensions=("tmp",), exclude_paths=("cut",), exclude_files=("Thumbs.DB",)))
    inner = IndexConfig("i", "/data/keep", "/d2", Filters())
    df = of_bytes(spark, [b"/data/a.tmp", b"/data/keep/file.tmp", b"/data/cut/x", b"/data/cutter", b"/data/thumbs.db", b"/other.tmp", b"/data/b.TMP"])
    assert sorted(bytes(r.path) for r in filters.visible(df, (outer, inner)).collect()) == [b"/data/cutter", b"/data/keep/file.tmp", b"/other.tmp"]


PORTABLE = [
    (rb"C:\data\item.nc", "c:/data", True), (b"C:/data-other", "c:/data", False), (rb"\\?\UNC\nas\share\item.nc", "//nas/share", True), (rb"/data/cache\file.nc", "/data/cache", False),
    (b"/data/a", "/data/a", True), (b"/data/a-other", "/data/a", False), (b"/x", "/", True), (b"//nas/x", "//nas/", True), (b"C:/x", "C:/", True), (b"/NAS/x", "/nas", False), (b"/data/a0", "/data/a", False),
]


def test_portable_prefixes(spark):
    df = of_bytes(spark, [p for p, _, _ in PORTABLE])
    for path, prefix, expected in PORTABLE:
        assert df.where(F.col("path") == F.lit(bytearray(path))).select(under(view("path"), prefix)).first()[0] is expected, (path, prefix)
    assert comparable(b"//?/C:/a/") == b"c:/a" and comparable(b"/") == b"/" and comparable(b"C:") == b"c:"
    assert resolve(b"/a/./b/../c/") == b"/a/c" and resolve(b"x", b"/r") == b"/r/x"


def test_owners_repeat_the_path_few_times(spark):
    owners = tuple(IndexConfig(f"i{k}", f"/data/src{k}", f"/x/{k}", Filters(exclude_extensions=("nc",), exclude_paths=("fr", "en/old"), exclude_files=("a.csv",))) for k in range(10))
    df = of_bytes(spark, [b"/data/src1/fr/a", b"/data/src1/en/a.nc", b"/data/src11/fr/a", b"/data/src9/de/b", b"/data/src9/A.csv"])
    kept = filters.visible(df, owners)
    uses = kept._jdf.queryExecution().analyzed().expressions().toString().count("decode(")
    assert 0 < uses <= 10 * 15
    assert sorted(bytes(r.path) for r in kept.collect()) == [b"/data/src11/fr/a", b"/data/src9/de/b"]


def test_prefixes_by_definition(spark):
    rng = random.Random(5)
    parts = [b"/", b"/", b"\\", b"//", b"\\\\", b"//?/", b"\\\\?\\", b"UNC", b"unc/", b"C:", b"c:", b"Z:/", b"1:", b"?", b".", b"a", b"A", b"a/b", b"\n", b"\xff", b"*[^$", b"\\E", b"]"]
    made = {b"".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(3000)}
    prefixes = sorted(made)[::12] + [b"/", b"//", b"c:", b"C:/", b"//c:", b"/:/", b"//?/UNC/a/b"]
    paths = sorted(made | {p + end for p in prefixes for end in (b"", b"/", b"\\", b"/x", b"x", b"//")} | {b"\\\\?\\" + p for p in prefixes} | {b"//?/UNC/" + p[2:] for p in prefixes})
    df = of_bytes(spark, paths).select("path").repartition(4)
    below = lambda path, key: bool(key) and (path == key or path.startswith(key.removesuffix(b"/") + b"/"))
    for k in range(0, len(prefixes), 50):
        some = prefixes[k : k + 50]
        rows = df.select("path", F.array(*[under(view("path"), p) for p in some])).collect()
        wrong = [(bytes(path), p) for path, flags in rows for p, flag in zip(some, flags, strict=True) if flag is not below(comparable(bytes(path)), comparable(p))]
        assert len(rows) == len(paths) and not wrong, wrong[:5]


def test_postings(spark, tree):
    table = postings.build(tree)
    for q in ("soil", "soil rain", "path:folder ext:nc", "so", "soil | rain", "中文", "ext:nc soil_r*"):
        assert found(postings.search(tree, table, SearchOptions((q,)))) == found(search_catalog(tree, SearchOptions((q,)))), q


def test_merge(spark):
    old, new = of_bytes(spark, [b"/r/a/x", b"/r/b", b"/r/ab"]), of_bytes(spark, [b"/r/a/y", b"/r/b"])
    assert [bytes(r.path) for r in merge(old, new, "/r/a").collect()] == [b"/r/a/y", b"/r/ab", b"/r/b"]


def test_regex_dialect():
    assert regex_pattern(rb"(?P<n>a)$") == r"(?d)(?<n>a)\z"
    assert regex_pattern(b"[[:alpha:]]") == r"(?d)[\p{Alpha}]"
    assert regex_pattern("中+".encode()) == r"(?d)(?:\xE4\xB8\xAD)+"


def test_basename(spark):
    df = of_bytes(spark, [b"/a/b", b"/a/", b"x", b"/"])
    assert [r[0] for r in df.select(basename(view("path"))).collect()] == ["b", "", "x", ""]
