import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathquarry.llm import jaccard_join, suffix_dedup
from pathquarry.llm._common import Scratch
from pathquarry.llm.graph import components


def removed(rows):
    """rows: (order, bytes) in order; which bytes a 100-byte string that starts earlier covers."""
    seen, out = set(), []
    for data in rows:
        gone = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(w)
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 3: names are split down to single windows
    # Repeated rows are one document; of rows that share an id only, the order is by hash, so those are left out here.
    rows = sorted({(i, t or "") for i, t in texts if i is not None and not (i == 8 and t.startswith("same id"))}) + [(None, t) for i, t in texts if i is None]
    expected = {}
    for (i, t), gone in zip(rows, removed([t.encode() for _, t in rows]), strict=True):
        kept = bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)
        expected[i] = (len(t.encode()), int(gone.sum()), int((np.diff([0, *gone.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    own = docs.where(~F.coalesce(F.col("text").startswith("same id"), F.lit(False)))
    found = suffix_dedup.digest_documents(own).collect()
    assert len(found) == own.count()
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_index_alone():
    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 100, 190, dtype=np.uint8))
    texts = [base, base[5:170], b"z" + base[:120], base[30:60] * 5, bytes(rng.integers(97, 99, 180, dtype=np.uint8)), base[60:190], b"\0" * 150, b"\0" * 120]
    for t, flags in zip(texts, suffix_dedup.repeats(texts), strict=True):
        at = texts.index(t)
        earlier = {x[i : i + 100] for x in texts[:at] for i in range(len(x) - 99)}
        assert flags.tolist() == [t[i : i + 100] in earlier for i in range(len(t) - 99)]


def test_suffix_cut(docs, no_docs):
    out = suffix_dedup.cut_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.digest_documents(no_docs).count() == 0


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}
    changed = True
    links = [(i, j) for i, a in sets for j, b in sets if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            if least[i] != m or least[j] != m:
                least[i] = least[j] = m
                changed = True
    return least


@pytest.mark.parametrize("points,shingles", [(2048, 4_000_000), (8, 1500)])
def test_jaccard_join(docs, texts, monkeypatch, points, shingles):
    monkeypatch.setattr(jaccard_join, "POINTS", points)  # small: groups are cut into blocks
    monkeypatch.setattr(jaccard_join, "SHINGLES", shingles)
    least = linked(texts)
    found = jaccard_join.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    sizes = defaultdict(set)
    for i, t in texts:
        sizes[i].add(len(sets_of(t)))
    for r in found:
        assert r.n_shingles in sizes[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else least[r.doc_id]), r.doc_id


def test_jaccard_keep_and_empty(docs, no_docs, texts):
    least = linked(texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i in least if least[i] == i}
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    sets = []
    for n in (30, 640, 641, 700, 2600, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(n * 0.9)], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    label = jaccard_join.join(n, [jaccard_join.counts(s) for s in sets], lambda i, j: jaccard_join.overlap(sets[i], sets[j]) >= jaccard_join.enough(n[i], n[j]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            o = len(np.intersect1d(a, b))
            if 100 * o >= 80 * (len(a) + len(b) - o):
                assert label[i] == label[j]
    assert len(set(label)) == 6 or len(set(label)) < len(sets)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 201)], "u long, v long")
    found = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(edges.limit(0), Scratch(spark)).count() == 0
