import math

import numpy as np
import pytest

from pathquarry.llm import nearest

SCHEMA = "vec_id long, embedding array<double>"


def brute(v, queries, top=5):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q in queries:
        s = u @ u[q]
        s[q] = -9
        out[q] = np.lexsort((np.arange(len(v)), -s))[:top].tolist()
    return out


def result(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return by


def vectors(kind, n=3000, dim=24):
    rng = np.random.default_rng(17)
    if kind == "spread":
        return rng.standard_normal((n, dim))
    centres = rng.standard_normal((20, dim)) * 4  # clusters, one of them with a third of all rows
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 20, n))
    return centres[which] + 0.3 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("kind", ["spread", "clusters"])
@pytest.mark.parametrize("share", [1.0, 0.7])
def test_recall_over_cells_and_blocks(spark, monkeypatch, kind, share):
    monkeypatch.setattr(nearest, "PER_CELL", 250)
    monkeypatch.setattr(nearest, "BLOCK", 90)  # at least three blocks a cell, more in the large one
    v = vectors(kind)
    found = result(nearest.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA), probe_share=share))
    expected = brute(v, range(0, len(v), 50))
    assert set(found) == set(expected)
    hits = sum(len({x for x, _ in found[q]} & set(e)) for q, e in expected.items())
    assert hits / (5 * len(expected)) >= (0.97 if share == 1 or kind == "clusters" else 0.75)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert all(len(got) == 5 and all(abs(s - u[x] @ u[q]) < 1e-12 for x, s in got) for q, got in found.items())


def test_cells_out_of_reach_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PER_CELL", 250)
    seen = []
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors("clusters"))], SCHEMA)
    kind = type(rows)
    own = kind.mapInArrow

    def noted(self, f, schema, *a, **b):
        out = own(self, f, schema, *a, **b)
        if "bar double" in schema:
            seen.append(out)
        return out

    monkeypatch.setattr(kind, "mapInArrow", noted)
    nearest.search(rows).count()
    assert seen[0].count() < 60 * 12 / 2  # of 60 queries and 12 cells, less than half


def test_estimates_from_packed_bits():
    rng = np.random.default_rng(5)
    for dim in (3, 24, 64, 100):
        v, q = rng.standard_normal((500, dim)), rng.standard_normal((1, dim))
        codes = nearest.Codes(np.arange(500), v, np.zeros(dim), nearest.rotation(dim))
        assert codes.bits.dtype == np.uint64 and codes.bits.shape == (500, -(-dim // 64))
        turned = (nearest._unit(q) @ codes.turn.T)[0]
        inner, step = codes.agreement(turned)
        signs = np.where((nearest._unit(v) @ codes.turn.T) > 0, 1, -1) / np.sqrt(dim)
        assert np.abs(inner - signs @ turned).max() <= step * np.sqrt(dim) / 2 + 1e-9


def test_large_and_small_components(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e-200, 2e-200, 1e-201]), (2, [1.0, 2.0, 0.5]), (3, [-1e300, 1e-300, 1e300]), (50, [5e-320, 0.0, 0.0])]
    found = result(nearest.search(spark.createDataFrame(rows, SCHEMA)))
    assert set(found) == {0, 50}
    assert all(math.isfinite(s) and -1.000001 <= s <= 1.000001 for got in found.values() for _, s in got)
    assert [x for x, _ in found[0]][:2] == [1, 2] and abs(dict(found[0])[1] - 5 / math.sqrt(5 * 5.01)) < 1e-12


def test_columns_and_lengths(spark):
    rows = [(0, [1.0, 0.0], 1, 2.0), (1, [1.0, 0.1], 3, 4.0), (2, [1.0, 0.0, 0.0], 5, 6.0), (50, [0.0, 1.0, 0.0], 7, 8.0), (3, None, 1, 1.0), (4, [0.0, 0.0], 1, 1.0), (5, [float("nan"), 1.0], 1, 1.0), (6, [None, 1.0], 1, 1.0), (None, [1.0, 0.0], 1, 1.0)]
    found = result(nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, v double")))
    assert {q: [x for x, _ in got] for q, got in found.items()} == {0: [1], 50: [2]}
