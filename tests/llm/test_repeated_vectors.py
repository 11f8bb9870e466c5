import numpy as np

from pathquarry.llm import nearest


def test_repeated_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 16))
    v[7] = v[0] + 0.01  # nearest to the query
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    more = [rows[7]] * 6 + [(9, (v[0] + 0.02 * (k + 1) * rng.standard_normal(16)).tolist()) for k in range(6)] + [rows[0]] * 3
    found = nearest.search(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")).collect()
    best = {}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for i, x in rows + more:
        if i:
            best[i] = max(best.get(i, -2), float(unit(x) @ unit(v[0])))
    expected = sorted(best, key=lambda i: (-best[i], i))[:5]
    got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0)
    assert [x[0] for x in got] == [1, 2, 3, 4, 5]
    assert [x[1] for x in got] == expected
    assert all(abs(s - best[i]) < 1e-9 for _, i, s in got)
