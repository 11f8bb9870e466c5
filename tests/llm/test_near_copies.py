import numpy as np
import pytest
from test_dedup import linked

from pathquarry.llm import jaccard_join

SCHEMA = "doc_id long, text string"


def near_copies(n, words=200, seed=6, base=0):
    rng = np.random.default_rng(seed)
    text = [f"b{base}w{j}" for j in range(words)]
    out = []
    for k in range(n):
        w = list(text)
        w[int(rng.integers(words))] = f"edit{base}x{k}"
        out.append(" ".join(w))
    return out


def test_frequent_shingles_come_last():
    s = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 200, dtype=np.uint64))
    k = jaccard_join.prefix(len(s))
    assert (jaccard_join.leading(s, np.zeros(0, dtype=np.uint64)) == s[:k]).all()
    frequent = s[[0, 3, 5, 199]]
    lead = jaccard_join.leading(s, frequent)
    assert len(lead) == k and not np.isin(frequent, lead).any()
    frequent = s[::-1][:190]  # most frequent first
    lead = jaccard_join.leading(s, frequent)
    assert (lead[:10] == s[:10]).all() and (lead[10:] == s[10 : 10 + k - 10]).all()


def test_blocks_of_a_frequent_shingle(monkeypatch):
    monkeypatch.setattr(jaccard_join, "POINTS", 8)
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(50, 100, 40))
    h = rng.integers(0, 1 << 62, 40)
    held = [(np.full(40, 7, dtype=np.uint64), np.arange(40, dtype=np.uint32), h, n)]
    groups = {}
    for b in jaccard_join._bin(held):
        for g, x in zip(b.column("gid").to_pylist(), b.column("h").to_pylist(), strict=True):
            groups.setdefault(g, set()).add(x)
    assert all(len(g) <= 8 for g in groups.values())
    for i in range(40):
        for j in range(i):
            if 4 * n[i] <= 5 * n[j]:
                assert any({h[i], h[j]} <= g for g in groups.values())


@pytest.mark.parametrize("held", [2, 4])
def test_common_passage(spark, monkeypatch, held):
    """Documents that share a frequent passage, some of them near copies."""
    monkeypatch.setattr(jaccard_join, "HELD", held)
    passage = " ".join(f"common{j}" for j in range(60))
    texts = [f"{passage} " + " ".join(f"own{k}x{j}" for j in range(40)) for k in range(30)] + near_copies(12, 80) + [passage, passage + " tail", "alone words here"]
    rows = [*enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert len(jaccard_join.frequent_shingles(docs)) >= 56
    least = linked(rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == least


def test_chunks_of_a_large_component(spark, monkeypatch):
    """Two classes and some strays that the bounds put into one candidate component; chunks find the same links."""
    monkeypatch.setattr(jaccard_join, "POINTS", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "_edges", lambda bs: _all_linked(bs))
    texts = near_copies(50, 60) + near_copies(40, 60, base=1) + [" ".join(f"s{k}y{j}" for j in range(56 + k)) + " " + " ".join(f"b0w{j}" for j in range(4 + k)) for k in range(6)]
    rows = [*enumerate(texts)]
    least = linked(rows)
    assert len(set(least.values())) > 2
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == least


def _all_linked(batches):
    import pyarrow as pa

    h = sorted({x for b in batches for x in b.column("h").to_pylist()})
    yield pa.RecordBatch.from_arrays([pa.array(h[:-1], pa.int64()), pa.array(h[1:], pa.int64())], ["u", "v"])


def test_rows_sent_for_a_large_cluster(spark, monkeypatch):
    """20,000 near copies: each text travels a bounded number of times, not once for each chunk."""
    texts = near_copies(20_000, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    sent, kind = [], type(docs)

    own = kind.repartition

    def counted(self, n, *columns):
        if self.columns == ["doc_id", "h", "gid", "z"]:
            sent.append(self.count())
        return own(self, n, *columns)

    monkeypatch.setattr(kind, "repartition", counted)
    found = jaccard_join.near_duplicates(docs).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in found] == [(0, 20_000)]
    assert sent and 20_000 <= sum(sent) <= 21_000


@pytest.mark.parametrize("unnamed", [False, True])
def test_names_that_clash(spark, unnamed):
    text = " ".join(f"w{j}" for j in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, "k", "r"), (2, text, 3, 4, "l", "s"), (3, "", 5, 6, "m", "t"), (3, None, 5, 6, "m", "t")], "doc_id long, text string, at int, root int, key string, row string")
    kept = jaccard_join.keep_one(docs, unnamed)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text, 1, 2, "k", "r"), (3, "", 5, 6, "m", "t"), (3, None, 5, 6, "m", "t")], key=str)


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    words = [f"w{j}" for j in range(3000)]
    long = " ".join(rng.choice(words, 400_000))
    assert len(long) > 2 * jaccard_join.CHUNK
    rows = [(1, long), (2, long + " and a tail"), (3, long[: len(long) // 2])]
    found = {r.doc_id: (r.n_shingles > 100_000, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: (True, 1), 2: (True, 1), 3: (True, 3)}
