import hashlib
import random

import pytest
from test_dedup import removed

from pathquarry.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def expected(rows):
    out = []
    for (i, t), gone in zip(rows, removed([t.encode() for _, t in rows]), strict=True):
        kept = bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)
        out.append((i, len(t.encode()), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(docs):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest_documents(docs).collect()]


@pytest.mark.parametrize("rows", [[(1, "short")], [(i, f"short {i}") for i in range(60)], [(1, "")], [(1, "x" * 99), (2, "x" * 99)], [(1, "y" * 100), (2, "y" * 100)]])
def test_texts_around_the_least_length(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert sorted(found(docs)) == expected(rows)
    assert suffix_dedup.cut_documents(docs.selectExpr("*", "0L n_chars")).count() == len(rows)


def test_empty_tasks(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "z" * 150)], SCHEMA).repartition(8)
    assert sorted(found(docs)) == expected([(1, "short"), (2, "z" * 150)])


def test_very_long_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(5000)]
    passage = " ".join(rng.choices(words, k=60))
    long = " ".join(rng.choices(words, k=700_000))
    assert len(long) > 4_500_000
    long = long[:1_000_000] + passage + long[1_000_000:3_999_950] + passage + long[3_999_950:]  # over several slices
    rows = [(1, "start " + passage), (2, long), (3, "tail " + passage + " end")]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_largest_id_and_none(spark):
    text = " ".join(f"w{j}" for j in range(60))
    last = (1 << 63) - 1
    rows = [(last, text + " a"), (None, text + " b"), (last - 1, text + " c")]
    got = {r[0]: r[2] for r in found(spark.createDataFrame(rows, SCHEMA))}
    assert set(got) == {last, None, last - 1} and got[last - 1] == 0
    assert len(found(spark.createDataFrame(rows, SCHEMA))) == 3


def test_names_that_clash(spark):
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, text, "k", 1, 2, "r", 0), (2, text, "l", 3, 4, "s", 0)], "doc_id long, text string, kept string, d int, t int, row string, n_chars long")
    out = suffix_dedup.cut_documents(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, text, "k", 1, 2, "r", len(text)), (2, "", "l", 3, 4, "s", 0)]
