import math
import random

import numpy as np

from pathquarry.llm import toxicity

SCHEMA = "doc_id long, text string, score string, toxic int, bytes int, n int"


def plain_score(net, text):
    """The network by its definition: one window, one word and one number at a time."""
    p = {k: np.asarray(v, dtype=np.float64) for k, v in net.p.items()}
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    words = (text or "").encode().lower().split()

    def entered(word):
        import zlib

        w = b"<" + word + b">"
        grams = [zlib.crc32(w[i : i + 3]) % toxicity.TRIGRAMS for i in range(len(w) - 2)]
        return p["words"][net.vocabulary.get(word, 0)] + sum(p["chars"][g] for g in grams) / len(grams)

    def states(xs, d):
        state, out = np.zeros(h), []
        for x in xs:
            a, b = x @ p[f"{d}W"] + p[f"{d}c"], state @ p[f"{d}U"]
            z, r = [sig(v) for v in a[:h] + b[:h]], [sig(v) for v in a[h : 2 * h] + b[h : 2 * h]]
            new = [math.tanh(a[2 * h + k] + r[k] * b[2 * h + k]) for k in range(h)]
            state = np.array([new[k] + z[k] * (state[k] - new[k]) for k in range(h)])
            out.append(state)
        return out

    best, at = -math.inf, 0
    while True:
        xs = [entered(w) for w in words[at : at + toxicity.WINDOW]]
        if xs:
            s = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
            e = [np.tanh(x @ p["A"]) @ p["v"] for x in s]
            a = [math.exp(x - max(e)) for x in e]
            pooled = sum(x * y for x, y in zip(a, s, strict=True)) / sum(a)
        else:
            pooled = np.zeros(2 * h)
        best = max(best, float(pooled @ p["o"] + p["bias"][0]))
        at += toxicity.STEP
        if at + toxicity.WINDOW - toxicity.STEP >= len(words):
            return sig(net.slope * best + net.shift)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.choice([0, 1, 5, 23, 24, 25, 47, 48, 49, 72, 73, 130]))
        if i % 4 == 0 and w:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "SCUM"])
        out.append(" ".join(w))
    return out


def test_scores_equal_plain_loops():
    sample = texts(200)
    net = toxicity.train(sample, [int(i % 4 == 0) for i in range(200)], 0.25)
    more = [*texts(40, 2), "", " \n ", "x" * 5000]
    found = toxicity.Scorer(net).score(more)
    assert np.abs(found - [plain_score(net, t) for t in more]).max() < 2e-4
    halves = toxicity.Scorer(net)
    assert np.allclose(np.concatenate([halves.score(more[:20]), halves.score(more[20:])]), found, atol=1e-6)


def test_repeats_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    rows = [(i, t, "s", 1, 2, 3) for i, t in enumerate(texts(300))]
    rows += [rows[4]] * 50 + [(8, "another text of this id", "s", 0, 0, 0), (7000, "word " * 500_000 + "idiot", "s", 0, 0, 0), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(300)] + [(7000, 1, 1, "x"), (4, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    found = toxicity.score_documents(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    found = found.collect()
    assert len(found) == len(rows) and np.ptp([r.score for r in found if r.doc_id == 4]) < 1e-5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 0
    some = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, some).count() == 0
