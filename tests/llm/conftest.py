import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, bucket int"  # the last two clash with inner names


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdehinorstu", k=rng.randint(2, 9))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    out = [make(rng.randint(1, 200)) for _ in range(60)]
    base = out[3] = make(180)
    out += [base, base.upper(), base + " tail words here", make(40) + "\n" + base, base[:700] + " changed " + base[700:]]
    for _ in range(25):  # a cluster of near copies
        w = base.split()
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    passage = make(30)
    out += [make(50) + " " + passage + " " + make(50) for _ in range(12)]
    out += ["", " \n\t ", "one", "two words", "a b c d", "a b c d", "x" * 500, "ab" * 400, "é" * 120, "é" * 119 + "z", "中文 " * 60, make(9000)]
    return [*enumerate(out), (len(out), None), (7, out[7]), (None, "no id " + base), (8, "same id, other text " + passage)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[k % 3], "src", len(t or ""), 1, 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
