from collections import Counter

import corpus_pipeline
from pathquarry.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=60):
    return " ".join(f"{name}{j}" for j in range(n))


def test_filters_apply_to_rows(spark, tmp_path):
    near = words("a") + " more"
    rows = [
        (1, words("a")), (1, "too short"), (2, near), (2, words("b")), (3, words("c")), (3, words("c") + " more"), (4, words("d")), (4, words("d")),
        (None, words("e")), (None, words("e")), (None, words("a") + " other"), (None, words("f")), (None, None), (None, "short"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if t and len(t.split()) >= 20)
    found = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path)).collect()]
    c = [x for x in found if x[0] == 3]
    assert len(c) == 1 and c[0] in rows  # near copies under one id: one stays
    assert Counter(x for x in found if x[0] != 3) == Counter([(1, words("a")), (2, words("b")), (4, words("d")), (4, words("d")), (None, words("e")), (None, words("f"))])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter([1, 2, 3, 4, 4, None, None])
