import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_dedup import linked, removed
from test_text_operators import SECRETS, plain_counts, spans
from tokenizers import Tokenizer

import corpus_pipeline


def redacted(text):
    out, at = "", 0
    for a, b in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans(text)):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline(rows):
    rows = [(i, t) for i, t in rows if i is not None and not plain_counts(t)[-1]]
    least = linked(rows)
    rows = [(i, t) for i, t in rows if least[i] == i]
    order = sorted(set(rows))
    cut = {i: bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g).decode("utf-8", "ignore") for (i, t), gone in zip(order, removed([t.encode() for _, t in order]), strict=True)}
    rows = [(i, redacted(cut[i])) for i, _ in rows]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            out[i, k, len(part) // 4, zlib.crc32(part)] += 1
    return out


def test_pipeline(spark, texts, tmp_path):
    rows = [(i, t) for i, t in texts if not (t or "").startswith("same id")]
    rows += [(500 + k, f"{' '.join(f'word{k}x{j}' for j in range(40))} {s}") for k, s in enumerate(s for s in SECRETS if s)]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == plain_pipeline(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "best-fit packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
