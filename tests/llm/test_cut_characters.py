from pathquarry.llm import suffix_dedup


def test_cuts_take_whole_characters_and_no_others(spark):
    shared = " ".join(f"w{j}" for j in range(40))
    rows = [(1, f"{shared}\u00e9 first"), (2, f"{shared}\u00e8 second \ufffd kept")]  # both letters start with the same byte
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cut_documents(docs).collect()}
    assert found == {1: (rows[0][1], len(rows[0][1])), 2: (" second \ufffd kept", 14)}
