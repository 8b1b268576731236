"""The pipeline's stages against plain versions of their decisions."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    words = "the house and the garden with some water near a long road to the old town where people meet on market days"
    texts = [words, words, words + " extra", None, "12 34 !!", "other text about trains and boats with token = abcdef12 inside of it"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)
    kept = first(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 5] and kept.columns == docs.columns
    kept = second(spark, kept, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 5] and kept.columns == docs.columns
    kept = third(spark, kept, "")
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[5]["text"] == "other text about trains and boats with [assign] inside of it" and rows[5]["n_chars"] == len(rows[5]["text"]) and rows[0]["text"] == words
    packed = last(spark, kept, "").collect()
    assert {r["doc_id"] for r in packed} == {0, 5} and sorted(r["offset"] for r in packed)[0] == 0
