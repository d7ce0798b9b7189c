"""Rows without an id among rows with one."""

from furrow.llm.ngram_join import ngram_join


def test_a_null_id_does_not_hide_a_later_copy(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " end")], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in ngram_join(docs).collect()} == {(None, None), (1, 1), (2, 1)}
