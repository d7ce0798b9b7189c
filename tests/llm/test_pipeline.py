"""The pipeline's stages in a row, on a small table, against brute force."""

import collections

import numpy as np

import corpus_pipeline
from tests.llm.test_small_tables import brute_join, tokens

ITEM = "the heron stood by the old stone bridge while seven grey barges drifted slowly towards the harbour mouth at dusk"


def test_stages(spark, tmp_path):
    random = np.random.default_rng(5)
    words = {"en": "the and with that house water old boat".split(), "de": "und der mit dass Häuser Wasser alt Boot".split()}
    lang = ["en", "de"] * 60
    texts = [" ".join(random.choice(words[k], 40).tolist()) + f" {i}" for i, k in enumerate(lang)]
    texts[3], texts[4], texts[9] = texts[2], None, "12 34 56"
    texts[11] = texts[10] + " more"
    texts[20] = texts[20] + " " + ITEM
    lang[3] = lang[2]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "packing"]

    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    last = {t: i for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    joined = brute_join(kept.items(), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if joined[i][1] == i and ITEM not in t}
    assert 20 not in kept and 2 not in kept and 11 not in kept and len(kept) > 100

    found = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id] += r.n_tokens
    assert found == {i: len(tokens(t)) + 1 for i, t in kept.items()}
    stage = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert stage.columns == docs.columns
    none = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        none = function(spark, none, str(tmp_path))
    assert none.count() == 0
