"""Rows that repeat, ids that several texts share, ties, long texts and clashing names, through filters and pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import decontamination, exact_dedup, ngram_join
from tests.llm.test_small_tables import brute_join, tokens

ITEM = "the heron stood by the old stone bridge while seven grey barges drifted slowly towards the harbour mouth at dusk"
random = np.random.default_rng(8)
WORDS = "the and with that house water old boat".split()


def text(n):
    return " ".join(f"{w} {k}" for w, k in zip(random.choice(WORDS, n).tolist(), random.integers(0, 10**6, n).tolist()))


A, B, C, LONG = text(40), text(40), text(40), text(30_000)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_a_text_that_shares_its_id_with_a_copy_stays(spark):
    docs = spark.createDataFrame([(1, A), (6, A + " end"), (6, B), (8, C), (8, C), (None, B + " tail"), (9, ""), (9, None)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(0) for c in ("key", "kept", "gone_id", "gone_key", "node", "first", "component", "n")})
    left = ngram_join.keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert kept(left.where("doc_id is null or doc_id < 9")) == [(1, A), (6, B), (8, C), (None, B + " tail")]
    assert left.where("doc_id = 9").count() == 2


def test_equal_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, A)] * 5 + [(2, B), (None, C), (None, C), (3, B), (3, B), (4, None), (4, "")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "digest", "gone_id", "gone_key")})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert [(i, t or "") for i, t in kept(left)] == [(1, A), (3, B), (4, ""), (None, C)]
    assert exact_dedup.drop_copies(docs.where("doc_id = 2")).count() == 1


def test_a_clean_text_that_shares_its_id_with_a_contaminated_one_stays(spark):
    docs = spark.createDataFrame([(1, A), (1, f"{A} {ITEM}"), (None, ITEM), (None, B), (2, f"{LONG} {ITEM} {LONG}"), (3, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (None, "")], "item_id long, text string")
    assert kept(decontamination.drop_contaminated(docs, bench)) == sorted([(1, A), (3, LONG), (None, B)], key=lambda r: (r[0] is None, r))


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Repeated ids and rows, ties, long texts and columns with the operators' own names, against brute force."""
    rows = [(i, text(20)) for i in range(30)]
    rows += [(6, rows[3][1]), (6, text(25)), (6, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (31, LONG), (32, LONG), (33, LONG + " tail"), (33, C)]
    rows += [(40, f"{text(30)} {ITEM}"), (40, B), (41, None), (41, ""), (42, "12 34"), (43, A), (44, A + " end"), (45, A + " tail"), (46, A), (46, A)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("id", "key", "kept", "node", "bucket", "slot", "piece", "score", "digest")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {(i, t) for i, t in rows if any(c.isalpha() for c in t or "")}
    last = {}
    for i, t in left:
        last[t] = max(i, last.get(t, i))
    left = sorted((i, t) for i, t in left if last[t] == i)
    joined = brute_join(enumerate(t for _, t in left), 5, 80, 100)
    first = {}
    for k, (i, t) in enumerate(left):
        first[joined[k][1]] = min(first.get(joined[k][1], (i, t)), (i, t))
    want = collections.Counter((i, len(tokens(t)) + 1) for k, (i, t) in enumerate(left) if first[joined[k][1]] == (i, t) and ITEM not in t)
    found = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id].append((r.piece, r.n_tokens))
    rows_of, tokens_of = collections.Counter(), collections.Counter()
    for (i, n), times in want.items():
        rows_of[i] += times
        tokens_of[i] += n * times
    assert rows_of == collections.Counter({i: sum(p == 0 for p, _ in pieces) for i, pieces in found.items()})
    assert tokens_of == collections.Counter({i: sum(n for _, n in pieces) for i, pieces in found.items()})
    assert rows_of[6] == 3 and rows_of[40] == 1 and 41 not in rows_of


def spans(item, window, stride):
    size = min(len(item), window)
    return sorted({*range(0, len(item) - size + 1, stride), len(item) - size}), size


def least_edits(pattern, text):
    """The least edits of a pattern against any stretch of a text, by the textbook's table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j - 1] + (p != t), before[j] + 1, row[j - 1] + 1))
    return min(row)


@pytest.mark.parametrize("hits", [decontamination.HITS, 64])
def test_occurrences_equal_all_alignments(spark, monkeypatch, hits):
    """Items of 1 to 120 characters with edits up to and beyond the budget, against every window of every item."""
    import pyarrow as pa

    from furrow.llm.text_arrays import buffers

    monkeypatch.setattr(decontamination, "HITS", hits)
    letters = list("abcdefgh ")
    draw = np.random.default_rng(17)

    def word(n):
        return " ".join("".join(draw.choice(letters, n).tolist()).split()) or "a"

    def edited(s, k):
        for _ in range(k):
            at, kind = int(draw.integers(0, len(s))), int(draw.integers(0, 3))
            s = s[:at] + ("" if kind == 0 else str(draw.choice(letters[:-1]))) + s[at + (kind < 2) :]
        return s

    q, window, stride, share = 10, 40, 13, 0.08
    items = [word(int(n)) for n in [1, 2, 3, 5, 8, 9, *draw.integers(10, 120, 30)]]
    texts = ["", "a" * 400]
    for item in items:
        for most in (2, 5):
            start = int(draw.integers(0, max(1, len(item) // 3)))
            part = edited(item[start:], int(draw.integers(0, most)))
            texts.append(" ".join(f"{word(int(draw.integers(1, 30)))} {part} {word(20)}".split()))
    bench = decontamination.Benchmark.build(list(enumerate(items)), q, window, stride, share)
    found = {(t, i): (e, w) for t, i, e, w, _, _ in decontamination.find_items(bench, *buffers(pa.array(texts)))}
    want = {}
    for t, whole in enumerate(texts):
        whole = " ".join(whole.split())
        for i, item in enumerate(items):
            begins, size = spans(item, window, stride)
            if len(item) < q:
                if f" {item} " in f" {whole} ":
                    want[t, i] = (0, 1)
                continue
            edits = [least_edits(item[b : b + size], whole) for b in begins]
            good = [e for e in edits if e <= int(share * size)]
            if good:
                want[t, i] = (min(good), len(good))
    assert len(want) > 60 and any(e for e, _ in want.values())
    assert found == want
