"""The language model where counts are few, files are missing, or tables are awkward."""

import collections
import math
from pathlib import Path

import numpy as np
import pytest

from furrow.llm import language_model
from furrow.llm.language_model import Discounts
from tests.llm.test_small_tables import TEXTS, tokens


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_repeated_texts_leave_every_text_possible(spark):
    model = language_model.train_language_model(docs(spark, ["a b"] * 4))
    assert all(d > 0 for d in (*model.discounts.values, *model.continuation.values))
    found = {r.doc_id: r for r in language_model.score_texts(docs(spark, ["a b", "a zz", "b a", "zz", "", None, "zz yy xx"]), model).collect()}
    assert all(math.isfinite(r.score) and math.isfinite(r.perplexity) and r.score < 0 for r in found.values())
    assert found[0].score == max(r.score for r in found.values() if r.n_tokens == 3)


@pytest.mark.parametrize("n", [[0, 0, 0, 0], [4, 0, 0, 0], [0, 3, 1, 0], [10, 5, 2, 40], [1, 100, 100, 100]])
def test_discounts_are_positive_and_leave_counts_positive(n):
    values = Discounts.of(n).values
    assert all(0 < d <= k for d, k in zip(values, (1, 2, 3)))


@pytest.mark.parametrize("name", ["pair-", "pair-count-", "ends-", "weight-"])  # training has mapped the others
def test_a_missing_file_is_an_error(spark, name):
    model = language_model.train_language_model(docs(spark, ["a b c", "c d e a"]))
    folder = Path(model.folder.removeprefix("file://"))
    gone = [p for p in folder.glob("*.npy") if p.name.startswith(name) and p.name.removeprefix(name)[0].isdigit()]
    assert gone
    for p in gone:
        p.unlink()
    with pytest.raises(Exception, match="No such file"):
        language_model.score_texts(docs(spark, ["a b c d"]), model).collect()


def plain_model(train, order):
    """Interpolated modified Kneser-Ney of any order, from the definition: p(context, word)."""
    sents = [["<s>"] * (order - 1) + tokens(t) + [None] for t in train]
    counts = {order: collections.Counter(tuple(s[k : k + order]) for s in sents for k in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discount, total, left = {}, {}, {}
    for n, own in counts.items():
        of = [sum(v == k for v in own.values()) for k in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        raw = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else k * y for k in (1, 2, 3)]
        discount[n] = [0.0] + [d if d > 0 else f for d, f in zip(raw, (0.5, 1.0, 1.5))]
        total[n], left[n] = collections.Counter(), collections.Counter()
        for g, c in own.items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += discount[n][min(c, 3)]
    words = len({w for s in sents for w in s if w != "<s>"})

    def p(context, word):
        n = len(context) + 1
        lower = p(context[1:], word) if context else 1 / (words + 1)
        if not total[n][context]:
            return lower
        c = counts[n][(*context, word)]
        return (c - discount[n][min(c, 3)]) / total[n][context] + left[n][context] / total[n][context] * lower

    return p, {w for s in sents for w in s if w != "<s>"}


@pytest.mark.parametrize("order, shards", [(2, None), (2, 5), (3, None), (3, 1), (3, 37)])
def test_every_order_equals_its_definition(spark, order, shards):
    random = np.random.default_rng(order)
    made = [" ".join(random.choice(list("abcdefghij"), int(n), p=np.arange(10, 0, -1) / 55).tolist()) for n in random.integers(0, 40, 60)]
    train, scored = [*TEXTS[:12], *made, *made[:9]], [*TEXTS[:13], *made[:20], "a b unseen c d", "unseen a", "unseen unheard"]
    p, words = plain_model(train, order)
    for context in (("<s>",) * (order - 1), ("a", "b")[: order - 1], ("b", "never")[: order - 1]):
        assert sum(p(context, w) for w in words) + p(context, "never") == pytest.approx(1.0)
    model = language_model.train_language_model(docs(spark, train), shards=shards, order=order)
    found = {r.doc_id: r for r in language_model.score_texts(docs(spark, scored), model).collect()}
    for i, t in enumerate(scored):
        s = ["<s>"] * (order - 1) + tokens(t) + [None]
        want = sum(math.log10(p(tuple(s[k - order + 1 : k]), s[k])) for k in range(order - 1, len(s)))
        assert found[i].score == pytest.approx(want, rel=1e-9) and found[i].n_tokens == len(s) - order + 1


def test_the_order_is_two_or_three(spark):
    with pytest.raises(ValueError):
        language_model.train_language_model(docs(spark, ["a"]), order=4)
    model = language_model.train_language_model(docs(spark, []), order=3)
    assert {r.score for r in language_model.score_texts(docs(spark, ["a b", None]), model).collect()} == {0.0}
