"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character 3- to 5-grams (word ends included), a text's the
mean of its words'; a linear softmax over two classes follows. Unseen misspellings share most n-grams with the words
they distort. Both layers train together by Adam on a bounded, deterministic sample of labelled texts (``quota`` a
class, weighted back to the classes' true shares). As both layers are linear, scoring folds them into one scalar per
n-gram bucket, which is broadcast.

Defined cases: null and empty texts, and texts of separators only, score as the bias alone; without labels of both
classes every score is the share of label 1, or 0 without any label; repeated rows are scored alike; an empty table
gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import map_texts, sample_by_class
from furrow.llm.text_arrays import blocks, characters, gram_hashes

#: Averages of many words are small numbers; this brings logits within reach of a usual learning rate.
SCALE = 50.0


@dataclass(frozen=True)
class ToxicityModel:
    #: per bucket: the embedding's logit of class 1 less that of class 0
    weight: np.ndarray
    bias: float
    sizes: tuple[int, ...]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start and end of each word, its text's index)."""
    cp, _, ends = characters(data, offsets)
    inside = cp != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return cp, start, end, np.searchsorted(ends, start, "right")


def _rows(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's sparse matrix (text, bucket, weight): weights of a text's words are equal and add up to SCALE."""
    cp, start, end, text = _words(data, offsets)
    grams = sum(np.maximum(0, end - start + 3 - n) for n in sizes)
    each = SCALE / np.maximum(1, grams) / np.maximum(1, np.bincount(text, minlength=len(offsets) - 1))[text]
    keys, weights = [], []
    for n in sizes:
        count = np.maximum(0, end - start + 3 - n)
        at = np.repeat(start - 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())
        keys.append(np.repeat(text, count) * buckets + (gram_hashes(cp, n)[at] & np.uint32(buckets - 1)))
        weights.append(np.repeat(each, count))
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key // buckets, key % buckets, np.bincount(which, np.concatenate(weights), len(key))


def fit(
    doc: np.ndarray, bucket: np.ndarray, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 17, dim: int = 8,
    steps: int = 300, rate: float = 0.1, seen: int = 3, salience: float = 3.5, patience: int = 40, seed: int = 7,
) -> ToxicityModel:
    """Embeddings and softmax trained jointly, full batch, deterministic, on the sparse matrix (doc, bucket, x).

    A fifth of the texts steers the stop: training ends ``patience`` steps after their loss was least, and the
    parameters of that step count. Only buckets used by ``seen`` texts or more, and by the texts of one class
    more often than of the other by ``salience`` standard errors, carry vectors: a mean over hundreds of words would
    otherwise drown a few telling ones in the noise of all the rest.
    """
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    if not 0.0 < share < 1.0:
        return ToxicityModel(np.zeros(buckets), 40.0 if share else -40.0, sizes)
    n, ones = len(labels), int(labels.sum())
    with_one = np.bincount(bucket, labels[doc], buckets)
    with_any = np.bincount(bucket, minlength=buckets)
    p = np.clip(with_any / n, 1.0 / n, 1 - 1.0 / n)
    z = (with_one / ones - (with_any - with_one) / (n - ones)) / np.sqrt(p * (1 - p) * (1 / ones + 1 / (n - ones)))
    keep = ((with_any >= seen) & (np.abs(z) >= salience))[bucket]
    used, bucket = np.unique(bucket[keep], return_inverse=True)
    doc, x = doc[keep], x[keep]
    random = np.random.default_rng(seed)
    params = [random.uniform(-1.0 / dim, 1.0 / dim, (len(used), dim)), random.normal(0.0, 0.5, (dim, 2)), np.array([np.log(1 - share), np.log(share)])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steer = random.permutation(n) % 5 == 0 if n >= 50 else np.zeros(n, bool)
    learn = np.where(steer, 0.0, weights)
    learn = learn / learn.sum()
    best, best_at, kept = np.inf, 0, params
    for t in range(1, steps + 1):
        e, w, b = params
        logit = np.bincount(doc, x * (e @ (w[:, 1] - w[:, 0]))[bucket], n) + b[1] - b[0]
        loss = np.logaddexp(0, np.where(labels == 1, -logit, logit))
        now = float((loss * weights)[steer].sum()) if steer.any() else -t
        if now < best:
            best, best_at, kept = now, t, params
        elif t - best_at >= patience:
            break
        g = (1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))) - labels) * learn  # of class 1; class 0 has its negative
        back = np.bincount(bucket, x * g[doc], len(used))
        grads = (np.outer(back, w[:, 1] - w[:, 0]), np.outer(e.T @ back, [-1.0, 1.0]), np.array([-g.sum(), g.sum()]))
        new = []
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            new.append(params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8))
        params = new
    e, w, b = kept
    weight = np.zeros(buckets)
    weight[used] = e @ (w[:, 1] - w[:, 0])
    return ToxicityModel(weight, float(b[1] - b[0]), sizes)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quota: int = 1000, sizes: tuple[int, ...] = (3, 4, 5),
    buckets: int = 1 << 17, **options,
) -> ToxicityModel:
    """Learn from about ``quota`` labelled texts of each class; null labels teach nothing.

    What reaches the driver are the sample's sparse rows, at most one number a bucket for each text however long it is.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = sample_by_class(rows, "id", "label", quota)  # about 2 * quota rows of two numbers: a proven bound for the broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                doc, bucket, weight = _rows(data, offsets, sizes, buckets)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                lists = [pa.ListArray.from_arrays(cuts.astype(np.int32), v) for v in (bucket.astype(np.int32), weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["label", "bucket", "weight"])

    got = found.select("label", "text").mapInArrow(matrix, "label int, bucket array<int>, weight array<float>").toArrow()
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got["label"], got["bucket"], got["weight"])]
    length = np.diff(lists[1].offsets.to_numpy())
    keys = [lists[k].flatten().to_numpy() for k in (1, 2)]
    # in an order that does not depend on which partition came first
    begin = np.cumsum(length) - length
    first = np.zeros(len(length))
    some = length > 0
    if some.any():
        first[some] = np.add.reduceat(keys[0].astype(np.int64) * (keys[0].astype(np.int64) + 1), begin[some])
    y = lists[0].to_numpy().astype(float)
    order = np.lexsort((first, length, y))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(rank, length)
    y = y[order]
    at = np.argsort(doc, kind="stable")
    each = [share.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)]
    return fit(doc[at], keys[0][at].astype(np.int64), keys[1][at].astype(float), y, np.where(y == 1, each[1], each[0]), sizes, buckets, **options)


def score_texts(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of class 1 of each text of a block."""
    cp, start, end, text = _words(data, offsets)
    total, count = np.zeros(len(start)), np.zeros(len(start))
    for n in model.sizes:
        sums = np.concatenate([[0.0], np.cumsum(model.weight[gram_hashes(cp, n) & np.uint32(len(model.weight) - 1)])])
        own = np.maximum(0, end - start + 3 - n)  # n-grams of the word with a space on either side
        total += sums[np.minimum(start - 1 + own, len(sums) - 1)] - sums[np.minimum(start - 1, len(sums) - 1)]
        count += own
    texts = len(offsets) - 1
    mean = np.bincount(text, total / np.maximum(1, count), texts) / np.maximum(1, np.bincount(text, minlength=texts))
    return 1.0 / (1.0 + np.exp(-np.clip(SCALE * mean + model.bias, -500, 500)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, lambda data, offsets: [score_texts(shared.value, data, offsets)], [pa.field("score", pa.float64())])
