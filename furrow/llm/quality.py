"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a vector of lexical features, spread over quantile hinges so that a linear score can bend. Preference
pairs set a text of label 1 over one of label 0; the weights minimise the logistic loss of feature differences. All
labelled texts teach: counts, hinges, scales and the threshold come from every one of them, and each is in pairs with at
least ``PARTNERS`` texts of the other class, or with all of them if they are fewer. A text is good if its score is above
the quantile of the labelled texts' scores that leaves the labels' share of 0 below it.

Defined cases: a null text is an empty one, and empty texts and texts of separators only get the features of no
words (all zero), like any other text; without labelled texts of both classes every score is 1 if there is one of label
1, else 0; repeated rows are scored alike, and teach as often as they occur; an empty table gives an empty result. Only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.shared import map_texts
from furrow.llm.text_arrays import SEPARATOR, words
from furrow.storage import materialise, spread

#: In the order of ``features``.
FEATURES = ("log_words", "mean_word", "upper", "digit", "symbol", "stop", "exclaim", "pipe", "wide", "lines", "same_words", "same_lines", "same_pairs", "long_words", "caps_words")

_KIND = {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "symbol": [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-|"],
    "stop": list(b".,;:?"),
    "exclaim": list(b"!"),
    "pipe": list(b"|"),
    "wide": range(0x80, 0x100),
}
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in _KIND.items()}


def _repeats(text: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """Share of the keys of each text that the text has had before."""
    if not len(key):
        return np.zeros(texts)
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    again = np.concatenate([[False], (t[1:] == t[:-1]) & (k[1:] == k[:-1])])
    return np.bincount(t, again, texts) / np.maximum(1, np.bincount(t, minlength=texts))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x FEATURES) of a block."""
    texts = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    text, word = words(data, offsets)
    count = np.bincount(text, minlength=texts)
    some = np.maximum(1, count)
    blank = SEPARATOR[data]
    letters = np.maximum(1, per_text(~blank))
    share = {k: per_text(lut[data]) / letters for k, lut in _LUT.items()}
    newline = np.flatnonzero(data == 10)
    line_text = np.searchsorted(offsets, newline, "right") - 1
    # a line's key: the sum of its words' hashes, cut at newlines and at text ends
    before = np.concatenate([[True], blank[:-1]]) if len(data) else np.zeros(0, bool)
    at_start = np.zeros(len(data), bool)
    at_start[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(~blank & (before | at_start)) if len(data) else np.zeros(0, np.int64)
    line = np.searchsorted(newline, start) + text
    lines, first = np.unique(line, return_index=True)
    keys = np.add.reduceat(word, first) if len(first) else np.zeros(0, np.uint64)
    pair = text[1:] == text[:-1]
    same_pairs = _repeats(text[1:][pair], (word[1:] * np.uint64(0x9E3779B97F4A7C15) + word[:-1])[pair], texts)
    width = np.zeros(len(start))
    if len(start):
        inside = np.concatenate([[0], np.cumsum(~blank)])
        width = np.diff(inside[np.append(start, len(data))]).astype(float)
    upper = np.concatenate([[0], np.cumsum(_LUT["upper"][data])])
    caps = (np.diff(upper[np.append(start, len(data))]) >= 0.8 * width) & (width >= 2) if len(start) else np.zeros(0, bool)
    out = {
        "log_words": np.log1p(count),
        "mean_word": per_text(~blank) / some,
        **share,
        "lines": np.bincount(line_text, minlength=texts) / some,
        "same_words": _repeats(text, word, texts),
        "same_lines": _repeats(text[first], keys, texts),
        "same_pairs": same_pairs,
        "long_words": np.bincount(text, width > 15, texts) / some,
        "caps_words": np.bincount(text, caps, texts) / some,
    }
    return np.stack([np.asarray(out[k], float) for k in FEATURES], axis=1)


@dataclass(frozen=True)
class QualityModel:
    #: hinges of each feature, the scale of each expanded column, weights, threshold and spread of the scores
    knots: tuple[np.ndarray, ...]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (_expand(x, self.knots) - self.mean) / self.scale @ self.weight

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -500, 500)))


def _expand(x: np.ndarray, knots: tuple[np.ndarray, ...]) -> np.ndarray:
    columns = [x] + [np.maximum(0.0, x[:, [k]] - own) for k, own in enumerate(knots) if len(own)]
    return np.concatenate(columns, axis=1)


#: Texts of the larger class to a block, and of the smaller at least; partners of a text, and pairs of a small table.
ROWS, FEW, PARTNERS, PAIRS = 2048, 64, 4, 40_000
#: Where the hinges lie; how finely a pass cuts what is left of a range.
HINGES, EDGES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98), 64

#: The features of a block's texts of label 1 and of label 0, and whether these count here or are another block's copies.
Block = tuple[np.ndarray, np.ndarray, bool, bool]
#: Folds what a function gives for each block, over all blocks.
Each = Callable[..., list[np.ndarray]]


def _own(block: Block) -> np.ndarray:
    good, bad, good_counts, bad_counts = block
    return np.concatenate([good[: len(good) * good_counts], bad[: len(bad) * bad_counts]])


def _folded(blocks: Iterator[Block], step: Callable[[Block], list[np.ndarray] | None], fold: Callable) -> list[np.ndarray] | None:
    total = None
    for found in map(step, blocks):
        if found is not None:
            total = found if total is None else [fold(a, b) for a, b in zip(total, found, strict=True)]
    return total


def _ranked(each: Each, value: Callable[[Block], np.ndarray], ranks: np.ndarray, passes: int) -> np.ndarray:
    """The values of ``ranks`` (columns x ranks, from 0) among all rows of value(block): the range of each narrows
    ``EDGES``-fold a pass."""

    def ends(block):
        v = value(block)
        return [np.stack([-v.min(axis=0), v.max(axis=0)])] if len(v) else None

    (far,) = each(ends, np.maximum)
    low, high = (np.repeat(v[:, None], ranks.shape[1], axis=1) for v in (np.nextafter(-far[0], -np.inf), far[1]))
    for _ in range(passes):
        cuts = np.minimum(low[:, :, None] + (high - low)[:, :, None] * (np.arange(1, EDGES) / EDGES), high[:, :, None])

        def below(block, cuts=cuts):
            v = np.sort(value(block), axis=0)
            return [np.stack([np.searchsorted(v[:, k], c.ravel(), "right").reshape(c.shape) for k, c in enumerate(cuts)])]

        (count,) = each(below)
        beyond = np.concatenate([count > ranks[:, :, None], np.ones((*ranks.shape, 1), bool)], axis=2).argmax(axis=2)[:, :, None]
        bounds = np.concatenate([low[:, :, None], cuts, high[:, :, None]], axis=2)
        low, high = (np.take_along_axis(bounds, beyond + k, axis=2)[:, :, 0] for k in (0, 1))
    return high


def _differences(z: Callable[[np.ndarray], np.ndarray], block: Block, partners: int) -> np.ndarray:
    """Feature differences of a block's pairs: each text of the larger side with ``partners`` of the other."""
    good, bad = z(block[0]), z(block[1])
    many, few = max(len(good), len(bad)), min(len(good), len(bad))
    if not few:
        return np.zeros((0, good.shape[1]))
    own = min(partners, few)
    at = np.tile(np.arange(many), own)
    other = (at + np.repeat(np.arange(own) * (few // own), many)) % few
    return good[at] - bad[other] if len(good) >= len(bad) else good[other] - bad[at]


def _learn(each: Each, good: int, bad: int, share: float, pairs: int = PAIRS, steps: int = 40, decay: float = 1e-4) -> QualityModel:
    """From blocks of ``good`` texts of label 1 and ``bad`` ones of label 0; some passes over all blocks, and sums alone come back."""
    none = np.zeros(len(FEATURES))
    if not good or not bad:
        return QualityModel(tuple(none[:0] for _ in none), none, none + 1, none, -1.0 if good else 1.0, 0.025)
    n = good + bad
    ranks = np.floor(np.array(HINGES) * (n - 1) + 0.5).astype(int)
    knots = tuple(np.unique(v) for v in _ranked(each, _own, np.tile(ranks, (len(FEATURES), 1)), 5))
    mean = each(lambda b: [_expand(_own(b), knots).sum(axis=0)])[0] / n
    scale = np.sqrt(each(lambda b: [((_expand(_own(b), knots) - mean) ** 2).sum(axis=0)])[0] / n)
    scale[scale < 1e-9] = 1.0
    partners = max(PARTNERS, -(-pairs // max(good, bad)))

    def slopes(w):
        """Mean loss of all pairs, its gradient and its second derivatives."""

        def step(block):
            d = _differences(lambda x: (_expand(x, knots) - mean) / scale, block, partners)
            margin = d @ w
            wrong = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
            return [np.array([len(d), np.logaddexp(0.0, -margin).sum()]), -(wrong @ d), (d * (wrong * (1 - wrong))[:, None]).T @ d]

        (count, loss), g, h = each(step)
        return loss / count + decay / 2 * (w @ w), g / count + decay * w, h / count + decay * np.eye(len(w))

    w = np.zeros(len(mean))
    loss, g, h = slopes(w)
    move = -np.linalg.solve(h, g)
    for _ in range(steps):  # Newton's method; a step that would raise the loss is halved
        if -(g @ move) < 1e-9:
            break
        found = slopes(w + move)
        if found[0] > loss:
            move = move / 2
            continue
        w, (loss, g, h) = w + move, found
        move = -np.linalg.solve(h, g)

    def score(block):
        return ((_expand(_own(block), knots) - mean) / scale @ w)[:, None]

    at = min(max(round((1 - share) * n) - 1, 0), n - 1)
    low, high = _ranked(each, score, np.array([[at, min(at + 1, n - 1)]]), 9)[0]
    centre = each(lambda b: [score(b).sum(axis=0)])[0] / n
    deviation = np.sqrt(each(lambda b: [((score(b) - centre) ** 2).sum(axis=0)])[0] / n)[0]
    return QualityModel(knots, mean, scale, w, float((low + high) / 2), float(max(deviation / 3, 1e-6)))


def fit(x: np.ndarray, label: np.ndarray, share: float, **options) -> QualityModel:
    """From all rows of an array; ``share`` is the share of label 1 that the threshold leaves above it."""
    good, bad = x[label == 1], x[label == 0]
    return _learn(lambda step, fold=np.add: _folded(iter([(good, bad, True, True)]), step, fold), len(good), len(bad), share, **options)


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, x) for every row, written once: training and scoring both read it."""

    def rows(data, offsets):
        x = features(data, offsets)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))]

    return materialise(map_texts(docs, id_col, text_col, rows, [pa.field("x", pa.list_(pa.float64()))]), "features")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, len(FEATURES))


def _in_blocks(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """rows(id, label, x) as (good, bad, good_counts, bad_counts), bytes of features each.

    The larger class is dealt over blocks of about ``ROWS`` texts. The smaller one's parts, of about ``FEW`` texts or
    more, are copied to as many blocks as need them and count in one.
    """
    blocks = max(1, -(-max(good, bad) // ROWS))
    parts = max(1, min(blocks, min(good, bad) // FEW))
    larger = int(good >= bad)
    draw = F.xxhash64(F.lit("block"), F.col("id").cast("string"))
    first = F.pmod(draw, F.when(F.col("label") == larger, F.lit(blocks)).otherwise(F.lit(parts)))
    to = F.when(F.col("label") == larger, F.array(first)).otherwise(F.sequence(first, F.lit(blocks - 1).cast("long"), F.lit(parts).cast("long")))
    dealt = spread(rows.select("label", "x", draw.alias("draw"), F.explode(to).alias("block")), "block")

    def pack(key, part):
        label, order = part["label"].to_numpy(), _matrix(part["x"])
        order = order[(by := np.lexsort((*order.T, part["draw"].to_numpy())))]
        sides = [order[label[by] == k].tobytes() for k in (1, 0)]
        counts = [k == larger or key[0].as_py() < parts for k in (1, 0)]
        return pa.table({"good": pa.array(sides[:1], pa.binary()), "bad": pa.array(sides[1:], pa.binary()), "good_counts": counts[:1], "bad_counts": counts[1:]})

    return materialise(dealt.groupBy("block").applyInArrow(pack, "good binary, bad binary, good_counts boolean, bad_counts boolean"), "blocks")


def _each(blocks: DataFrame) -> Each:
    """Folds over the blocks, in executors first; one row of sums a task reaches the driver."""

    def each(step, fold=np.add):
        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield (*(np.frombuffer(r[k]).reshape(-1, len(FEATURES)) for k in ("good", "bad")), r["good_counts"], r["bad_counts"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _folded(unpacked(batches), step, fold)
            if total is not None:
                out = io.BytesIO()
                np.savez(out, *total)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["sums"])

        total = None
        for r in blocks.mapInArrow(run, "sums binary").collect():
            with np.load(io.BytesIO(r["sums"])) as found:
                own = [found[k] for k in found.files]
            total = own if total is None else [fold(a, b) for a, b in zip(total, own, strict=True)]
        return total

    return each


def train_on_features(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options) -> QualityModel:
    """Learn from every row of found(``id_col``, x) that has a label; null labels teach nothing."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = materialise(found.select(F.col(id_col).alias("id"), "x").join(rows, "id"), "labelled")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = count.get(1, 0), count.get(0, 0)
    if not good or not bad:
        return _learn(None, good, bad, 0.0)
    return _learn(_each(_in_blocks(rows, good, bad)), good, bad, good / (good + bad), **options)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> QualityModel:
    """Learn from all labelled texts."""
    return train_on_features(quality_features(docs, id_col, text_col), labels, id_col, label_col, **options)


def score_features(found: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) for every row of found(``id_col``, x)."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    rows = found.select(id_col, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(_matrix(batch.column(1))))], names=[id_col, "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) for every row; 0.5 or more means above the threshold quantile."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, lambda data, offsets: [shared.value.probability(features(data, offsets))], [pa.field("score", pa.float64())])
