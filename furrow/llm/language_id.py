"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams per language are summed in Spark over a bounded, deterministic sample of the labelled texts
(``quota`` a language); smoothed log-probabilities form a matrix (buckets x languages) that is broadcast. Scoring
gathers the matrix rows of a block's n-grams and sums them per text, which is the product of the sparse count matrix
with the dense one. Whole texts are read, in training and in scoring.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; so does every text if nothing was
learned; equal posteriors resolve to the alphabetically first language; repeated rows are scored alike; an empty
table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import map_texts, sample_by_class
from furrow.llm.text_arrays import blocks, characters, gram_hashes, is_letter

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: log-probabilities, less each bucket's mean over the languages; buckets x languages
    matrix: np.ndarray
    sizes: tuple[int, ...]


def _grams(cp: np.ndarray, n: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of the n-grams that have no space inside and more than spaces, in text order."""
    blank = cp == 32
    h = gram_hashes(cp, n) & np.uint32(mask)
    bad = blank[1 : len(h) + 1] if n > 2 else blank[: len(h)] & blank[n - 1 : len(h) + n - 1]
    at = np.flatnonzero(~bad)
    return h[at], at


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quota: int = 1500, buckets: int = 1 << 16, sizes: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.5) -> LanguageModel:
    """Learn from about ``quota`` texts of each language; rows with a null language teach nothing."""
    rows = sample_by_class(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "id", "lang", quota)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for a, b, data, offsets in blocks(batch.column(1)):
                cp, _, ends = characters(data, offsets)
                for n in sizes:
                    h, at = _grams(cp, n, buckets - 1)
                    of = np.searchsorted(ends, at, "right")
                    for name in set(lang[a:b]):
                        own = (lang[a:b] == name)[np.minimum(of, b - a - 1)]
                        totals[name] = totals.get(name, 0) + np.bincount(h[own], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"lang": list(totals), "counts": [x.tobytes() for x in totals.values()]}, pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    def add(key, part):
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in part["counts"]], axis=0)
        return pa.table({"lang": [key[0].as_py()], "counts": [total.tobytes()]})

    # the sample is bounded, so a fixed number of partitions is too; one row of counts a language comes back
    parts = rows.select("lang", "text").repartition(16).mapInArrow(count, "lang string, counts binary")
    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in parts.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()}
    languages = tuple(sorted(got))
    if not languages:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), sizes)
    counts = np.array([got[x] for x in languages], float) + smoothing
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return LanguageModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), sizes)


def score_texts(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text of a block."""
    texts = len(offsets) - 1
    cp, starts, ends = characters(data, offsets)
    letters = np.concatenate([[0], np.cumsum(is_letter(cp))])
    has = letters[ends] > letters[starts]
    if not model.languages:
        return [UNDETERMINED] * texts, np.zeros(texts)
    total = np.zeros((texts, len(model.languages)))
    for n in model.sizes:
        h, at = _grams(cp, n, len(model.matrix) - 1)
        first = np.searchsorted(at, starts - 1)
        some = np.flatnonzero(np.diff(first, append=len(at)))
        if len(some):
            total[some] += np.add.reduceat(model.matrix[h], first[some], axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(has, odds[np.arange(texts), best] / odds.sum(axis=1), 0.0)
    return [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, has, strict=True)], score


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
    return map_texts(docs, id_col, text_col, lambda data, offsets: list(score_texts(shared.value, data, offsets)), fields)


def keep_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5, languages: frozenset[str] | None = None) -> DataFrame:
    """``docs`` without the rows rejected: undetermined texts, posteriors under ``least``, languages not asked for.

    The filter runs within one pass over all columns; nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for _, _, data, offsets in blocks(batch.column(text_col)):
                names, score = score_texts(shared.value, data, offsets)
                keep += [n != UNDETERMINED and s >= least and (languages is None or n in languages) for n, s in zip(names, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
