"""URL filters: explicit host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host (with all its subdomains) and the start of a path; the longest rule that fits decides. Other urls
go to boosted trees over length, depth, digit ratio, entropy, parameter counts and smoothed block rates of the host's
suffixes, trained by logistic loss from labelled urls: a bounded, deterministic sample of ``quota`` urls a class.

Features are computed on the bytes of whole blocks of urls. The trees learn what labels they are given; where these are
the rules' own verdicts, they extend the rules to urls that look alike, and know nothing else.

Defined cases: host and path are empty for a null url and for one without ``://``, and no rule fits those; equal urls
get equal verdicts; rules of equal length resolve to the alphabetically first; urls of any length are scored whole;
without labels of both classes the trees allow everything unless only blocked urls were seen; an empty table gives an
empty result. Only the id and the url are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import sample_by_class
from furrow.llm.text_arrays import LOWER, blocks, buffers, mix, spans_hash

#: In the order of ``lexical``; the suffixes' statistics follow.
LEXICAL = (
    "length", "host_length", "path_length", "host_depth", "path_depth", "digits", "hyphens", "symbols", "entropy", "host_entropy", "parameters", "fragment",
    "secure", "longest_part",
)
SUFFIXES = ("last_label", "last_two", "first_path", "last_label_and_first_path")
#: Characters of a sampled url that the trees learn from.
LONG = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? , # or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: np.ndarray, data: np.ndarray, texts: int) -> np.ndarray:
    """Bits a byte of each text; ``text`` is each byte's."""
    counts = np.bincount(text * 256 + data, minlength=256 * texts).reshape(texts, 256)
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    return -np.sum(share * np.log2(np.where(share > 0, share, 1.0)), axis=1) + 0.0


def _following(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the ascending ``places`` from each start on, or the end."""
    at = np.searchsorted(places, start)
    return np.minimum(np.append(places, np.iinfo(np.int64).max)[at], end)


def lexical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(urls x LEXICAL, urls x SUFFIXES): features and hashes of the suffix keys of a block of urls, as bytes.

    Bytes beyond ASCII count as letters. A url without ``://`` is all scheme; its host and path are empty.
    """
    texts, size = len(offsets) - 1, np.diff(offsets)
    start, end = offsets[:-1], offsets[1:]
    text = np.repeat(np.arange(texts), size)
    where = {c: np.flatnonzero(data == ord(c)) for c in ":/?#.&"}
    colon = where[":"][where[":"] + 2 < len(data)]
    colon = colon[(data[colon + 1] == ord("/")) & (data[colon + 2] == ord("/"))]
    scheme = _following(colon[colon + 2 < end[text[colon]]], start, end)
    host = np.minimum(scheme + 3, end)
    host_end = _following(np.flatnonzero(np.isin(data, list(b"/?#"))), host, end)
    path_end = _following(np.flatnonzero(np.isin(data, list(b"?#"))), host_end, end)
    mark = _following(where["#"], path_end, end)  # the query lies between

    def total(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[b] - sums[a]

    digit = (data >= 48) & (data < 58)
    lower = LOWER[data] if len(data) else data
    letter = digit | ((lower >= 97) & (lower < 123)) | (data >= 128)
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    of_host = (np.arange(len(data)) >= host[text]) & (np.arange(len(data)) < host_end[text])
    dots = total(data == ord("."), host, host_end)
    parts = total((data != ord("/")) & (before == ord("/")), host_end, path_end)
    # a parameter begins after the question mark or an ampersand, unless another ampersand follows
    begins = (data != ord("&")) & ((before == ord("&")) | (before == ord("?")) & (np.arange(len(data)) == path_end[text] + 1))
    parameters = total(begins, np.minimum(path_end + 1, mark), mark)
    new = np.zeros(len(data) + 1, bool)
    new[start[size > 0]] = True
    first = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | new[:-1]))
    last = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | new[1:] | (np.arange(len(data)) == len(data) - 1)))
    longest = np.zeros(texts)
    np.maximum.at(longest, text[first], last - first + 1)
    secure = scheme - start == 5
    for k, c in enumerate(b"https"):
        secure[secure] &= lower[start[secure] + k] == c
    n = np.maximum(1, size)
    features = (
        size, host_end - host, path_end - host_end, dots + 1, parts,
        total(digit, start, end) / n, total(data == ord("-"), start, end) / n, total(~letter, start, end) / n,
        _entropy(text, data, texts), _entropy(text[of_host], data[of_host], texts), parameters, total(data == ord("#"), start, end) > 0, secure, longest,
    )

    dot = where["."]
    at = np.searchsorted(dot, host_end)
    labels = [np.maximum(host, np.where(at >= k, dot[np.maximum(at - k, 0)] + 1 if len(dot) else 0, 0)) for k in (1, 2)]
    slash = _following(np.flatnonzero((data != ord("/")) & (before == ord("/"))), host_end, path_end)
    part_end = _following(where["/"], slash, path_end)
    last_label, last_two = (spans_hash(lower, a, host_end) for a in labels)
    part = spans_hash(data, slash, part_end)
    keys = np.stack([last_label, last_two, part, mix(last_label * np.uint64(3) + part)], axis=1)
    return np.stack([np.asarray(f, float) for f in features], axis=1), keys


@dataclass(frozen=True)
class Tree:
    #: of each node: feature (-1: a leaf), threshold, the two next nodes, value
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            k = np.flatnonzero(inner)
            node = at[k]
            at[k] = np.where(x[k, self.feature[node]] <= self.threshold[node], self.below[node], self.above[node])
        return self.value[at]


@dataclass(frozen=True)
class UrlModel:
    trees: tuple[Tree, ...]
    base: float
    rate: float
    #: of each kind of suffix: ascending keys and their block rates; ``prior`` for unseen keys
    rates: tuple[tuple[np.ndarray, np.ndarray], ...]
    prior: float

    def matrix(self, features: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = []
        for k, (known, rate) in enumerate(self.rates):
            at = np.minimum(np.searchsorted(known, keys[:, k]), max(0, len(known) - 1))
            found.append(np.where(known[at] == keys[:, k], rate[at], self.prior) if len(known) else np.full(len(keys), self.prior))
        return np.column_stack([features, *found])

    def probability(self, urls: list[str | None]) -> np.ndarray:
        return self.score(*buffers(pa.array(urls, pa.large_string())))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of a block of each url of a block of urls."""
        x = self.matrix(*lexical(data, offsets))
        logit = np.full(len(x), self.base)
        for tree in self.trees:
            logit += self.rate * tree(x)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, shrink: float) -> Tree:
    """One regression tree on gradients by histograms of binned features."""
    nodes: list[list] = []

    def leaf(rows: np.ndarray) -> float:
        return float(-g[rows].sum() / (h[rows].sum() + shrink))

    def split(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, leaf(rows)])
        if level == depth or len(rows) < 2:
            return at
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best, choice = 1e-6, None
        for f, own in enumerate(edges):
            if not len(own):
                continue
            left_g = np.cumsum(np.bincount(bins[rows, f], g[rows], len(own) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[rows, f], h[rows], len(own) + 1))[:-1]
            gain = left_g**2 / (left_h + shrink) + (total_g - left_g) ** 2 / (total_h - left_h + shrink) - total_g**2 / (total_h + shrink)
            gain[(left_h < least) | (total_h - left_h < least)] = 0.0
            k = int(gain.argmax())
            if gain[k] > best:
                best, choice = gain[k], (f, k)
        if choice:
            f, k = choice
            under = bins[rows, f] <= k
            nodes[at][:2] = [f, edges[f][k]]
            nodes[at][2] = split(rows[under], level + 1)
            nodes[at][3] = split(rows[~under], level + 1)
        return at

    split(np.arange(len(g)), 0)
    feature, threshold, below, above, value = map(np.array, zip(*nodes, strict=True))
    return Tree(feature.astype(int), threshold.astype(float), below.astype(int), above.astype(int), value.astype(float))


def fit(
    urls: list[str | None], blocked: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0, shrink: float = 1.0, smooth: float = 20.0
) -> UrlModel:
    """Boosted trees for the probability that a url is blocked; deterministic."""
    share = float(blocked.mean()) if len(blocked) else 0.0
    base = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not 0.0 < share < 1.0:
        none = np.zeros(0, np.uint64), np.zeros(0)
        return UrlModel((), base, rate, tuple(none for _ in SUFFIXES), share)
    features, keys = lexical(*buffers(pa.array(urls, pa.large_string())))
    rates = []
    for k in range(len(SUFFIXES)):
        known, which = np.unique(keys[:, k], return_inverse=True)
        seen, hit = np.bincount(which), np.bincount(which, blocked)
        rates.append((known, (hit + smooth * share) / (seen + smooth)))
    x = UrlModel((), base, rate, tuple(rates), share).matrix(features, keys)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    logit, grown = np.full(len(x), base), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-logit))
        grown.append(_grow(bins, edges, p - blocked, p * (1 - p), depth, least, shrink))
        logit += rate * grown[-1](x)
    return UrlModel(tuple(grown), base, rate, tuple(rates), share)


def train_url_model(labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str = "verdict", quota: int = 4000, **options) -> UrlModel:
    """Learn from about ``quota`` urls of each label (block or allow); rows with another label teach nothing.

    The sample's urls come to the driver, each up to its first ``LONG`` characters; longer ones are scored whole.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(label_col).alias("label")).where("label in ('block', 'allow')")
    found = sample_by_class(rows, "id", "label", quota).select("id", F.coalesce(F.substring("url", 1, LONG), F.lit("")).alias("url"), "label").collect()
    found.sort(key=lambda r: (r["url"], r["label"]))
    return fit([r["url"] for r in found], np.array([r["label"] == "block" for r in found], float), **options)


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(``id_col``, host, path, rule, verdict, score) for every row; score is the trees' probability of a block."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                score = pa.array(shared.value.score(data, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, score], names=["id", "url", "score"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = dict(rows.dtypes)["id"]
    scored = rows.mapInArrow(run, f"id {kind}, url string, score double")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    scored = scored.select("id", host.alias("host"), path.alias("path"), "score").withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
