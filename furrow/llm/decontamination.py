"""Benchmark decontamination by the q-gram lemma, overlapping diagonal bands and banded alignment.

Texts and benchmark items are lower-cased, and every run of characters that are neither letters nor 0-9 becomes one
space. An item is searched by windows of ``window`` characters every ``stride`` characters (an item shorter than that
is one window). A window with at most k edits shares at least (length - q + 1) - k*q of its q-grams with the place
where it occurs, all on diagonals that lie within k of each other. So: count the distinct shared q-grams in bands of
diagonals, each 2(k+1) wide and overlapping the next by half; retain the windows of bands that reach the bound; and
verify each by a banded semi-global alignment. The bound is exact: no occurrence within the budget of
floor(edits * length) is lost. Where it would fall below one shared q-gram, shorter grams are counted for that item;
an item of fewer than ``q`` characters has no budget and counts where it stands as whole words.

The benchmark is broadcast in blocks of about ``block_chars`` characters, one pass over the documents each; nothing of
the documents is shuffled or collected, and a text's hits are counted piece by piece.

Defined cases: null and empty texts, and items without letters and digits, match nothing; equal items under several
ids are reported one by one, and an item row that repeats, id and text, counts once; repeated document rows report the
same hits; an empty table on either side gives an empty result. Only ids and texts are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text_arrays import blocks, characters, gram_hashes, is_letter

#: log2 of the size of the table that rules most positions out at once.
SIEVE = 22
#: Pairs of a text's place and an item's place that are counted at a time.
HITS = 1 << 22


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, place of each in the lower-cased text) of a block, single spaces between words."""
    cp, starts, ends = characters(data, offsets)
    cp = np.where(is_letter(cp) | ((cp >= 48) & (cp < 58)), cp, np.uint32(32))
    keep = (cp != 32) | np.concatenate([[True], cp[:-1] != 32])
    at = np.flatnonzero(keep)
    before = np.concatenate([[0], np.cumsum(keep)])
    return cp[at], before[starts], before[ends], at


@dataclass(frozen=True)
class Index:
    """The items that are searched by grams of one length."""

    #: of each item: its number in the benchmark, first character, length, window length, edit budget
    number: np.ndarray
    text: np.ndarray
    first: np.ndarray
    size: np.ndarray
    window: np.ndarray
    budget: np.ndarray
    q: int
    stride: int
    #: whether an occurrence must be whole words
    whole: bool
    #: sorted q-gram hashes, where their postings begin, and the postings: item and place in it
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, number: np.ndarray, texts: list[np.ndarray], window: np.ndarray, budget: np.ndarray, q: int, stride: int, whole: bool) -> Index:
        size = np.array([len(t) for t in texts], np.int64)
        hashes = [gram_hashes(t, q) for t in texts]
        every = np.concatenate(hashes)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])
        order = np.argsort(every, kind="stable")
        grams, begin = np.unique(every[order], return_index=True)
        sieve = np.zeros(1 << SIEVE, bool)
        sieve[grams >> np.uint32(32 - SIEVE)] = True
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        return cls(number, np.concatenate(texts), first, size, window, budget, q, stride, whole, grams, np.append(begin, len(every)), item[order], place[order], sieve)


@dataclass(frozen=True)
class Benchmark:
    """An index of one block of items."""

    ids: tuple
    parts: tuple[Index, ...]

    @classmethod
    def build(cls, items: list[tuple], q: int, window: int, stride: int, edits: float) -> Benchmark:
        texts = []
        for _, _, data, offsets in blocks(pa.array([t or "" for _, t in items], pa.large_string())):
            cp, starts, ends, _ = normalise(data, offsets)
            texts += [cp[a:b][1:] if b > a and cp[a] == 32 else cp[a:b] for a, b in zip(starts, ends, strict=True)]
        texts = [t[:-1] if len(t) and t[-1] == 32 else t for t in texts]
        length = np.minimum([len(t) for t in texts], window).astype(np.int64)
        budget = np.where(length < q, 0, (edits * length).astype(np.int64))
        gram = np.minimum(q, length // (budget + 1))  # the longest that leaves a window within its budget one of its grams
        parts = []
        for own in np.unique(gram[length > 0]).tolist():
            for whole in (False, True):
                at = np.flatnonzero((gram == own) & (length > 0) & ((length < q) == whole))
                if len(at):
                    parts.append(Index.build(at, [texts[i] for i in at], length[at], budget[at], max(own, 1), stride, whole))
        return cls(tuple(i for i, _ in items), tuple(parts))


def _places(index: Index, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram's number, text) of the text places whose gram some item has."""
    h = gram_hashes(cp, index.q)
    at = np.flatnonzero(index.sieve[h >> np.uint32(32 - SIEVE)])
    k = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
    same = index.grams[k] == h[at]
    at, k = at[same], k[same]
    text = np.searchsorted(ends, at, "right")
    inside = text < len(ends)
    inside[inside] &= (at[inside] >= starts[text[inside]]) & (at[inside] + index.q <= ends[text[inside]] + 1)
    return at[inside], k[inside], text[inside]


def _regions(index: Index, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, window start, least diagonal) of the windows whose shared q-grams in a band reach the bound.

    Places with more than ``HITS`` postings in all are halved, with an overlap that holds every window of an occurrence.
    """
    at, k, text = _places(index, cp, starts, ends)
    postings = np.concatenate([[0], np.cumsum(index.begin[k + 1] - index.begin[k])])
    reach = int(index.window.max()) + int(index.budget.max()) + 1
    found, ahead = [], [(0, len(at))] if len(at) else []
    while ahead:
        a, b = ahead.pop()
        if postings[b] - postings[a] > HITS and at[b - 1] - at[a] > 4 * reach:
            middle = at[a] + (at[b - 1] - at[a]) // 2
            left, right = np.searchsorted(at, [middle + reach, middle - reach])
            if a < left < b and a < right < b:
                ahead += [(a, int(left)), (int(right), b)]
                continue
        found.append(_counted(index, at[a:b], k[a:b], text[a:b]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    every = np.concatenate([np.stack(f, axis=1) for f in found])
    return tuple((np.unique(every, axis=0) if len(found) > 1 else every).T)


def _counted(index: Index, at: np.ndarray, k: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_regions`` of some places of the texts."""
    count = index.begin[k + 1] - index.begin[k]
    post = np.repeat(index.begin[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at, text, item, place = np.repeat(at, count), np.repeat(text, count), index.item[post].astype(np.int64), index.place[post].astype(np.int64)
    band = (at - place) // (index.budget[item] + 1)
    low, wide = int(band.min(initial=0)) - 1, int(band.max(initial=0)) - int(band.min(initial=0)) + 3
    group = (text * len(index.size) + item) * wide + band - low
    longest = int(index.size.max()) + 1
    # a hit lies in the band that begins at its diagonal's step and in the one before; distinct places count once
    groups, which = np.unique(np.concatenate([group, group - 1]), return_inverse=True)
    hits = np.unique(which * longest + np.concatenate([place, place]))
    bands, begin = np.unique(hits // longest, return_index=True)
    item = groups[bands] // wide % len(index.size)
    need = index.window[item] - index.q + 1 - index.budget[item] * index.q
    full = np.diff(np.append(begin, len(hits))) >= need
    bands, item, need = bands[full], item[full], need[full]
    windows = -(-(index.size[item] - index.window[item]) // index.stride) + 1
    which = np.repeat(np.arange(len(bands)), windows)
    number = np.arange(len(which)) - np.repeat((np.cumsum(windows) - windows), windows)
    begin_at = np.minimum(number * index.stride, (index.size - index.window)[item[which]])
    base = bands[which] * longest
    shared = np.searchsorted(hits, base + begin_at + index.window[item[which]] - index.q + 1) - np.searchsorted(hits, base + begin_at)
    keep = shared >= need[which]
    which, begin_at = which[keep], begin_at[keep]
    diagonal = (groups[bands] % wide + low) * (index.budget[item] + 1)
    return groups[bands][which] // wide // len(index.size), item[which], begin_at, diagonal[which]


def _align(
    index: Index, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray, diagonal: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end of the best occurrence) of each window in its band; one budget and window length."""
    k, length = int(index.budget[item[0]]), int(index.window[item[0]])
    width = 2 * (k + 1) + 2 * k
    base = begin + diagonal - k
    steps = np.arange(width)
    cost = np.zeros((len(text), width), np.int32)
    low, high = starts[text][:, None], ends[text][:, None]
    for r in range(length):
        p = base[:, None] + r + steps
        there = np.where((p >= low) & (p < high), cp[np.clip(p, 0, len(cp) - 1)], 0)
        now = cost + (there != index.text[index.first[item] + begin + r][:, None])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - steps, axis=1) + steps
    best = cost.argmin(axis=1)
    return cost[np.arange(len(text)), best], base + length + best


def _whole_words(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether spaces, or the text's ends, lie around the places from ``first`` up to ``last``."""
    before = (first <= starts[text]) | (cp[np.maximum(first - 1, 0)] == 32)
    return before & ((last >= ends[text]) | (cp[np.minimum(last, len(cp) - 1)] == 32))


def find_items(bench: Benchmark, data: np.ndarray, offsets: np.ndarray, batch: int = 4096) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, least edits, windows found, first and last place) for each pair of a text and an item in it."""
    cp, starts, ends, at = normalise(data, offsets)
    found: dict[tuple[int, int], list] = {}
    origin = None
    for index in bench.parts:
        regions = _regions(index, cp, starts, ends)
        if not len(regions[0]):
            continue
        origin = characters(data, offsets)[1] if origin is None else origin
        shape = np.stack([index.window[regions[1]], index.budget[regions[1]]], axis=1)
        for kind in np.unique(shape, axis=0):
            rows = np.flatnonzero((shape == kind).all(axis=1))
            for a in range(0, len(rows), batch):
                text, item, begin, diagonal = (x[rows[a : a + batch]] for x in regions)
                edits, end = _align(index, cp, starts, ends, text, item, begin, diagonal)
                good = edits <= index.budget[item]
                if index.whole:
                    good &= _whole_words(cp, starts, ends, text, end - index.window[item], end)
                for j in np.flatnonzero(good):
                    t, i = int(text[j]), int(index.number[item[j]])
                    last = int(at[min(end[j], len(at)) - 1] + 1 - origin[t])
                    first = int(at[min(max(end[j] - index.window[item[j]], starts[t]), len(at) - 1)] - origin[t])
                    own = found.setdefault((t, i), [int(edits[j]), set(), first, last])
                    own[0] = min(own[0], int(edits[j]))
                    own[1].add(int(begin[j]))
                    own[2], own[3] = min(own[2], first), max(own[3], last)
    return [(t, i, e, len(w), a, b) for (t, i), (e, w, a, b) in sorted(found.items())]


def index_benchmark(
    benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", q: int = 10, window: int = 80, stride: int = 20,
    edits: float = 0.08, block_chars: int = 4_000_000,
) -> list[Broadcast]:
    """Broadcast indexes of the items, in blocks that a running count of characters closes; the driver holds one at a time."""
    if not 0 <= edits < 1:
        raise ValueError("edits must be at least 0 and below 1")
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col), F.coalesce(F.col(item_text_col), F.lit(""))).distinct()
    found, held, size = [], [], 0

    def close() -> None:
        own = sorted(held, key=lambda r: (r[0] is None, r[0], r[1]))
        found.append(spark.sparkContext.broadcast(Benchmark.build([tuple(r) for r in own], q, window, stride, edits)))

    for row in rows.toLocalIterator():
        held.append(row)
        size += len(row[1]) + 1
        if size >= block_chars:
            close()
            held, size = [], 0
    if held or not found:
        close()
    return found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options
) -> DataFrame:
    """(``id_col``, ``item_col``, edits, windows, start, end): one row per document and item found in it.

    ``options`` are those of ``index_benchmark``; ``edits`` is the share of a window's characters that may differ.
    ``start`` and ``end`` delimit, in characters of the lower-cased text and up to the edit budget, the stretch in which
    the item's windows were found.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, windows int, start long, end long"

    def search(bench: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = bench.value
            for batch in batches:
                for a, _, data, offsets in blocks(batch.column(1)):
                    hits = find_items(index, data, offsets)
                    if hits:
                        text, item, *rest = zip(*hits, strict=True)
                        columns = [batch.column(0).take(pa.array([a + t for t in text])), pa.array([index.ids[i] for i in item])]
                        numbers = [pa.array(x, kind) for x, kind in zip(rest, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                        yield pa.RecordBatch.from_arrays([*columns, *numbers], names=["id", "item", "edits", "windows", "start", "end"])

        return rows.mapInArrow(run, schema)

    hits = reduce(DataFrame.unionByName, map(search, index_benchmark(benchmark, item_col, item_text_col, **options)))
    return hits.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in whose text an item was found; all columns stay as they are.

    Each row is judged by its own text within one pass over all columns; nothing is joined or shuffled.
    """

    def sift(left: DataFrame, bench: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in blocks(batch.column(text_col)):
                    keep[[a + hit[0] for hit in find_items(bench.value, data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        return left.mapInArrow(run, left.schema)

    return reduce(sift, index_benchmark(benchmark, **options), docs)
