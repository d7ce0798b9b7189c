"""An interpolated modified Kneser-Ney model of order two or three, counted in Spark and memory-mapped by the workers
that score.

Tokens are words (A-Z lower-cased) and one end per text. Counting runs in three shuffles, all of them on arrays that a
task has sorted and merged beforehand, never on single tokens:

1. words: sorted (hash, count) arrays by ranges of the hash; a word's id is its rank;
2. bigrams: sorted (id pair, count) arrays, dealt by a hash of the pair, so that a frequent word's many bigrams spread
   over all shards; each shard merges its arrays and writes them to the shared folder;
3. contexts: per word, how many bigrams it begins with counts 1, 2 and more (the back-off weight) and how many it
   ends (the continuation count), merged from the shards' partial sums.

Order three counts trigrams instead of bigrams, dealt by their first two words, so that a context's counts meet in one
shard; a shard's arrays are hashes of trigrams, sorted. A bigram's count then is that of its distinct trigrams' ends.

The model is files of sorted arrays in the shared folder. Scoring workers map them and look up the distinct words and
bigrams of each block by binary search; nothing of the model passes through the driver but sums per shard. Shards are
as many as the input asks for, so that one of them fits a task at any size. A file that is missing is an error.

Defined cases: null and empty texts are one end token; a word unseen in training has the probability of an unknown
word; after an unseen word the continuation probability stands alone; without training texts every token is unknown
with probability 1; where the counts of counts give no positive discount, as in a few texts repeated over and over, a
fixed one stands in, so that every text has a positive probability; repeated rows count, and are scored, once each; an
empty table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import atexit
import io
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import map_texts
from furrow.llm.text_arrays import blocks, mix, words
from furrow.storage import materialise, new_folder

END = np.uint64(0x5EED0FE4D0000001)
#: Tokens that a counting task sorts at a time.
CHUNK = 1 << 21
#: Bytes of text for each shard of words, and tokens for each shard of bigrams; both are upper bounds of its entries.
WORD_SHARD, PAIR_SHARD = 1 << 26, 1 << 21
#: Discounts of counts 1, 2 and more where none can be estimated.
FALLBACK = (0.5, 1.0, 1.5)
BLOBS = "shard long, keys binary, counts binary"


# files in the shared folder

def _where(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name and move, so that a retried task leaves one whole file."""
    fs, path = _where(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part := f"{path}/{name}.{uuid.uuid4().hex}") as out:
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
        out.write(head.getvalue())
        out.write(np.ascontiguousarray(array).data)
    fs.move(part, f"{path}/{name}.npy")


_mapped: dict[tuple[str, str], np.ndarray] = {}
_copies: list[str] = []


def _load(folder: str, name: str) -> np.ndarray:
    """The array, mapped; from a store that is no local path, a copy of the worker's own that goes when it ends.

    A missing file is an error: it was lost, or the folder is not shared.
    """
    key = (folder, name)
    if key not in _mapped:
        fs, path = _where(folder)
        local = f"{path}/{name}.npy"
        if not isinstance(fs, arrow_fs.LocalFileSystem):
            if not _copies:
                _copies.append(tempfile.mkdtemp())
                atexit.register(shutil.rmtree, _copies[0], ignore_errors=True)
            own = f"{_copies[0]}/{uuid.uuid4().hex}.npy"
            arrow_fs.copy_files(local, own, source_filesystem=fs, destination_filesystem=arrow_fs.LocalFileSystem())
            local = own
        _mapped[key] = np.load(local, mmap_mode="r")
    return _mapped[key]


# sorted arrays as blobs: byte planes of differences, which compress well

def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _encode(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _decode(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _merge(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of each kind of value."""
    if not keys:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in values])
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        return (k, *[np.zeros(0, np.int64) for _ in values])
    return (k[first], *[np.add.reduceat(np.concatenate(v)[order].astype(np.int64), first) for v in values])


def _blob_rows(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOBS; ``shard`` and, within a shard, ``keys`` are ascending."""
    names, first = np.unique(shard, return_index=True)
    cuts = [slice(a, b) for a, b in zip(first, np.append(first, len(keys))[1:], strict=True)]
    columns = [pa.array(names.astype(np.int64)), pa.array([_encode(keys[c]) for c in cuts], pa.binary()), pa.array([_planes(counts[c].astype(np.uint32)) for c in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the words of each text and, after them, its end."""
    text, word = words(data, offsets)
    texts = len(offsets) - 1
    out = np.empty(len(word) + texts, np.uint64)
    out[np.arange(len(word)) + text] = word
    ends = np.searchsorted(text, np.arange(texts), "right") + np.arange(texts)
    out[ends] = END
    return np.repeat(np.arange(texts), np.diff(np.concatenate([[-1], ends]))), out


@dataclass(frozen=True)
class Discounts:
    """Modified Kneser-Ney's three discounts, from how many n-grams have counts 1 to 4."""

    values: tuple[float, float, float]

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
        return cls(tuple(d if d > 0 else f for d, f in zip(raw, FALLBACK, strict=True)))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.values])[np.minimum(counts, 3)]


@dataclass(frozen=True)
class LanguageModel:
    folder: str
    #: log2 of the number of word shards; ids at which they begin, then the number of words
    bits: int
    begin: np.ndarray
    #: whether each shard of bigrams holds any
    filled: np.ndarray
    train_tokens: int
    train_texts: int
    discounts: Discounts
    continuation: Discounts
    #: distinct bigrams; shares left for the unknown word and after the start of a text
    types: int
    rest: float
    start_total: int
    start_weight: float
    #: whether each shard of trigrams holds any, none for order two; their discounts
    triples: np.ndarray
    top: Discounts

    @property
    def words(self) -> int:
        return int(self.begin[-1])

    def lookup(self, word: np.ndarray, with_model: bool = True) -> tuple[np.ndarray, ...]:
        """(id or -1, count, continuation count, total and back-off weight as a context) of sorted distinct word hashes."""
        ids = np.full(len(word), -1, np.int64)
        count, ends, total = (np.zeros(len(word), np.int64) for _ in range(3))
        weight = np.zeros(len(word))
        shard = (word >> np.uint64(64 - self.bits)).astype(np.int64)
        names, first = np.unique(shard, return_index=True)
        for s, a, b in zip(names, first, np.append(first, len(word))[1:], strict=True):
            if self.begin[s] == self.begin[s + 1]:
                continue
            keys = _load(self.folder, f"word-{s}")
            at = np.minimum(np.searchsorted(keys, word[a:b]), len(keys) - 1)
            known = np.flatnonzero(keys[at] == word[a:b])
            ids[a + known] = at[known] + self.begin[s]
            if with_model:
                count[a + known] = _load(self.folder, f"count-{s}")[at[known]]
                ends[a + known] = _load(self.folder, f"ends-{s}")[at[known]]
                weight[a + known] = _load(self.folder, f"weight-{s}")[at[known]]
                # of bigrams a context's total is its count; no context is an end
                total[a + known] = _load(self.folder, f"total-{s}")[at[known]] if len(self.triples) else count[a + known]
        return ids, count, ends, total, weight

    def pair_counts(self, pair: np.ndarray) -> np.ndarray:
        """Counts of distinct bigram keys."""
        out = np.zeros(len(pair), np.int64)
        shard = _pair_shard(pair, len(self.filled))
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for s, a, b in zip(names, first, np.append(first, len(pair))[1:], strict=True):
            if self.filled[s]:
                keys, own = _load(self.folder, f"pair-{s}"), order[a:b]
                at = np.minimum(np.searchsorted(keys, pair[own]), len(keys) - 1)
                out[own] = np.where(keys[at] == pair[own], _load(self.folder, f"pair-count-{s}")[at], 0)
        return out

    def triple(self, pair: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, total and back-off weight of the context) of trigrams: keys of the first two words, ids of the third or -1."""
        count, total, weight = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64), np.zeros(len(pair))
        shard = _pair_shard(pair, len(self.triples))
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for s, a, b in zip(names, first, np.append(first, len(pair))[1:], strict=True):
            if not self.triples[s]:
                continue
            own = order[a:b]
            keys = _load(self.folder, f"context-{s}")
            at = np.minimum(np.searchsorted(keys, pair[own]), len(keys) - 1)
            known = np.flatnonzero(keys[at] == pair[own])
            own, at = own[known], at[known]
            total[own] = _load(self.folder, f"context-total-{s}")[at]
            weight[own] = _load(self.folder, f"context-kinds-{s}")[at] @ np.array(self.top.values) / total[own]
            keys, asked = _load(self.folder, f"triple-{s}"), _triple_key(pair[own], third[own].astype(np.uint64))
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            count[own] = np.where((keys[at] == asked) & (third[own] >= 0), _load(self.folder, f"triple-count-{s}")[at], 0)
        return count, total, weight

    def score(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, train_tokens, base_score and score of each text of a block."""
        text, token = tokens(data, offsets)
        texts = len(offsets) - 1
        distinct, which = np.unique(token, return_inverse=True)
        ids, count, ends, context, weight = self.lookup(distinct)
        base = np.log10((count + 0.1) / (self.train_tokens + 0.1 * (self.words + 1)))
        alone = np.maximum(ends - self.continuation(ends), 0) / max(1, self.types) + self.rest / (self.words + 1)
        start = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        before = np.concatenate([[0], which[:-1]]) if len(which) else which
        u = np.where(start, self.words, ids[before]) if len(which) else ids[:0]
        total = np.where(start, self.start_total, context[before]) if len(which) else count[:0]
        share = np.where(start, self.start_weight, weight[before]) if len(which) else weight[:0]
        v = ids[which]
        found = np.zeros(len(v), np.int64)
        ask = np.flatnonzero((u >= 0) & (v >= 0))
        pair, back = np.unique(u[ask].astype(np.uint64) * np.uint64(self.words + 1) + v[ask].astype(np.uint64), return_inverse=True)
        found[ask] = self.pair_counts(pair)[back]
        p = np.where(total > 0, (found - self.discounts(found)) / np.maximum(1, total) + share * alone[which], alone[which])
        if len(self.triples):
            before = np.where(start, self.words, np.concatenate([[0], u[:-1]]) if len(u) else u)
            ask = np.flatnonzero((before >= 0) & (u >= 0))
            found, total, share = self.triple(before[ask].astype(np.uint64) * np.uint64(self.words + 1) + u[ask].astype(np.uint64), v[ask])
            own = (found - self.top(found)) / np.maximum(1, total) + share * p[ask]
            p[ask] = np.where(total > 0, own, p[ask])
        known = np.bincount(text, count[which] > 0, texts).astype(np.int64)
        return [np.bincount(text, minlength=texts), known, np.full(texts, self.train_tokens), np.bincount(text, base[which], texts), np.bincount(text, np.log10(p), texts)]


def _pair_shard(pair: np.ndarray, pairs: int) -> np.ndarray:
    return (mix(pair) % np.uint64(pairs)).astype(np.int64)


def _triple_key(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    return mix(mix(pair) + third * np.uint64(0x9E3779B97F4A7C15))


def _triples_merged(pair: np.ndarray, third: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct contexts, place of each trigram's context, third word, count) of the distinct trigrams, ascending."""
    contexts, rank = np.unique(pair, return_inverse=True)
    key, counts = _merge([(rank.astype(np.uint64) << np.uint64(32)) | third.astype(np.uint64)], [counts])
    return contexts, (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


def train_language_model(docs: DataFrame, text_col: str = "text", shards: int | None = None, order: int = 2) -> LanguageModel:
    """Count ``docs`` and write the model to a new folder under the shared one.

    ``order`` is 2 or 3. ``shards``: of bigrams, and of trigrams, by their number if None.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(text_col)
    folder = new_folder(spark, "language-model")
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, size / WORD_SHARD))))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk in _ended(batches):
            if chunk is not None:
                for _, _, data, offsets in blocks(chunk):
                    held.append(tokens(data, offsets)[1])
                    size += len(held[-1])
                    if size >= CHUNK:
                        keys, counts = np.unique(np.concatenate(held), return_counts=True)
                        yield _blob_rows(keys >> np.uint64(64 - bits), keys, counts)
                        held, size = [], 0
            elif held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield _blob_rows(keys >> np.uint64(64 - bits), keys, counts)

    def merge_words(key, part):
        s = key[0].as_py()
        keys, counts = _merge([_decode(x.as_py()) for x in part["keys"]], [_unplanes(x.as_py(), np.uint32) for x in part["counts"]])
        _save(folder, f"word-{s}", keys)
        _save(folder, f"count-{s}", counts)
        end = np.flatnonzero(keys == END)
        return pa.table({"shard": [s], "words": [len(keys)], "tokens": [int(counts.sum())], "texts": [int(counts[end].sum())]})

    found = rows.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(merge_words, "shard long, words long, tokens long, texts long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in found:
        sizes[r["shard"]] = r["words"]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    if begin[-1] >= 1 << 32:
        raise ValueError("more than 2**32 distinct words do not fit the bigram keys")
    tokens_, texts = sum(r["tokens"] for r in found), sum(r["texts"] for r in found)
    pairs = shards or max(8, -(-tokens_ // PAIR_SHARD))
    none = np.zeros(0, bool)
    model = LanguageModel(folder, bits, begin, np.zeros(pairs, bool), tokens_, texts, Discounts(FALLBACK), Discounts(FALLBACK), 0, 1.0, texts, 1.0, none, Discounts(FALLBACK))
    if not texts:
        return model

    def pair_rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        shard = _pair_shard(keys, pairs)
        order = np.argsort(shard, kind="stable")
        return _blob_rows(shard[order], keys[order], counts[order])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, np.uint64(model.words + 1)
        for chunk in _ended(batches):
            if chunk is not None:
                for _, _, data, offsets in blocks(chunk):
                    text, token = tokens(data, offsets)
                    distinct, which = np.unique(token, return_inverse=True)
                    v = model.lookup(distinct, with_model=False)[0][which].astype(np.uint64)
                    u = np.concatenate([[np.uint64(model.words)], v[:-1]])
                    u[1:][text[1:] != text[:-1]] = model.words
                    held.append(u * base + v)
                    size += len(v)
                    if size >= CHUNK:
                        yield pair_rows(held)
                        held, size = [], 0
            elif held:
                yield pair_rows(held)

    def triple_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pair, third = (np.concatenate(h) for h in zip(*held, strict=True))
        contexts, at, third, counts = _triples_merged(pair, third, np.ones(len(pair), np.int64))
        shard = _pair_shard(contexts, pairs)[at]
        order = np.argsort(shard, kind="stable")
        found = _blob_rows(shard[order], contexts[at][order], counts[order])
        cuts = np.append(np.unique(shard[order], return_index=True)[1], len(order))
        thirds = [_planes(third[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return found.append_column("thirds", pa.array(thirds, pa.binary()))

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, np.uint64(model.words + 1)
        for chunk in _ended(batches):
            if chunk is not None:
                for _, _, data, offsets in blocks(chunk):
                    text, token = tokens(data, offsets)
                    distinct, which = np.unique(token, return_inverse=True)
                    w = model.lookup(distinct, with_model=False)[0][which].astype(np.uint64)
                    first = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
                    v = np.where(first, np.uint64(model.words), np.concatenate([[np.uint64(0)], w[:-1]]))
                    u = np.where(first, np.uint64(model.words), np.concatenate([[np.uint64(0)], v[:-1]]))
                    held.append((u * base + v, w.astype(np.uint32)))
                    size += len(w)
                    if size >= CHUNK:
                        yield triple_rows(held)
                        held, size = [], 0
            elif held:
                yield triple_rows(held)

    def merge_triples(key, part):
        s = key[0].as_py()
        pair = np.concatenate([_decode(x.as_py()) for x in part["keys"]])
        third, counts = (np.concatenate([_unplanes(x.as_py(), np.uint32) for x in part[c]]) for c in ("thirds", "counts"))
        contexts, at, third, counts = _triples_merged(pair, third, counts)
        hashes = _triple_key(contexts[at], third.astype(np.uint64))
        order = np.argsort(hashes)
        _save(folder, f"triple-{s}", hashes[order])
        _save(folder, f"triple-count-{s}", _narrow(counts[order]))
        _save(folder, f"context-{s}", contexts)
        _save(folder, f"context-total-{s}", _narrow(np.bincount(at, counts, len(contexts)).astype(np.int64)))
        kinds = [np.bincount(at, mask, len(contexts)) for mask in (counts == 1, counts == 2, counts >= 3)]
        _save(folder, f"context-kinds-{s}", np.stack(kinds, axis=1).astype(np.uint32))
        base = np.uint64(model.words + 1)
        ends = pair_rows([(contexts % base)[at] * base + third.astype(np.uint64)])
        sums = [s, *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
        columns = [pa.concat_arrays([c, pa.array([none], c.type)]) for c, none in zip(ends.columns, (-1, b"", b""), strict=True)]
        return pa.table([*columns, pa.array([None] * ends.num_rows + [sums], pa.list_(pa.int64()))], names=[*ends.schema.names, "n"])

    partial = "shard long, kind int, ids binary, a binary, b binary, c binary, d binary, n array<long>"

    def merge_pairs(key, part):
        s = key[0].as_py()
        keys, counts = _merge([_decode(x.as_py()) for x in part["keys"]], [_unplanes(x.as_py(), np.uint32) for x in part["counts"]])
        _save(folder, f"pair-{s}", keys)
        _save(folder, f"pair-count-{s}", _narrow(counts))
        base = np.uint64(model.words + 1)
        rows = [(-1, s, b"", b"", b"", b"", b"", [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])]
        totals = [[counts]] if order == 3 else []
        u, *kinds = _merge([keys // base], [counts == 1], [counts == 2], [counts >= 3], *totals)
        v, ends = _merge([keys % base], [np.ones(len(keys), np.int64)])
        for kind, ids, values in ((0, u, kinds), (1, v, [ends])):
            cut = np.searchsorted(ids, np.append(begin, model.words + 1).astype(np.uint64))
            for shard in np.flatnonzero(np.diff(cut)):
                own = slice(cut[shard], cut[shard + 1])
                blobs = [_planes(x[own].astype(np.uint32)) for x in values]
                rows.append((int(shard), kind, _encode(ids[own]), *blobs, *[b""] * (4 - len(blobs)), None))
        return pa.table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("ids", "a", "b", "c", "d")], ("n", pa.list_(pa.int64()))])
    if order == 2:
        counted, triples, top = rows.mapInArrow(count_pairs, BLOBS), none, Discounts(FALLBACK)
    else:
        found = rows.mapInArrow(count_triples, BLOBS + ", thirds binary").groupBy("shard")
        found = materialise(found.applyInArrow(merge_triples, BLOBS + ", n array<long>"), "triples")
        merged = [r["n"] for r in found.where("shard < 0").collect()]
        counted, triples, top = found.where("shard >= 0").drop("n"), np.zeros(pairs, bool), Discounts.of(np.sum([n[1:] for n in merged], axis=0).tolist())
        triples[[n[0] for n in merged]] = True
    parts = materialise(counted.groupBy("shard").applyInArrow(merge_pairs, partial), "contexts")
    merged = parts.where("shard < 0").select("kind", "n").collect()  # five numbers a shard
    filled = np.zeros(pairs, bool)
    filled[[r["kind"] for r in merged]] = True
    types, *n = np.sum([r["n"] for r in merged], axis=0).tolist()
    discounts = Discounts.of(n)

    def merge_contexts(key, part):
        s = key[0].as_py()
        size = int(sizes[s]) if s < len(sizes) else 1
        low = np.uint64(begin[s] if s < len(sizes) else model.words)
        left, ends, total = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for kind, ids, *blobs, sums in zip(*(part[c].to_pylist() for c in ("kind", "ids", "a", "b", "c", "d")), strict=True):
            at = (_decode(ids) - low).astype(np.int64)
            if kind:
                ends[at] += _unplanes(blobs[0], np.uint32)
            else:
                left[at] += sum(d * _unplanes(x, np.uint32) for d, x in zip(discounts.values, blobs, strict=True))
                if order == 3:
                    total[at] += _unplanes(sums, np.uint32)
        if order == 2:
            total = _load(folder, f"count-{s}") if s < len(sizes) else np.array([model.train_texts])
        else:
            _save(folder, f"total-{s}", total)
        weight = left / np.maximum(1, total)
        _save(folder, f"ends-{s}", ends)
        _save(folder, f"weight-{s}", weight)
        n = [int((ends == k).sum()) for k in (1, 2, 3, 4)] + [int((ends >= 3).sum())]
        return pa.table({"shard": [s], "weight": [float(weight[-1])], "total": [int(total[-1])], "n": [n]})

    got = parts.where("shard >= 0").drop("n").groupBy("shard").applyInArrow(merge_contexts, "shard long, weight double, total long, n array<long>").collect()
    n = np.sum([r["n"] for r in got if r["shard"] < len(sizes)], axis=0).tolist()
    continuation = Discounts.of(n[:4])
    rest = sum(d * x for d, x in zip(continuation.values, (n[0], n[1], n[4]), strict=True)) / max(1, types)
    start = next(r for r in got if r["shard"] == len(sizes))  # every text begins
    return LanguageModel(folder, bits, begin, filled, tokens_, texts, discounts, continuation, types, rest, start["total"], start["weight"], triples, top)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array | None]:
    """The text columns, then None."""
    for batch in batches:
        yield batch.column(0)
    yield None


def score_texts(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # shard sizes and sums; the arrays stay in files
    fields = [pa.field(n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")] + [pa.field(n, pa.float64()) for n in ("base_score", "score")]
    out = map_texts(docs, id_col, text_col, lambda data, offsets: shared.value.score(data, offsets), fields)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
