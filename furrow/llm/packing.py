"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Items are documents cut into pieces of at most the largest length. Pieces are dealt at random into groups of a bounded
size; each group packs its pieces, largest first, into the open bin that they fill best. When none has room, a bin
opens whose length costs least per token that it can expect to hold, judged over all permitted lengths jointly against
the pieces still to come. At the end every bin shrinks to the least permitted length that holds its contents.

Defined cases: a null text is an empty one; every document counts its words and one end token, so an empty one still
takes a place; a longer document than the largest length keeps all its tokens over several pieces; repeated rows are
packed once each; an empty table gives an empty result. Only the id and the text are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import map_texts
from furrow.llm.text_arrays import words
from furrow.storage import materialise

LENGTHS = (512, 1024, 2048, 4096, 8192)


def attention_cost(length: int) -> float:
    """The default cost of a sequence: its tokens, and a quadratic share for attention."""
    return length * (1.0 + length / 32768.0)


def _largest(mask: int, limit: int) -> int:
    """The largest set bit up to ``limit``, or -1."""
    return (mask & ((1 << (limit + 1)) - 1)).bit_length() - 1


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = attention_cost, look: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place in the bin, length of the bin) of each piece; sizes between 1 and the largest length.

    Pieces of equal size keep their order. ``look`` bounds how many sizes an opening looks ahead at.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    left = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()  # pieces to come, by size
    coming = sum(1 << s for s, c in enumerate(left) if c)
    room: dict[int, list[int]] = {}  # open bins by the room they have
    rooms = 0
    capacity: list[int] = []
    used: list[int] = []
    chosen, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    def opening(size: int) -> int:
        best, pick = None, lengths[-1]
        for c in lengths:
            if c < size:
                continue
            rest, filled, limit = c - size, size, c - size
            for _ in range(look):
                s = _largest(coming, min(rest, limit))
                if s < 1:
                    break
                take = min(left[s], rest // s)
                filled, rest, limit = filled + take * s, rest - take * s, s - 1
            price = cost(c) / filled
            if best is None or price < best:
                best, pick = price, c
        return pick

    for i in order.tolist():
        size = int(sizes[i])
        left[size] -= 1
        if not left[size]:
            coming &= ~(1 << size)
        fits = rooms >> size
        if fits:
            have = size + (fits & -fits).bit_length() - 1
            bin_ = room[have].pop()
            if not room[have]:
                rooms &= ~(1 << have)
        else:
            have, bin_ = opening(size), len(capacity)
            capacity.append(have)
            used.append(0)
        chosen[i], place[i] = bin_, used[bin_]
        used[bin_] += size
        now = have - size
        if now:
            room.setdefault(now, []).append(bin_)
            rooms |= 1 << now
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return chosen, place, final[chosen] if len(sizes) else np.zeros(0, np.int64)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = attention_cost, group_pieces: int = 20_000) -> DataFrame:
    """One row per piece: ``id_col``, piece, first_token, n_tokens, bin_id, bin_length, place (first token in the bin).

    Groups have about ``group_pieces`` pieces each, whatever the table's size; a group leaves at most a few bins
    partly filled, so more groups cost almost no room.
    """
    most = max(lengths)
    counted = map_texts(docs, id_col, text_col, lambda data, offsets: [np.bincount(words(data, offsets)[0], minlength=len(offsets) - 1) + 1], [pa.field("tokens", pa.int64())])
    pieces = counted.select(F.col(id_col).alias("id"), "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / F.lit(most)))).alias("piece"))
    pieces = pieces.select(
        "id",
        "piece",
        (F.col("piece") * most).alias("first_token"),
        F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece") * most).alias("n_tokens"),
        F.monotonically_increasing_id().alias("slot"),  # stored, so that a retried task deals the same way
    )
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    kind = dict(pieces.dtypes)["id"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot", ignore_index=True)
        bin_, place, length = pack(part["n_tokens"].to_numpy(), lengths, cost)
        return part[["id", "piece", "first_token", "n_tokens"]].assign(bin_id=bin_ + (int(key[0]) << 32), bin_length=length, place=place)

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    packed = dealt.groupBy("part").applyInPandas(run, f"id {kind}, piece long, first_token long, n_tokens long, bin_id long, bin_length long, place long")
    return packed.withColumnRenamed("id", id_col)
