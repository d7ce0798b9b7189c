"""N-gram Jaccard join: globally ordered shingle sets, prefix filtering, and prefix trees over whole sets.

1. Order. One pass counts, chunk by chunk, the shingles that several texts of a chunk share, and one in ``RARE`` of the
   others, so that a shingle spread thinly over many chunks shows as well. About the ``order_size`` most frequent (a
   fixed bound) go last in the global order, by count, all others first, by hash. Any order gives the same result;
   this one keeps passages that many texts share out of the prefixes.
2. Prefixes. Two sets at the threshold or above share a shingle among the first |x| - ceil(t|x|) + 1 of each. Texts
   with equal sets are one class from here on, so copies cost nothing.
3. Buckets. Among the classes that have a shingle in their prefixes, the least is the leader; a class goes to the
   bucket of each of its leaders. Two similar classes share a prefix shingle, so they meet in its leader's bucket.
   Groups are never listed: a group costs a row per member.
4. Trees. Each bucket's whole sets form a prefix tree that is traversed once per set, sharing the overlaps of common
   paths and pruning by remaining length; sets already connected are not compared. A bucket of more than
   ``bucket_grams`` shingles (and more than ``LEAST`` sets) is cut into blocks of sets of like size, each with the
   leader. What is connected after that, in whatever bucket, needs no more comparing: of a bucket of copies hardly
   anything is left. The sets outside a bucket's largest component are gathered in blocks of their own, each of which
   is compared with the bucket's blocks of compatible sizes. No pair is ever emitted, only one link per set.
5. Components of the links, by star contraction.

Shingles are 64-bit hashes, classes 128-bit sums of them. Links join classes, so an id that several texts share joins
only those that are alike.

Defined cases: a null or empty text, or one of separators only, has an empty set and is linked with nothing, not even
its like; fewer words than ``n`` form one shingle; equal sets (repeated rows too) are linked; a row with a null id
takes no part and has itself, null, as component; rows that share an id have a result each; an empty table gives an
empty result. Only the id and the text are read, so other columns cannot clash. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.prefix_tree import link_sets
from furrow.llm.shared import keep_chosen, text_key
from furrow.llm.text_arrays import blocks, mix, shingles, words
from furrow.operators.components import connected_components
from furrow.storage import materialise

#: Shingles that the first pass sorts at a time.
CHUNK = 1 << 21
#: Of the shingles that a chunk holds once, one in 2**6 counts.
RARE = 6
#: Steps of the logarithm of counts by which the global order's table is cut off.
STEPS = 16
#: Sets that one block may always hold; rows of three numbers that are broadcast.
LEAST, FEW_NODES = 32, 1 << 18
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class GlobalOrder:
    """The frequent shingles, sorted by hash, and their ranks; every other shingle comes before them."""

    grams: np.ndarray
    rank: np.ndarray

    def prefix(self, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``size`` of a set given in order of hash: those outside this table, and those in it."""
        if not len(self.grams):
            return grams[:size], grams[:0]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        frequent = self.grams[at] == grams
        rare = grams[~frequent]
        last = grams[frequent][np.argsort(self.rank[at[frequent]], kind="stable")]
        return rare[:size], last[: max(0, size - len(rare))]


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles in order of hash) of every text of a batch that has any."""
    for a, b, data, offsets in blocks(column):
        grams, at = shingles(*words(data, offsets), n, b - a)
        for i in np.flatnonzero(np.diff(at)):
            yield a + int(i), grams[at[i] : at[i + 1]]


def _class_of(grams: np.ndarray) -> tuple[int, int]:
    one, two = int(mix(grams).sum(dtype=np.uint64)), int(mix(grams ^ _SALT).sum(dtype=np.uint64))
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def count_frequent(rows: DataFrame, n: int, order_size: int) -> GlobalOrder:
    """The global order of the shingles of rows(text). A shingle outside the table is rarer than all in it, or nearly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            some = (counts >= 2) | (mix(grams ^ mix(held[0][:1])) >> np.uint64(64 - RARE) == 0)  # drawn anew for each chunk
            return pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, grams in _sets(batch.column(0), n):
                own = _class_of(grams)
                if own in seen:
                    continue
                seen.add(own)
                held.append(grams)
                size += len(grams)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield flush()

    counted = rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    counted = materialise(counted.where("n >= 2").withColumn("step", step), "counted")
    taken, cut = 0, None
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # a few hundred rows at most
        if taken + r["count"] > order_size:
            cut = r
            break
        taken += r["count"]
    if cut is None:
        top = counted
    else:  # of the step in which the table fills, a share by hash
        some = F.pmod(F.xxhash64("gram"), F.lit(cut["count"])) < order_size - taken
        top = counted.where((F.col("step") > cut["step"]) | ((F.col("step") == cut["step"]) & some))
    top = top.select("gram", "n").toArrow()  # order_size rows or hardly more
    grams, n_of = top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy()
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, n_of))] = np.arange(len(grams))
    order = np.argsort(grams)
    return GlobalOrder(grams[order], rank[order])


def _prefixes(rows: DataFrame, order: Broadcast, n: int, num: int, den: int) -> DataFrame:
    """(id, key, n, k1, k2, rare, frequent) for each of rows(id, key, text).

    Both parts of the prefix are null for sets met before in the task and for null ids.
    """
    longs = pa.list_(pa.int64())
    kinds = {"id": pa.int64(), "key": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "rare": longs, "frequent": longs}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            size, keys = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            rare: list = [None] * batch.num_rows
            frequent: list = [None] * batch.num_rows
            for i, grams in _sets(batch.column(2), n):
                size[i], keys[i] = len(grams), (own := _class_of(grams))
                if own not in seen and batch.column(0)[i].is_valid:  # a row without an id enters no bucket
                    seen.add(own)
                    length = len(grams) + num * len(grams) // -den + 1
                    rare[i], frequent[i] = (x.view(np.int64) for x in order.value.prefix(grams, length))
            found = [pa.array(size), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(rare, longs), pa.array(frequent, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], schema=schema)

    return rows.mapInArrow(run, "id long, key long, n long, k1 long, k2 long, rare array<long>, frequent array<long>")


def _memberships(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(bucket, k1): the leaders of the prefix shingles that several classes of compatible sizes have, and the classes.

    Sets whose sizes differ by more than the threshold cannot be similar, so the classes of a shingle fall apart where
    sizes leave a gap. A frequent shingle's leaders are partial minima for each step of sizes, joined back in a join
    that adaptive execution can split; the other shingles, none of them as frequent, meet once in a window by size.
    """
    rare = sets.select("k1", "n", F.explode("rare").alias("gram"))
    by_size = Window.partitionBy("gram").orderBy("n")
    gap = F.coalesce((F.lag("n").over(by_size) * den < F.col("n") * num).cast("int"), F.lit(0))
    rare = rare.withColumn("gap", gap).withColumn("part", F.sum("gap").over(by_size))
    group = Window.partitionBy("gram", "part")
    rare = rare.select("k1", F.min("k1").over(group).alias("bucket"), F.max("k1").over(group).alias("top"))

    # sizes within the threshold fall in one step or in neighbouring ones, so each set counts in its own and the next
    own = sets.select("k1", F.explode("frequent").alias("gram"), _step(F.col("n"), num, den).alias("step"))
    own = own.select("k1", "gram", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    leaders = own.groupBy("gram", "step").agg(F.min("k1").alias("bucket"), F.max("k1").alias("top"))
    frequent = own.join(leaders.where("bucket < top"), ["gram", "step"])
    return rare.where("bucket < top").select("bucket", "k1").unionByName(frequent.select("bucket", "k1")).distinct()


_LINKS = {"a": "long", "b": "long", "bucket": "long", "block": "long", "role": "int"}


def _step(n: Column, num: int, den: int) -> Column:
    """Sets that can be similar have sizes in one step or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) + 1e-9)


def _links(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, bucket, block, role) from rows(bucket, block, role, node, label, text): a node, and one it is connected to.

    Texts travel, not sets: they take less room, and their shingles are cheap. Nodes of one label are connected
    already. role 0: the leader; 1: a set to compare with all others; 2: a set to be compared with only.
    """
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in _LINKS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sets = None, [], []
        out: list[list[np.ndarray]] = []

        def close() -> None:
            if len(sets) > 1:
                role, node, label = (np.array(v) for v in zip(*rows, strict=True))
                start = np.unique(label, return_inverse=True)[1]
                found = link_sets(sets, num, den, start, [int(i) for i in np.argsort(role, kind="stable") if role[i] < 2])
                first = np.full(int(found.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, found, node)
                out.append([node, first[found], np.full(len(node), key[0]), np.full(len(node), key[1]), role])

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(_LINKS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            row = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for i, grams in _sets(batch.column(5), n):
                if key != row[i][:2]:
                    close()
                    key, rows, sets = row[i][:2], [], []
                rows.append(row[i][2:])
                sets.append(grams.copy())
            if len(out) > 5000:
                yield flush()
                out = []
        close()
        yield flush()

    rows = members.select("bucket", "block", "role", "node", "label", "text")
    rows = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _LINKS.items()))


def _with_texts(places: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """places(node, bucket, block, role, label) with their node's text, looked up once for a node's few places."""
    each = places.groupBy("node").agg(F.collect_list(F.struct("bucket", "block", "role", "label")).alias("places"))
    found = rows.join(asked.select("node", "id", "key").join(each, "node"), ["id", "key"])
    return found.select("node", "text", F.explode("places").alias("p")).select("node", "text", "p.*")


def _spread_texts(places: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for nodes that may have any number of places each: broadcast if they are few, counted beforehand."""
    nodes = materialise(asked.select("node", "id", "key").join(places.select("node").distinct(), "node", "left_semi"), "nodes")
    if nodes.count() <= FEW_NODES:
        nodes = F.broadcast(nodes)
    return places.join(rows.join(nodes, ["id", "key"]).select("node", "text"), "node")


def _parts(rows: DataFrame, by: list[str], bucket_grams: int) -> DataFrame:
    """(by…, parts): into how many blocks the sets of rows(by…, n) go."""
    sizes = rows.groupBy(*by).agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("sets"))
    count = F.least(F.ceil(F.col("grams") / bucket_grams), F.ceil(F.col("sets") / LEAST))
    return sizes.select(*by, F.greatest(F.lit(1), count).cast("long").alias("parts"))


def _block(step: Column, part: Column) -> Column:
    return step * (1 << 40) + part + 1


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def _classes(
    docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, order_size: int, bucket_grams: int
) -> tuple[DataFrame, DataFrame]:
    """(rows(id, key, n, k1, k2), classes(k1, k2, first)): every row's class; of every class that is linked or has
    copies, the least (id, key) of its component."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(count_frequent(rows, n, order_size))
    sets = materialise(_prefixes(rows, order, n, num, den), "sets")
    some = sets.where("n > 0 and id is not null")
    classes = some.groupBy("k1", "k2").agg(F.min(F.struct("id", "key")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = materialise(_memberships(some, num, den), "members")
    buckets = members.groupBy("k1").agg(F.collect_set("bucket").alias("buckets"))  # at most one a prefix shingle
    chosen = materialise(classes.join(buckets, "k1"), "candidates")

    # large buckets are dealt out in blocks, the leader to each of them
    placed = chosen.select("node", "k1", "n", F.explode("buckets").alias("bucket"), _step(F.col("n"), num, den).alias("step"))
    large = _parts(placed, ["bucket"], bucket_grams).where("parts > 1").select("bucket")
    large = materialise(_parts(placed.join(large, "bucket"), ["bucket", "step"], bucket_grams), "large")  # of large buckets alone
    several = not large.isEmpty()
    leads = F.col("k1") == F.col("bucket")
    places = placed.select("node", "bucket", F.lit(0).cast("long").alias("block"), F.when(leads, 0).otherwise(1).alias("role"), F.col("node").alias("label"))
    if several:
        cut = placed.join(large, ["bucket", "step"])
        own = _block(F.col("step"), F.pmod(F.xxhash64("node"), F.col("parts")))
        cut = cut.where(~leads).select("node", "bucket", own.alias("block"), F.lit(1).alias("role"), F.col("node").alias("label"))
        lead = placed.where(leads).select("node", "bucket").join(large, "bucket").withColumn("part", _every(F.col("parts")))
        lead = lead.select("node", "bucket", _block(F.col("step"), F.col("part")).alias("block"), F.lit(0).alias("role"), F.col("node").alias("label"))
        places = places.join(large.select("bucket").distinct(), "bucket", "left_anti").unionByName(cut)
    asked = chosen.select("node", "n", "first.id", "first.key")
    dealt = _with_texts(places, asked, rows)
    if several:
        dealt = dealt.unionByName(_spread_texts(lead, asked, rows))
    links = materialise(_links(dealt, n, num, den), "links")
    found = connected_components(links.select("a", "b"))
    if several:
        more = _across_blocks(links, large, found, asked, rows, n, num, den, bucket_grams)
        if more is not None:
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    joined = classes.join(found, "node", "left").where("component is not null or copies > 1")
    joined = joined.select("k1", "k2", "first", F.coalesce("component", "node").alias("component"))
    first = joined.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(first, "component").select("k1", "k2", F.col("least").alias("first"))
    return sets.select("id", "key", "n", "k1", "k2"), joined


def _across_blocks(
    links: DataFrame, large: DataFrame, found: DataFrame, asked: DataFrame, rows: DataFrame, n: int, num: int, den: int, bucket_grams: int
) -> DataFrame | None:
    """Links between blocks of one bucket: the sets outside its largest component, in blocks of their own, against all
    of compatible sizes; None if there are no such sets."""
    own = links.where("role = 1").join(large.select("bucket").distinct(), "bucket").select("bucket", "block", F.col("a").alias("node"))
    own = own.join(found, "node", "left").join(asked.select("node", "n"), "node")
    own = own.select("node", "bucket", "block", "n", _step(F.col("n"), num, den).alias("step"), F.coalesce("component", "node").alias("label"))
    own = materialise(own, "placed")
    counts = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("sets"))
    main = counts.groupBy("bucket").agg(F.max_by("label", F.struct("sets", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    alone = own.join(main.where("labels > 1"), "bucket").where("label != main")
    groups = materialise(_parts(alone, ["bucket", "step"], bucket_grams), "asking")
    if groups.isEmpty():
        return None
    mine = _block(F.col("step"), F.pmod(F.xxhash64(F.lit("asking"), "node"), F.col("parts")))
    alone = alone.join(groups, ["bucket", "step"]).select("node", "bucket", "step", "label", mine.alias("own"))
    blocks_of = large.select("bucket", F.col("step").alias("other"), _every(F.col("parts")).alias("part"))
    blocks_of = blocks_of.select("bucket", "other", _block(F.col("other"), F.col("part")).alias("block"))
    near = F.abs(F.col("step") - F.col("other")) <= 1
    both = F.xxhash64("own", "block").alias("block")
    asks = alone.join(blocks_of, "bucket").where(near).select("node", "bucket", both, F.lit(1).alias("role"), "label")
    asking = groups.select("bucket", F.col("step").alias("other"), _every(F.col("parts")).alias("part"))
    asking = asking.select("bucket", "other", _block(F.col("other"), F.col("part")).alias("own"))
    others = own.join(asking, "bucket").where(near).join(alone.select("node", "bucket", "own"), ["node", "bucket", "own"], "left_anti")
    others = others.select("node", "bucket", both, F.lit(2).alias("role"), "label")
    return _links(_spread_texts(materialise(asks.unionByName(others), "places"), asked, rows), n, num, den).select("a", "b")


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100,
    order_size: int = 1 << 20, bucket_grams: int = 1 << 14,
) -> DataFrame:
    """(``id_col``, n_shingles, component_id) for every row; documents with Jaccard similarity num/den or more are linked."""
    rows, classes = _classes(docs, id_col, text_col, n, num, den, order_size, bucket_grams)
    rows = rows.withColumn("has", (F.col("n") > 0) & F.col("id").isNotNull())
    out = rows.join(classes.withColumn("has", F.lit(True)), ["has", "k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100,
    order_size: int = 1 << 20, bucket_grams: int = 1 << 14,
) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest id; all columns stay as they are.

    Rows with a null id and rows without words stay. Of several texts with the smallest id one stays, always the same.
    """
    rows, classes = _classes(docs, id_col, text_col, n, num, den, order_size, bucket_grams)
    marked = rows.where("n > 0 and id is not null").join(classes, ["k1", "k2"])
    marked = marked.select("id", "key", (F.struct("id", "key") == F.col("first")).alias("kept"))
    return keep_chosen(docs, materialise(marked, "marked"), id_col, text_key(F.col(text_col)))
