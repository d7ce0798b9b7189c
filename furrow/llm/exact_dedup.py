"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three stages, each of which compares whole texts because the text is part of every grouping key: copies merge inside
each input partition (the map side of stage one), partitions merge within salted digest groups, and the winners of
the salts merge globally. However large a group of copies is, no stage hands one task more than a row per salt and
upstream task.

Defined cases: a null text counts as empty; empty texts are copies of each other; a null id loses to every other id;
a repeated row (same id, same text) is the same document, so it counts in the group size and shares its twin's fate;
an empty table gives an empty result. Columns other than the id and the text are neither read nor needed here, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import keep_chosen
from furrow.storage import materialise


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merge_copies(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size) for every distinct text of rows(id, text, digest)."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "salt", "text")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _looked_up(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows(id, digest) with their group's keep_id and group_size, null for groups of one.

    Groups with a thousandth or more of all copies, of which there are a thousand at most, come by broadcast; their
    rows then spread over all tasks of the join that looks up the others.
    """
    copies = groups.agg(F.sum("group_size")).first()[0] or 0
    heavy = F.col("group_size") * 1000 >= copies
    large = groups.where(heavy).select("digest", F.col("keep_id").alias("large_keep"), F.col("group_size").alias("large_size"))
    marked = rows.join(F.broadcast(large), "digest", "left")
    marked = marked.withColumn("spread", F.when(F.col("large_size").isNotNull(), F.xxhash64("id")).otherwise(F.lit(0).cast("long")))
    found = marked.join(groups.where(~heavy).withColumn("spread", F.lit(0).cast("long")), ["digest", "spread"], "left")
    return found.select("id", "digest", F.coalesce("large_keep", "keep_id").alias("keep_id"), F.coalesce("large_size", "group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per input row: ``id_col``, digest (binary), keep_id, group_size, kept.

    Of equal texts the largest id stays. Groups of one need no lookup; the others are found again by digest alone,
    which is exact because stage three has compared all texts of a digest. Should a digest cover several texts, its
    rows are looked up by their whole text. ``digest`` may be any function of the text: a weak one costs speed only.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    merged = merge_copies(rows, salts)
    groups = merged.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    groups = materialise(groups.where("texts > 1 or group_size > 1"), "copies")

    single = groups.where("texts = 1").drop("texts")
    mixed = groups.where("texts > 1").select("digest")
    if mixed.isEmpty():
        found = _looked_up(rows.select("id", "digest"), single)
    else:
        alone = rows.select("id", "digest").join(mixed, "digest", "left_anti")
        shared = rows.join(mixed, "digest", "left_semi")
        found = _looked_up(alone, single).unionByName(shared.join(merge_copies(shared, salts), ["digest", "text"]).drop("text"))
    return found.select(
        F.col("id").alias(id_col),
        "digest",
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``docs`` with one row of each group of copies: a row that ``exact_dedup`` keeps, and one of its twins.

    All columns stay as they are. Rows with the same id and text are one document; which of them stays is not defined.
    """
    found = exact_dedup(docs, id_col, text_col, salts).where("group_size > 1")
    marked = materialise(found.select(F.col(id_col).alias("id"), F.col("digest").alias("key"), "kept"), "marked")
    return keep_chosen(docs, marked, id_col, sha256_of(F.coalesce(F.col(text_col), F.lit(""))))
