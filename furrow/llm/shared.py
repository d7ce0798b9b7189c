"""Helpers that every text operator shares: table access, shared storage and bounded sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from furrow.llm.text_arrays import blocks
from furrow.storage import materialise

#: More classes than this are not a classification problem the samplers accept.
MAX_CLASSES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """A 64-bit hash that tells the texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_chosen(docs: DataFrame, marked: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` less the rows that marked(id, key, kept) drops; of rows that share a kept id and key, any one.

    ``key`` is the expression over ``docs`` that ``marked`` holds as key. Rows that ``marked`` does not name stay. The
    rows to drop grow with the input, so they are merged in at every size instead of broadcast while they are few.
    """
    own_id, own_key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (key == F.col(own_key))
    marked = marked.select(F.col("id").alias(own_id), F.col("key").alias(own_key), "kept")
    left = docs.join(marked.where(~F.col("kept")).drop("kept").distinct().hint("merge"), same, "left_anti")
    again = marked.where("kept").groupBy(own_id, own_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = materialise(again, "twins")
    if again.isEmpty():
        return left
    one = left.join(again, same, "left_semi").withColumn(own_key, key).dropDuplicates([id_col, own_key]).drop(own_key)
    return left.join(again, same, "left_anti").unionByName(one)


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``. A null key falls in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % F.lit(folds), F.lit(0).cast("long"))


def sample_by_class(rows: DataFrame, key: str, label: str, quota: int) -> DataFrame:
    """About ``quota`` rows of each class, chosen by a hash of ``key``.

    Rows with a null label go. The class counts are the only thing collected (at most ``MAX_CLASSES`` rows); each
    class is then thinned by its own rate, so no class is ever gathered or sorted in one task. The same rows come
    out on every run. The expected size is at most ``quota`` a class and varies by its square root.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, quota / r["count"]))).otherwise(rate)
    draw = F.xxhash64(F.lit("sample"), F.col(key).cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    return rows.where(draw < rate)


def map_texts(docs: DataFrame, id_col: str, text_col: str, score: Callable[[np.ndarray, np.ndarray], list], fields: list[pa.Field]) -> DataFrame:
    """``id_col`` and the columns that ``score(bytes, offsets)`` gives for each text, block by block, without a shuffle.

    Only the two columns are read; null texts arrive as empty ones. A worker holds one Arrow batch and the arrays of
    one block of about a MB (or of one text, if that is longer).
    """
    rows = docs.select(id_col, text_col)
    schema = pa.schema([to_arrow_schema(rows.schema).field(0), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                columns = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(score(data, offsets), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], schema=schema)

    return rows.mapInArrow(run, from_arrow_schema(schema))
