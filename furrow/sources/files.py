"""Readers of structured files: point clouds of any size, arrays, images, aisles, footprints, maps and earlier results.

Point clouds in ascii or binary are read by ranges, many tasks to a file; a compressed one is a single stream and so
one task's work. All other files are small: each is parsed in one task and must be below 2 GB, Spark's limit for one
value. Files may lie in any store that Spark reaches, ranges of binary clouds in those that Arrow reaches too.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.storage import files_of, read_start

#: Rows that a parser hands over at a time.
BATCH = 200_000
#: Bytes of a binary cloud to a task, and those that hold any cloud's header.
RANGE, HEAD = 1 << 25, 1 << 16


def _parsed(spark: SparkSession, path: str, schema: str, parse: Callable[[bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield from parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def unpack_lzf(data: bytes, size: int) -> bytes:
    """LZF as point cloud files use it: runs of literals, and copies of what is already unpacked."""
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        at += 1
        if head < 32:
            out += data[at : at + head + 1]
            at += head + 1
            continue
        length = head >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((head & 31) << 8) + data[at] + 1
        at += 1
        piece = out[-back:]  # a copy may overlap what it writes
        out += (piece * (-(-(length + 2) // back)))[: length + 2]
    if len(out) != size:
        raise ValueError("compressed points are damaged")
    return bytes(out)


_KINDS = {"F": "f", "I": "i", "U": "u"}


@dataclass(frozen=True)
class CloudHeader:
    names: list[str]
    sizes: list[int]
    kinds: list[str]
    counts: list[int]
    points: int
    how: str
    #: where the points begin
    begin: int

    @classmethod
    def of(cls, content: bytes) -> CloudHeader:
        found: dict[str, list[str]] = {}
        at = 0
        while "DATA" not in found:
            end = content.index(b"\n", at)
            words = content[at:end].decode("ascii").split()
            at = end + 1
            if words and not words[0].startswith("#"):
                found[words[0].upper()] = words[1:]
        names = found["FIELDS"]
        counts = [int(c) for c in found.get("COUNT", ["1"] * len(names))]
        header = cls(names, [int(s) for s in found["SIZE"]], found["TYPE"], counts, int(found["POINTS"][0]), found["DATA"][0], at)
        if not {"x", "y", "z"} <= set(names):
            raise ValueError("a point cloud needs the fields x, y and z")
        if not header.points:
            raise ValueError("the point cloud is empty")
        if header.how not in ("ascii", "binary", "binary_compressed"):
            raise ValueError(f"unknown point data {header.how!r}")
        return header

    @property
    def record(self) -> np.dtype:
        fields = zip(self.names, self.kinds, self.sizes, self.counts, strict=True)
        return np.dtype([(f"{f}{k}", f"<{_KINDS[t]}{s}", (c,)) for k, (f, t, s, c) in enumerate(fields)])

    def place(self, name: str) -> int:
        """The number of a field's first value in a row of text."""
        return sum(self.counts[: self.names.index(name)])

    def points_of(self, raw: bytes, at: int, n: int) -> np.ndarray:
        """The coordinates of ``n`` binary records from a place on."""
        rows = np.frombuffer(raw, self.record, n, at)
        return np.stack([rows[f"{a}{self.names.index(a)}"][:, 0] for a in "xyz"], axis=1).astype(np.float32)


def parse_pcd(content: bytes) -> np.ndarray:
    """The N x 3 float32 coordinates of a point cloud file (ascii, binary or binary_compressed)."""
    head = CloudHeader.of(content)
    n, at = head.points, head.begin
    if head.how == "ascii":
        rows = np.loadtxt(io.BytesIO(content[at:]), ndmin=2, max_rows=n)
        return np.stack([rows[:, head.place(a)] for a in "xyz"], axis=1).astype(np.float32)
    if head.how == "binary":
        return head.points_of(content, at, n)
    packed, size = np.frombuffer(content, "<u4", 2, at)
    raw, columns, start = unpack_lzf(content[at + 8 : at + 8 + int(packed)], int(size)), {}, 0
    for f, t, s, c in zip(head.names, head.kinds, head.sizes, head.counts, strict=True):  # one field after another
        columns[f] = np.frombuffer(raw, f"<{_KINDS[t]}{s}", n * c, start).reshape(n, c)[:, 0]
        start += n * c * s
    return np.stack([columns[a] for a in "xyz"], axis=1).astype(np.float32)


_POINT = "x float, y float, z float"
_HEADER_WORDS = "VERSION|FIELDS|SIZE|TYPE|COUNT|WIDTH|HEIGHT|VIEWPOINT|POINTS|DATA"


def _text_points(spark: SparkSession, uri: str, head: CloudHeader) -> DataFrame:
    lines = spark.read.text(uri).select(F.trim("value").alias("line"))
    lines = lines.where(~F.col("line").rlike(rf"^(#|(?i:{_HEADER_WORDS})\b)") & (F.col("line") != ""))
    words = F.split("line", r"\s+")
    bad = F.raise_error(F.concat(F.lit("a point of other than the cloud's fields: "), F.col("line"))).cast("array<string>")
    words = F.when(F.size(words) == sum(head.counts), words).otherwise(bad)
    return lines.select(words.alias("w")).select(*[F.col("w")[head.place(a)].cast("float").alias(a) for a in "xyz"])


def _ranged_points(spark: SparkSession, uri: str, head: CloudHeader, bytes_each: int) -> DataFrame:
    width = head.record.itemsize
    each = max(1, bytes_each // width)
    ranges = -(-head.points // each)
    store = uri if "://" in uri else uri.replace(":/", ":///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = arrow_fs.FileSystem.from_uri(store)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with files.open_input_file(path) as source:
                    for a in range(k * each, min((k + 1) * each, head.points), BATCH):
                        n = min(BATCH, (k + 1) * each - a, head.points - a)
                        source.seek(head.begin + a * width)
                        points = head.points_of(source.read(n * width), 0, n)
                        yield pa.RecordBatch.from_arrays([pa.array(points[:, c]) for c in range(3)], names=list("xyz"))

    cores = spark.sparkContext.defaultParallelism
    slices = ranges if ranges <= 8 * cores else max(4 * cores, -(-head.points * width // RANGE))  # of many small ranges, a task reads several
    return spark.range(0, ranges, 1, min(ranges, slices)).mapInArrow(run, _POINT)


def read_pcd(spark: SparkSession, path: str, bytes_each: int = RANGE) -> DataFrame:
    """(x, y, z) as single-precision numbers, of one file, a folder or a pattern; an empty or misshapen cloud fails.

    Binary clouds are read by ranges of about ``bytes_each`` bytes, one or more to a task; ascii ones as Spark splits text.
    """

    def whole(content: bytes) -> Iterator[pd.DataFrame]:
        points = parse_pcd(content)
        for a in range(0, len(points), BATCH):
            yield pd.DataFrame(points[a : a + BATCH], columns=["x", "y", "z"])

    found = []
    for uri, size in files_of(path):
        head = CloudHeader.of(read_start(uri, HEAD))
        if head.how == "binary" and size < head.begin + head.points * head.record.itemsize:
            raise ValueError(f"{uri} is shorter than its {head.points} points")
        if head.how == "ascii":
            found.append(_text_points(spark, uri, head))
        elif head.how == "binary":
            found.append(_ranged_points(spark, uri, head, bytes_each))
        else:
            found.append(_parsed(spark, uri, _POINT, whole))
    return reduce(DataFrame.unionByName, found)


def _cells(grid: np.ndarray, column: str) -> Iterator[pd.DataFrame]:
    if grid.ndim != 2:
        raise ValueError("a grid has two dimensions")
    step = max(1, BATCH // max(1, grid.shape[1]))
    for a in range(0, grid.shape[0], step):
        y, x = np.mgrid[a : min(a + step, grid.shape[0]), 0 : grid.shape[1]]
        yield pd.DataFrame({"x": x.ravel(), "y": y.ravel(), column: grid[a : a + step].ravel()})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, label) of a two-dimensional .npy array indexed [y, x]."""
    return _parsed(spark, path, "x int, y int, label int", lambda c: _cells(np.load(io.BytesIO(c), allow_pickle=False).astype(np.int32), "label"))


def read_mask(spark: SparkSession, path: str, column: str = "is_candidate") -> DataFrame:
    """(x, y, flag) of a two-dimensional .npy array: whatever is not zero."""
    return _parsed(spark, path, f"x int, y int, {column} boolean", lambda c: _cells(np.load(io.BytesIO(c), allow_pickle=False) != 0, column))


def parse_pgm(content: bytes) -> np.ndarray:
    """The grid of a binary gray image, whose rows run from the top: index 0 is the lowest row."""
    tokens: list[bytes] = []
    at = 0
    while len(tokens) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("not a gray image")
        tokens.append(content[at:end])
        at = end
    if tokens[0] != b"P5" or int(tokens[3]) > 255:
        raise ValueError("not a gray image of one byte per cell")
    width, height = int(tokens[1]), int(tokens[2])
    return np.frombuffer(content, np.uint8, width * height, at + 1).reshape(height, width)[::-1]


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, base) of a map image."""
    return _parsed(spark, path, "x int, y int, base int", lambda c: _cells(parse_pgm(c).astype(np.int32), "base"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


_AISLE = "array<struct<aisle_id:int,label:string,polygon_xy:array<array<double>>,width_m:double,length_m:double>>"


def read_aisles(spark: SparkSession, path: str) -> DataFrame:
    """(aisle_id, label, polygon, width_m, length_m, input_ord) of a JSON list, or of the list under "rectangles"."""
    text = F.trim("value")
    bare, named = F.from_json(text, _AISLE), F.from_json(text, f"rectangles {_AISLE}")["rectangles"]
    found = F.when(F.startswith(text, F.lit("[")), bare).otherwise(named)
    found = F.coalesce(found, F.raise_error(F.lit("an aisle file holds a list or an object with rectangles")).cast(_AISLE))
    rows = _whole(spark, path).select(F.posexplode(found).alias("input_ord", "a"))
    polygon = F.transform("a.polygon_xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    checked = F.when(F.size(polygon) == 4, polygon).otherwise(F.raise_error(F.lit("an aisle has four corners")).cast("array<struct<x:double,y:double>>"))
    return rows.select("a.aisle_id", "a.label", checked.alias("polygon"), "a.width_m", "a.length_m", "input_ord")


def read_footprint(spark: SparkSession, path: str) -> tuple[str, list[tuple[float, float]]]:
    """(name, polygon in metres) of a JSON object; the name defaults to robot."""
    data = json.loads(_whole(spark, path).first()[0])
    if "polygon_xy_m" not in data:
        raise ValueError("a footprint file needs polygon_xy_m")
    return str(data.get("name", "robot")), [(float(x), float(y)) for x, y in data["polygon_xy_m"]]


def read_map_metadata(spark: SparkSession, path: str) -> dict:
    """The map server's YAML."""
    return yaml.safe_load(_whole(spark, path).first()[0])


def read_baseline(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(label, passed, best_offset_m, best_attempt_offset_m, ord) of an earlier search's JSON; None without a path."""
    if path is None:
        return None
    schema = "aisles array<struct<label:string,passed:boolean,best_offset_m:double,best_attempt_offset_m:double>>"
    return _whole(spark, path).select(F.posexplode(F.from_json("value", schema)["aisles"]).alias("ord", "a")).select("a.*", "ord")
