"""Writers for tools outside Spark: map images, bundles and reports under exact names.

These are thin exports of one map, which the driver passes on strip by strip, or of one report, which it collects;
results that grow belong in Parquet. Paths are local, or name a store by their scheme.
"""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from furrow.operators import clearance, layers, sweep
from furrow.storage import materialise, write_bytes, writing

#: A larger grid is not collected into one array. Cells of a grid that are filled at a time.
MOST_CELLS, STRIP = 1 << 28, 1 << 18
#: Bytes of a grid that the driver fetches or writes at a time.
PIECE = 1 << 23


def _strips(cells: DataFrame, fills: dict[str, float], dtype: type, most: int | None = None) -> tuple[int, int, DataFrame]:
    """(width, height, strips): grids of the columns in ``fills``, as the bytes of whole rows from row ``first`` on.

    All columns are filled in one pass, by executors; absent and null cells hold a column's value in ``fills``.
    """
    width, height = (0 if n is None else n + 1 for n in cells.agg(F.max("x"), F.max("y")).first())
    if most is not None and width * height > most:
        raise ValueError(f"a grid of {width} x {height} cells is too large for one array")
    rows = max(1, STRIP // max(1, width))

    def fill_strip(key, part):
        first = key[0].as_py() * rows
        at = part["y"].to_numpy() - first, part["x"].to_numpy()
        found = {"first": pa.array([first], pa.int64())}
        for column, fill in fills.items():
            strip = np.full((min(rows, height - first), width), fill, dtype)
            strip[at] = part[column].fill_null(fill).to_numpy()
            found[column] = pa.array([strip.tobytes()], pa.binary())
        return pa.table(found)

    held = cells.select("x", "y", *[F.col(c).cast("double").alias(c) for c in fills])
    strips = held.groupBy(F.floor(F.col("y") / rows).alias("_strip")).applyInArrow(fill_strip, ", ".join(["first long", *[f"{c} binary" for c in fills]]))
    return width, height, materialise(strips, "strips")


def to_array(cells: DataFrame, column: str, fill: float, dtype: type, most: int = MOST_CELLS) -> np.ndarray:
    """One grid as an array indexed [y, x]; absent and null cells hold ``fill``. More than ``most`` cells are an error.

    Executors fill strips of whole rows; the driver gets these one after another and never the cells as rows.
    """
    width, height, strips = _strips(cells, {column: fill}, dtype, most)
    out = np.full((height, width), fill, dtype)
    for r in strips.toLocalIterator():
        strip = np.frombuffer(r[column], dtype).reshape(-1, width)
        out[r["first"] : r["first"] + len(strip)] = strip
    return out


def _pgm_head(width: int, height: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, height)


def _npy_head(shape: tuple[int, int], dtype: type) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": shape})
    return head.getvalue()


def write_grids(cells: DataFrame, files: dict[str, tuple[str, int]]) -> None:
    """Grids of one byte a cell, of any size: from path to (column, value of absent and null cells).

    A path that ends in .pgm gets a gray image, whose lowest row comes last, any other an array indexed [y, x]. The
    cells are read in one pass for all files; the driver holds some megabytes of a grid at a time.
    """
    names = {f"g{k}": file for k, file in enumerate(files.values())}
    grids = cells.select("x", "y", *[F.col(column).alias(name) for name, (column, _) in names.items()])
    width, height, strips = _strips(grids, {name: fill for name, (_, fill) in names.items()}, np.uint8)
    parts = max(1, -(-width * height // PIECE))
    for path, (name, (_, fill)) in zip(files, names.items(), strict=True):
        image, done = str(path).endswith(".pgm"), 0
        order = F.desc("first") if image else F.asc("first")
        ordered = strips.select("first", F.col(name).alias("data")).repartitionByRange(parts, order).sortWithinPartitions(order)
        with writing(path) as write:
            write(_pgm_head(width, height) if image else _npy_head((height, width), np.uint8))
            for r in ordered.toLocalIterator():
                strip = np.frombuffer(r["data"], np.uint8).reshape(-1, width)
                begin = height - r["first"] - len(strip) if image else r["first"]
                _write_blank(write, (begin - done) * width, fill)  # rows without any cell
                write((strip[::-1] if image else strip).tobytes())
                done = begin + len(strip)
            _write_blank(write, (height - done) * width, fill)


def _write_blank(write: Callable[[bytes], None], size: int, fill: int) -> None:
    for a in range(0, size, PIECE):
        write(bytes([fill]) * min(PIECE, size - a))


def _write_rows(head: bytes, grid: np.ndarray, path: str | Path) -> None:
    """A head and a grid's rows, a few megabytes at a time."""
    step = max(1, (1 << 22) // max(1, grid.shape[1] * grid.itemsize))
    with writing(path) as write:
        write(head)
        for a in range(0, len(grid), step):
            write(grid[a : a + step].tobytes())


def write_pgm(grid: np.ndarray, path: str | Path) -> None:
    """A binary gray image; the grid's lowest row comes last."""
    _write_rows(_pgm_head(*grid.shape[::-1]), grid[::-1].astype(np.uint8, copy=False), path)


def write_npy(grid: np.ndarray, path: str | Path) -> None:
    grid = np.ascontiguousarray(grid)
    _write_rows(_npy_head(grid.shape, grid.dtype), grid, path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of x, y, z as records of three little-endian singles."""
    for seq, batch in enumerate(batches):
        data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1).astype("<f4").tobytes()
        part = batch.column(3)[:1] if batch.num_rows else pa.array([0], pa.int32())
        yield pa.RecordBatch.from_arrays([part, pa.array([seq], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "data"])


def write_pcd(points: DataFrame, path: str | Path) -> int:
    """A binary point cloud of x, y, z in the order of the rows; returns how many points.

    Executors pack the points; the driver only passes packed batches on, one after another.
    """
    chosen = points.select(*[F.col(c).cast("float") for c in "xyz"], F.spark_partition_id().alias("part"))
    packed = materialise(chosen.mapInArrow(_packed, "part int, seq long, data binary"), "packed")
    count = (packed.agg(F.sum(F.length("data"))).first()[0] or 0) // 12
    head = f"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {count}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {count}\nDATA binary\n"
    with writing(path) as write:
        write(head.encode())
        held, size = [], 0
        for r in packed.orderBy("part", "seq").toLocalIterator(prefetchPartitions=True):
            held.append(bytes(r["data"]))
            size += len(held[-1])
            if size >= 1 << 22:
                write(b"".join(held))
                held, size = [], 0
        write(b"".join(held))
    return count


def write_text(text: str, path: str | Path) -> None:
    write_bytes(path, text.encode())


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def records(results: DataFrame) -> list[dict]:
    """The rows of a report in input order, as plain values."""
    order = [c for c in ("input_ord", "aisle_id") if c in results.columns]
    return [{k: v for k, v in _plain(r).items() if k != "input_ord"} for r in results.orderBy(*order).collect()]


def write_json(report: dict, path: str | Path) -> None:
    write_text(json.dumps(report, indent=2, sort_keys=True) + "\n", path)


def write_csv(rows: list[dict], columns: tuple[str, ...], path: str | Path) -> None:
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, columns, extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    write_text(out.getvalue(), path)


#: The columns of the flat reports.
FOOTPRINT_COLUMNS = (
    "aisle_id", "label", "width_m", "length_m", "pose_count", "passed", "collision_pose_count", "unknown_overlap_pose_count",
    "candidate_overlap_pose_count", "out_of_bounds_pose_count", "min_blocked_clearance_m", "first_failure_reason",
)
OFFSET_COLUMNS = (
    "aisle_id", "label", "width_m", "length_m", "tested_offset_count", "feasible_offset_count", "centerline_passed", "passed", "route_recovered",
    "best_offset_m", "best_min_blocked_clearance_m", "best_clearance_p10_m", "best_candidate_overlap_pose_count", "best_attempt_offset_m",
    "best_attempt_blocking_pose_count", "best_attempt_collision_pose_count", "best_attempt_unknown_pose_count",
)
SMOOTH_COLUMNS = (
    "aisle_id", "label", "width_m", "length_m", "passed", "b1_passed", "baseline_b1_available", "route_recovered_from_b1", "control_point_count",
    "tested_offset_count", "blocking_pose_count", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count",
    "out_of_bounds_pose_count", "min_blocked_clearance_m", "clearance_p10_m", "max_offset_step_m", "max_heading_deviation_rad", "failure_reason", "failure_region",
)


def write_navigation_bundle(
    semantic: DataFrame, aisles: DataFrame, folder: str | Path, resolution: float = 0.05, origin: tuple[float, float, float] = (0.0, 0.0, 0.0),
    radii: tuple[float, ...] = clearance.RADII,
) -> dict:
    """Image, YAML, two masks and validation.json; returns the validation."""
    cells = layers.navigation_layers(semantic, aisles).persist()
    metadata = layers.map_metadata("navigation_base_map.pgm", resolution, origin)
    connectivity = clearance.clearance_connectivity(cells, aisles, resolution, radii).persist()
    sizes = {r["aisle_id"]: r for r in aisles.select("aisle_id", "width_m", "length_m").collect()}
    fields = ("radius_m", "diameter_m", "pass_count", "total_aisles")
    tests = {r["key"]: {k: r[k] for k in fields} for r in clearance.clearance_summary(connectivity).collect()}
    lanes = [
        {"aisle_id": r["aisle_id"], "label": r["label"], "clearance_pass": r["clearance_pass"], **{k: sizes[r["aisle_id"]][k] or 0.0 for k in ("width_m", "length_m")}}
        for r in clearance.clearance_by_aisle(connectivity).orderBy("aisle_id").collect()
    ]
    for r in radii:  # without aisles there is nothing to summarise
        tests.setdefault(f"{r:.2f}", {"radius_m": r, "diameter_m": 2.0 * r, "pass_count": 0, "total_aisles": 0})
    validation = {
        **layers.gray_semantics(cells).first().asDict(),
        **layers.layer_counts(cells).first().asDict(),
        "resolution_m": float(resolution),
        "clearance_tests": tests,
        "aisles": lanes,
        "map_server_yaml_valid": layers.metadata_valid(metadata),
    }
    grids = {"navigation_base_map.pgm": ("base", layers.UNKNOWN), "candidate_mask.npy": ("is_candidate", 0), "static_obstacle_mask.npy": ("is_hard", 0)}
    write_grids(cells, {f"{folder}/{name}": grid for name, grid in grids.items()})
    write_yaml(metadata, f"{folder}/navigation_base_map.yaml")
    write_json(validation, f"{folder}/validation.json")
    cells.unpersist()
    connectivity.unpersist()
    return validation


def write_report(results: DataFrame, name: str, columns: tuple[str, ...], folder: str | Path, more: dict | None = None, **flags: str) -> dict:
    """``name``.json with summary and aisles, and ``name``.csv with the flat columns; returns the report."""
    results = results.persist()
    rows = records(results)
    report = {"summary": sweep.summary(results, **flags).first().asDict(), "aisles": rows, **(more or {})}
    write_json(report, f"{folder}/{name}.json")
    write_csv(rows, columns, f"{folder}/{name}.csv")
    results.unpersist()
    return report


def write_centreline(cells: DataFrame, path: str | Path) -> int:
    """x,y of every cell, row by row, a partition of the sorted cells at a time; returns how many."""
    count = 0
    with writing(path) as write:
        write(b"x,y\r\n")
        held: list[str] = []
        for r in cells.select("x", "y").orderBy("y", "x").toLocalIterator():
            held.append(f"{r['x']},{r['y']}\r\n")
            count += 1
            if len(held) == 10_000:
                write("".join(held).encode())
                held.clear()
        write("".join(held).encode())
    return count


def write_yaml(values: dict, path: str | Path) -> None:
    write_text(yaml.safe_dump(values, sort_keys=False), path)


def write_html(folder: str | Path, images: list[str], title: str = "Report") -> Path:
    """A page that shows the images."""
    body = "".join(f'<section><h2>{html.escape(Path(i).stem)}</h2><img src="{html.escape(i)}" alt=""></section>' for i in images)
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}\n"
    write_text(page, f"{folder}/report.html")
    return Path(folder) / "report.html"
