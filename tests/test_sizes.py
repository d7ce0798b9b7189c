"""What keeps large maps within the driver's memory and linear in time: plans and what reaches the driver."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import clearance, distance, overlap, sweep
from furrow.plans import file_queries, queries
from furrow.plans import tables as t
from furrow.sinks import files as out
from furrow.sources import files as src


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A grid of 120 x 40 cells and more suppliers than aisles."""
    folder = str(tmp_path_factory.mktemp("sizes"))
    custkeys = np.random.default_rng(5).integers(0, 4000, 120 * 40).tolist()
    spark.createDataFrame(list(enumerate(custkeys)), "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(20)], "s_suppkey long").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distances_along_a_column_take_linear_time(spark):
    cells = spark.range(50).select(F.lit(0).alias("x"), F.col("id").cast("int").alias("y"), F.col("id").isin(10, 40).alias("blocked"))
    found = distance.distance_transform(cells)
    assert "unboundedfollowing" not in plan(found).lower()  # Spark evaluates such a frame anew for each row
    assert [r.d2 for r in found.orderBy("y").collect()] == [min((y - 10) ** 2, (y - 40) ** 2) for y in range(50)]


def test_cells_of_aisles_are_not_broadcast(spark, folder):
    found = clearance.clearance_connectivity(queries.layers_of(spark, folder, t.SPARSE_LABEL), t.aisles(spark, folder), t.GRID_RESOLUTION, queries.RADII)
    assert not re.search(r"BroadcastHashJoin \[x[^\n]*Inner", plan(found))


@pytest.mark.parametrize("adaptive", ["true", "false"])  # a cached plan is not adaptive
def test_cells_of_aisles_are_not_broadcast_to_the_layers(spark, folder, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = queries.layers_of(spark, folder, t.SPARSE_LABEL)
        assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
        assert found.where("is_aisle").count() == 6 * 116 * 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_grid_reaches_the_driver_in_strips(spark, folder, monkeypatch):
    monkeypatch.setattr(out, "STRIP", 7 * 120, raising=False)  # 40 rows: five whole strips and a shorter one
    labels = t.labels(spark, folder).where("x <> 3 or y <> 5")
    monkeypatch.setattr(type(labels), "toPandas", lambda _: pytest.fail("cells as rows on the driver"))
    want = np.full((40, 120), 9, np.uint8)
    for r in labels.collect():
        want[r.y, r.x] = r.label
    assert np.array_equal(out.to_array(labels, "label", 9, np.uint8), want)
    assert want[5, 3] == 9


def test_points_reach_the_driver_packed(spark, tmp_path, monkeypatch):
    rows = [(float(k), k / 4, None if k == 7 else -float(k)) for k in range(1000)]
    points = spark.createDataFrame(rows, "x float, y float, z float").repartitionByRange(3, "x")
    passed, iterate = [], type(points).toLocalIterator
    monkeypatch.setattr(type(points), "toLocalIterator", lambda df, *a, **k: passed.append(df.columns) or iterate(df, *a, **k))
    path = f"file://{tmp_path}/cloud.pcd"
    assert out.write_pcd(points, path) == 1000
    assert passed == [["part", "seq", "data"]]  # not x, y, z
    raw = (tmp_path / "cloud.pcd").read_bytes()
    found = np.frombuffer(raw[raw.index(b"DATA binary\n") + 12 :], "<f4").reshape(-1, 3)
    assert np.array_equal(found, np.array(rows, np.float32), equal_nan=True)
    read = src.read_pcd(spark, path, 120)
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert read.count() == 1000 and read.agg(F.sum("x")).first()[0] == sum(range(1000))


def test_an_empty_cloud_is_written(spark, tmp_path):
    assert out.write_pcd(spark.createDataFrame([], "x float, y float, z float"), f"{tmp_path}/none.pcd") == 0
    assert (tmp_path / "none.pcd").read_bytes().endswith(b"POINTS 0\nDATA binary\n")


def test_aisles_of_one_file_are_dealt_to_many_tasks(spark, folder):
    lanes = t.aisles(spark, folder)
    assert lanes.rdd.getNumPartitions() == 1
    assert sweep.along(lanes, t.GRID_RESOLUTION).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("search", [sweep.offset_routes, sweep.search_offsets])
def test_offsets_are_computed_once(spark, folder, search, monkeypatch):
    kept, keep = [], sweep.materialise
    monkeypatch.setattr(sweep, "materialise", lambda df, name: kept.append(name) or keep(df, name))
    search(t.aisles(spark, folder), t.FOOTPRINT, queries.map_of(spark, folder))
    assert kept == ["map", "offsets"]


def test_failed_aisles_are_listed_by_number(spark, tmp_path):
    """Two aisles past A99, in whose rows all is blocked: by text A100 and A101 come before A20."""
    walls = {6 * k + d for k in (20, 100, 101) for d in range(1, 6)}
    keys = [(k, 211 if k // 120 in walls else 1) for k in range(120 * 614)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(20,), (50,), (100,), (101,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [r.labels for r in queries.QUERIES["smooth_failures"](spark, str(tmp_path)).collect()] == ["A20,A100,A101"]


def test_files_of_masks_are_not_broadcast(spark, folder):
    assert "BroadcastHashJoin" not in plan(file_queries.bundle_masks(spark, folder))


@pytest.mark.parametrize(("name", "rows"), [("map_image", 120 * 40), ("bundle_validation", 1)])
def test_maps_are_written_without_their_cells_on_the_driver(spark, folder, monkeypatch, name, rows):
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda _: pytest.fail("cells as rows on the driver"))
    assert queries.QUERIES[name](spark, folder).count() == rows


def test_offsets_of_oblique_aisles_are_computed_once(spark, folder, monkeypatch):
    kept, keep = [], sweep.materialise
    monkeypatch.setattr(sweep, "materialise", lambda df, name: kept.append(name) or keep(df, name))
    assert {r.aisle_id for r in queries.oblique_offset_routes(spark, folder).collect()} == {0, 1}
    assert kept == ["map", "offsets"]


def test_inputs_are_refused_over_a_map_of_linear_time(spark, folder, monkeypatch):
    plans, keep = [], sweep.materialise
    monkeypatch.setattr(sweep, "materialise", lambda df, name: plans.append(plan(df).lower()) or keep(df, name))
    found = dict(file_queries.refused_inputs(spark, folder).collect())
    assert not found["good"] and found["no axis"] and found["no spacing"]
    assert plans and not any("unboundedfollowing" in p for p in plans)


@pytest.mark.parametrize("rows", [7, 1000])
def test_grids_are_written_strip_by_strip(spark, tmp_path, monkeypatch, rows):
    """Against whole arrays, with rows and strips that hold no cell; the driver makes no array of the grid."""
    cells = spark.createDataFrame([(x, y, (x * y) % 7 or None, x > 3) for y in [*range(9, 12), *range(30, 38), 60] for x in (0, 2, 5)], "x int, y int, v int, flag boolean")
    monkeypatch.setattr(out, "STRIP", rows * 6)
    monkeypatch.setattr(out, "PIECE", 100, raising=False)
    arrays = {c: out.to_array(cells, c, fill, np.uint8) for c, fill in (("v", 9), ("flag", 0))}
    monkeypatch.setattr(out, "MOST_CELLS", 1)
    monkeypatch.setattr(out, "to_array", lambda *_: pytest.fail("a whole grid on the driver"))
    files = {f"file://{tmp_path}/v.pgm": ("v", 9), f"file://{tmp_path}/v.npy": ("v", 9), f"file://{tmp_path}/flag.npy": ("flag", 0), f"{tmp_path}/other.npy": ("v", 200)}
    out.write_grids(cells, files)
    assert np.array_equal(src.parse_pgm((tmp_path / "v.pgm").read_bytes()), arrays["v"])
    assert all(np.array_equal(np.load(tmp_path / f"{c}.npy"), grid) for c, grid in arrays.items())
    assert np.array_equal(np.load(tmp_path / "other.npy"), np.where(arrays["v"] == 9, 200, arrays["v"]))
    assert arrays["v"].shape == (61, 6) and arrays["v"][20, 0] == 9 and arrays["flag"].sum() == 12


def test_no_cells_make_an_empty_grid(spark, tmp_path):
    out.write_grids(spark.createDataFrame([], "x int, y int, v int"), {f"{tmp_path}/v.pgm": ("v", 0), f"{tmp_path}/v.npy": ("v", 0)})
    assert (tmp_path / "v.pgm").read_bytes() == b"P5\n0 0\n255\n" and np.load(tmp_path / "v.npy").shape == (0, 0)


@pytest.mark.parametrize("query", ["map_image", "bundle_validation"])
def test_map_files_need_no_array_of_the_whole_grid(spark, folder, monkeypatch, query):
    monkeypatch.setattr(out, "to_array", lambda *_: pytest.fail("a whole grid on the driver"))
    assert queries.QUERIES[query](spark, folder).count()


def test_no_aisles_reach_the_driver_from_refused_inputs(spark, folder, monkeypatch):
    kept, keep = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda df: kept.append(keep(df)) or kept[-1])
    found = {r["case"]: r["refused"] for r in file_queries.refused_inputs(spark, folder).toLocalIterator()}
    assert all(len(rows) <= 1 for rows in kept)  # sizes of maps
    assert not found["good"] and found["no axis"] and found["three corners"]


def test_rows_and_aisles_are_whole_whatever_the_batches(spark, folder):
    """Rows of the grid and aisles that batches cut, and batches that hold many of them."""
    cells = queries.layers_of(spark, folder, t.SPARSE_LABEL).persist()
    marked = cells.select("x", "y", (F.col("base") != 254).alias("blocked"))
    found = {}
    for size in ("7", "120", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            near = distance.distance_transform(marked)
            assert "FlatMapGroups" not in plan(near)
            passed = clearance.clearance_connectivity(cells, t.aisles(spark, folder), t.GRID_RESOLUTION, queries.RADII)
            assert "FlatMapGroups" not in plan(passed)
            found[size] = sorted(map(tuple, near.collect())), sorted(map(tuple, passed.collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["7"] == found["120"] == found["10000"] and len(found["7"][0]) == 120 * 40
    blocked = [(x, y) for x, y, stop, _ in found["7"][0] if stop]
    assert all(d2 == min((x - a) ** 2 + (y - b) ** 2 for a, b in blocked) for x, y, _, d2 in found["7"][0][::97])


def test_aisles_are_labelled_together_as_one_by_one():
    """Several aisles in one table against a search from cell to cell."""
    random, rows = np.random.default_rng(3), []
    for aisle in (2, 3, 9, 40):
        x0, y0 = random.integers(0, 1000, 2)
        cells = [(x, y) for x in range(9) for y in range(4) if random.random() < 0.9]
        rows += [(aisle, x0 + x, y0 + y, random.random(), (x, y) == (0, 1), (x, y) == (8, 2)) for x, y in cells]
    names = ("aisle_id", "x", "y", "dist_m", "start", "end")
    part = clearance.pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    radii, want = (0.0, 0.1, 0.3), {}
    for aisle in (2, 3, 9, 40):
        for radius in radii:
            safe = {(r[1], r[2]): r for r in rows if r[0] == aisle and r[3] + 1e-12 >= radius}
            seen = {c for c, r in safe.items() if r[4]}
            todo = list(seen)
            while todo:
                x, y = todo.pop()
                new = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & safe.keys() - seen
                seen |= new
                todo += new
            want[aisle, radius] = any(safe[c][5] for c in seen)
    got = clearance.connected(part, radii).to_pylist()
    assert {(r["aisle_id"], r["radius"]): r["ok"] for r in got} == want and len(got) == 12
    assert set(want.values()) == {True, False}


def test_poses_take_no_percentile_that_is_dropped(spark, folder, monkeypatch):
    asked, keep = [], sweep.overlap
    monkeypatch.setattr(sweep, "overlap", lambda *a, **k: asked.append(keep(*a, **k)) or asked[-1])
    queries.oblique_offset_routes(spark, folder)
    assert [c for df in asked for c in df.columns if c in overlap.RESULTS] == ["cells", "occupied", "unknown", "candidates", "near_m"]


@pytest.mark.parametrize("most", [2, 7, 1 << 20, 1 << 40])
def test_distinct_rows(most):
    rows = np.random.default_rng(1).integers(0, most, (60, 8))
    rows = rows[np.random.default_rng(2).integers(0, 60, 500)]
    shapes, which = overlap.distinct_rows(rows)
    assert np.array_equal(shapes[which], rows) and len(shapes) == len(np.unique(rows, axis=0))
