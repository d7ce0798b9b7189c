import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow import cli
from furrow.functions.labels import label_cells
from furrow.functions.raster import covered, hull
from furrow.operators import clearance, components, corridor, distance, grids, layers, segmentation
from furrow.operators.overlap import overlap
from furrow.sinks import files as out
from furrow.sinks import plots
from furrow.sources import files as src
from tests.grids import FOOTPRINT, aisles, area, grid, rect


def values(df, *columns):
    return {(r.x, r.y): (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def test_layers_keep_structure_and_candidates(spark):
    labels = area(7, 10, 0, g=(2, 5, 1, 9, 1), c=(3, 4, 4, 5, 5), p=(3, 4, 5, 6, 6), r=(3, 4, 6, 7, 2))
    got = values(layers.navigation_layers(grid(spark, labels, "label"), aisles(spark, rect(1, 2, 8, 4))), "base", "is_candidate")
    assert got[4, 3] == (layers.FREE, True)
    assert got[5, 3][0] == got[6, 3][0] == layers.OCCUPIED
    assert got[0, 0][0] == layers.UNKNOWN and got[2, 2][0] == layers.FREE


def test_clearance_depends_on_the_radius(spark):
    labels = grid(spark, area(30, 100, 0, g=(5, 25, 5, 95, 1)), "label")
    lanes = aisles(spark, rect(5, 5, 94, 24))
    found = clearance.clearance_connectivity(layers.navigation_layers(labels, lanes), lanes, 0.05, (0.30, 0.55))
    assert {(r.key, r.pass_count, r.total_aisles) for r in clearance.clearance_summary(found).collect()} == {("0.30", 1, 1), ("0.55", 0, 1)}


def test_foreign_gray_values_are_reported(spark):
    row = layers.gray_semantics(grid(spark, area(4, 4, 254, o=(0, 1, 0, 1, 127)), "base")).first()
    assert not row.gray_semantics_valid and row.unexpected_gray_values == [127]


def test_metadata():
    m = layers.map_metadata("a.pgm", 0.05)
    assert m["free_thresh"] == 0.196 < m["occupied_thresh"] == 0.65 and layers.metadata_valid(m)
    assert not layers.metadata_valid(m | {"free_thresh": 0.7})


def test_navigation_command_writes_the_bundle(spark, tmp_path):
    np.save(tmp_path / "l.npy", area(8, 12, 0, g=(2, 6, 1, 11, 1), p=(3, 4, 4, 5, 6), c=(3, 4, 3, 4, 5)).astype(np.uint8))
    corners = [list(p) for p in rect(1, 2, 10, 5)]
    (tmp_path / "a.json").write_text(json.dumps({"rectangles": [{"aisle_id": 1, "polygon_xy": corners}]}))
    v = cli.main(["navigation-map", "--labels", str(tmp_path / "l.npy"), "--aisles", str(tmp_path / "a.json"), "--output", str(tmp_path / "o"), "--radii", "0.1", "0.2"])
    assert (v["pillar_cell_count"], v["pillar_as_free_cell_count"], v["candidate_cell_count"]) == (1, 0, 1)
    names = {"navigation_base_map.pgm", "navigation_base_map.yaml", "candidate_mask.npy", "static_obstacle_mask.npy", "validation.json"}
    assert {p.name for p in (tmp_path / "o").iterdir()} == names
    assert (tmp_path / "o/navigation_base_map.pgm").read_bytes().startswith(b"P5\n12 8\n255\n")
    assert json.loads((tmp_path / "o/validation.json").read_text())["aisles"][0]["label"] == "A01"
    back = values(src.read_pgm(spark, str(tmp_path / "o/navigation_base_map.pgm")), "base")
    assert back[4, 3] == layers.OCCUPIED and back[3, 3] == layers.FREE and back[0, 0] == layers.UNKNOWN
    assert src.read_map_metadata(spark, str(tmp_path / "o/navigation_base_map.yaml"))["resolution"] == 0.05
    (tmp_path / "f.json").write_text(json.dumps({"polygon_xy_m": [[0.02, 0.02], [0.02, -0.02], [-0.02, 0.0]]}))
    common = ["--map", str(tmp_path / "o/navigation_base_map.pgm"), "--yaml", str(tmp_path / "o/navigation_base_map.yaml"), "--aisles", str(tmp_path / "a.json"), "--footprint", str(tmp_path / "f.json")]
    found = cli.main(["footprint", *common, "--candidates", str(tmp_path / "o/candidate_mask.npy"), "--output", str(tmp_path / "r")])
    assert found["summary"]["total_aisles"] == 1 and found["footprint"]["name"] == "robot"
    assert (tmp_path / "r/aisle_footprint_validation.csv").read_text().splitlines()[0] == ",".join(out.FOOTPRINT_COLUMNS)
    offsets = cli.main(["offsets", *common, "--output", str(tmp_path / "r")])
    smooth = cli.main(["smooth", *common, "--baseline", str(tmp_path / "r/in_aisle_offset_search.json"), "--control-spacing", "0.1", "--output", str(tmp_path / "r")])
    assert smooth["aisles"][0]["b1_passed"] == offsets["aisles"][0]["passed"]


def test_aisle_files(spark, tmp_path):
    corners = [list(p) for p in rect(1, 2, 10, 5)]
    (tmp_path / "bare.json").write_text(json.dumps([{"aisle_id": 7, "label": "L", "polygon_xy": corners, "width_m": 2}]))
    row = src.read_aisles(spark, str(tmp_path / "bare.json")).first()
    assert (row.aisle_id, row.label, row.width_m, row.length_m, row.polygon[2].x) == (7, "L", 2.0, None, 10.0)
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="a list or an object"):
        src.read_aisles(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "three.json").write_text(json.dumps([{"aisle_id": 7, "polygon_xy": corners[:3]}]))
    with pytest.raises(Exception, match="four corners"):
        src.read_aisles(spark, str(tmp_path / "three.json")).collect()


def test_distance_equals_brute_force(spark):
    random = np.random.default_rng(2)
    blocked = random.random((13, 17)) < 0.06
    cells = grid(spark, blocked.astype(int), "b").withColumn("blocked", F.col("b") == 1)
    by, bx = np.nonzero(blocked)
    for (x, y), d2 in values(distance.distance_transform(cells), "d2").items():
        assert d2 == ((bx - x) ** 2 + (by - y) ** 2).min()
    assert set(values(distance.distance_transform(cells.withColumn("blocked", F.lit(False))), "d2").values()) == {None}


def test_components_touch_along_sides(spark):
    random = np.random.default_rng(4)
    a = random.random((15, 20)) < 0.55
    found = values(components.grid_components(grid(spark, a.astype(int), "v").where("v = 1")), "component")
    left = {(int(x), int(y)) for y, x in zip(*np.nonzero(a))}
    while left:
        ahead, own = [left.pop()], set()
        while ahead:
            x, y = ahead.pop()
            own.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    ahead.append(n)
        assert len({found[c] for c in own}) == 1 and sum(v == found[next(iter(own))] for v in found.values()) == len(own)


def test_corridor_keeps_all_or_nothing(spark):
    a = area(8, 30, 0, lane=(2, 4, 0, 30, 1), speck=(6, 7, 3, 5, 1))
    cells = grid(spark, a, "trav")
    along, across = ([(0.0, 1.0, 0.0)], [(1.57, 0.0, 1.0)])
    ahead, aside = (spark.createDataFrame(v, "angle_rad double, dx double, dy double") for v in (along, across))
    assert corridor.extract_corridor(cells).count() == 60
    assert corridor.extract_corridor(cells, ahead).count() == 60 and corridor.extract_corridor(cells, aside).count() == 0
    assert corridor.extract_corridor(cells.where("trav = 0"), ahead).count() == 0


def test_row_direction(spark):
    x = np.linspace(0, 10, 50)
    points = spark.createDataFrame([(float(v), float(0.5 * v)) for v in x], "x double, y double")
    r = corridor.row_direction(points).first()
    assert np.isclose(r.angle_rad, np.arctan(0.5)) and np.isclose(r.dx**2 + r.dy**2, 1)
    assert tuple(corridor.row_direction(points.limit(1)).first()) == (0.0, 1.0, 0.0)


def cloud(spark, points, kind="float"):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], f"x {kind}, y {kind}, z {kind}")


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_exact_percentile(spark, small):
    z = np.random.default_rng(3).normal(size=500).round(1)
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    for q in (0.0, 0.1, 0.5, 0.937, 1.0):
        assert segmentation.exact_percentile(df, "z", q, small) == pytest.approx(np.percentile(z, 100 * q), abs=1e-12)
    assert segmentation.exact_percentile(df.where("z > 100"), "z", 0.1) is None


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_percentiles_of_awkward_heights(spark, small):
    """Infinite, missing, equal and heavy-tailed heights, on either side of the size from which ranges are narrowed."""
    inf, nan = float("inf"), float("nan")
    random = np.random.default_rng(4)
    tails = (10.0 ** random.uniform(-300, 300, 200) * random.choice([-1, 1], 200)).tolist()
    cases = [[*range(50), inf], [-inf, -inf, *range(40), inf], [inf] * 30, [-inf] * 20 + [inf] * 20, [3.0] * 60, [*tails, 1.7e308, -1.7e308], [0.0] * 300 + [5e-324] * 5, [1.0, 1.0 + 2**-52] * 30]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(nan,), (None,)], "z double")
        ranked = sorted(map(float, values))
        for q in (0.0, 0.1, 0.37, 0.5, 1.0):
            at = q * (len(ranked) - 1)
            a, b = ranked[int(at)], ranked[min(int(at) + 1, len(ranked) - 1)]
            want = a if a == b or at == int(at) else a + (b - a) * (at - int(at))
            got = segmentation.exact_percentile(df, "z", q, small)
            assert got == want or (np.isnan(got) and np.isnan(want)), (values[:3], q)
    points = cloud(spark, [(k, 0, z) for k, z in enumerate([0.0] * 40 + [9.0, inf, nan])])
    assert sorted((str(r.z), r.is_ground) for r in segmentation.height_threshold(points).where("z <> 0 or isnan(z)").collect()) == [("9.0", False), ("inf", False), ("nan", False)]


def test_segmentation_rules_differ_below_the_level(spark):
    z = np.concatenate([np.zeros(80), [-1.0], np.full(19, 2.0)]).astype(np.float32)
    points = cloud(spark, [(k, 0, v) for k, v in enumerate(z)])
    two = segmentation.near_level(points).where("is_ground").count()
    one = segmentation.segment(points, "height_threshold").where("is_ground").count()
    assert (two, one) == (80, 81) and segmentation.voxel_ground(points, 9.0).where("is_ground").count() == two
    assert segmentation.list_algorithms() == ["height_threshold", "morphological_pmf"]
    with pytest.raises(KeyError):
        segmentation.get_algorithm("csf")


def test_histogram_equals_numpy(spark):
    for z in (np.random.default_rng(6).normal(size=300), np.full(7, 3.0), np.arange(20) * 0.1):
        counts, edges = np.histogram(z, bins=50)
        got = {r.bin: (r.n, r.left_edge) for r in segmentation.histogram(cloud(spark, [(0, 0, v) for v in z], "double"), 50).collect()}
        assert {b: n for b, (n, _) in got.items()} == {int(b): int(c) for b, c in enumerate(counts) if c}
        assert all(np.isclose(e, edges[b]) for b, (_, e) in got.items())


def test_single_precision_binning_and_windows(spark):
    random = np.random.default_rng(8)
    p = np.stack([random.integers(0, 40, 400) * np.float32(0.05), random.integers(0, 30, 400) * np.float32(0.05), random.random(400)], 1).astype(np.float32)
    index = np.floor((p[:, :2] - p[:, :2].min(0)) / np.float32(0.05)).astype(int)
    least, most = {}, {}
    for (x, y), z in zip(index.tolist(), p[:, 2]):
        least[x, y], most[x, y] = min(least.get((x, y), z), z), max(most.get((x, y), z), z)
    points = cloud(spark, p)
    assert values(grids.min_height_grid(points), "h") == {k: float(v) for k, v in least.items()}
    assert values(grids.max_height_grid(points), "h") == {k: float(v) for k, v in most.items()}
    for k in (1, 2, 4, 5):
        a, b = k // 2, k - 1 - k // 2
        want = {(x, y): min(v for (i, j), v in least.items() if -a <= i - x <= b and -a <= j - y <= b) for x, y in least}
        assert values(grids.local_ground(grids.min_height_grid(points), k), "ground") == {c: float(v) for c, v in want.items()}
    empty = grids.max_height_grid(points.where("z > 9")).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0.0)]


def test_rasterised_polygons():
    x, y = covered(np.array([1.0, 4, 4, 1]), np.array([2.0, 2, 3, 3]))
    assert sorted(zip(x.tolist(), y.tolist())) == [(i, j) for i in range(1, 5) for j in (2, 3)]
    x, y = covered(np.array([0.0, 4, 0]), np.array([0.0, 0, 4]))
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(5) for j in range(5) if i + j <= 4}
    x, y = covered(np.array([2.0]), np.array([3.0]))
    assert (x.tolist(), y.tolist()) == ([2], [3])


HEAD = "# c\nVERSION 0.7\nFIELDS x y z i\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA "


def test_point_cloud_files(spark, tmp_path):
    rows = np.array([(1, 2, 3, 4), (5, 6, 7, 8), (9, 10, 11, 12)], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "u1")])
    (tmp_path / "a.pcd").write_text(HEAD + "ascii\n1 2 3 4\n5 6 7 8\n9 10 11 12\n")
    (tmp_path / "b.pcd").write_bytes((HEAD + "binary\n").encode() + rows.tobytes())
    raw = b"".join(rows[c].tobytes() for c in rows.dtype.names)
    packed = b"".join(bytes([len(raw[a : a + 32]) - 1]) + raw[a : a + 32] for a in range(0, len(raw), 32))
    (tmp_path / "c.pcd").write_bytes((HEAD + "binary_compressed\n").encode() + np.array([len(packed), len(raw)], "<u4").tobytes() + packed)
    for name in "abc":
        got = sorted(tuple(r) for r in src.read_pcd(spark, str(tmp_path / f"{name}.pcd")).collect())
        assert got == [(1, 2, 3), (5, 6, 7), (9, 10, 11)]
    assert src.unpack_lzf(b"\x00a\x20\x00", 4) == b"aaaa"
    with pytest.raises(ValueError, match="empty"):
        src.parse_pcd(HEAD.replace("POINTS 3", "POINTS 0").encode() + b"ascii\n")
    assert cli.benchmark(spark, str(tmp_path / "a.pcd"))["points"] == 3
    assert set(cli.compare(spark, str(tmp_path / "a.pcd"))) == {"height_threshold", "morphological_pmf"}
    found = cli.recover_corridor(spark, str(tmp_path / "a.pcd"), str(tmp_path / "o"), 4.0)
    assert found["points"] == 3 and (tmp_path / "o/centerline.csv").read_text().startswith("x,y")


def test_large_binary_clouds_are_read_by_many_tasks(spark, tmp_path):
    points = np.random.default_rng(2).normal(size=(5000, 3)).astype("<f4")
    for part in (0, 1):
        out.write_pcd(cloud(spark, points[part::2]), tmp_path / f"clouds/{part}.pcd")
    found = src.read_pcd(spark, str(tmp_path / "clouds"), 1200)
    assert found.rdd.getNumPartitions() == 2 * 25
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, points.tolist()))
    raw = (tmp_path / "clouds/0.pcd").read_bytes()
    (tmp_path / "short.pcd").write_bytes(raw[:-5])
    with pytest.raises(ValueError, match="shorter"):
        src.read_pcd(spark, str(tmp_path / "short.pcd"))
    (tmp_path / "odd.pcd").write_text(HEAD + "ascii\n1 2 3 4\n5 6 7\n")
    with pytest.raises(Exception, match="other than the cloud's fields"):
        src.read_pcd(spark, str(tmp_path / "odd.pcd")).collect()
    (tmp_path / "nan.pcd").write_text(HEAD + "ascii\n1 2 nan 4\n-5 6e1 .7 8\n9 10 11 12\n")
    assert [str(r.z) for r in src.read_pcd(spark, str(tmp_path / "nan.pcd")).collect()] == ["nan", "0.699999988079071", "11.0"]
    with pytest.raises(FileNotFoundError):
        src.read_pcd(spark, str(tmp_path / "none.pcd"))


def test_overlapping_copies_unpack():
    assert src.unpack_lzf(b"\x02abc\xe0\x05\x02\x20\x00", 3 + 14 + 3) == (b"abc" * 6)[:17] + b"bbb"
    with pytest.raises(ValueError, match="damaged"):
        src.unpack_lzf(b"\x00a", 2)


def test_a_grid_too_large_is_refused(spark):
    cells = spark.createDataFrame([(0, 0, 1), (9_999_999, 9_999_999, 1)], "x int, y int, v int")
    with pytest.raises(ValueError, match="too large"):
        out.to_array(cells, "v", 0, np.uint8)


def test_rows_find_their_nearest_column():
    random = np.random.default_rng(5)
    for _ in range(40):
        rows, width = int(random.integers(1, 5)), int(random.integers(1, 40))
        row, place = np.repeat(np.arange(rows), width), np.tile(np.arange(width), rows)
        height = np.where(random.random(rows * width) < random.choice([0.02, 0.3, 1.0]), random.integers(0, 30, rows * width), np.inf)
        want = [min((place[k] - place[j]) ** 2 + height[j] ** 2 for j in range(len(row)) if row[j] == row[k]) for k in range(len(row))]
        assert distance.row_minimum(row, place, height).tolist() == want


def test_cells_are_labelled_by_their_least():
    random = np.random.default_rng(9)
    for density in (0.1, 0.5, 0.62, 0.95):
        y, x = np.nonzero(random.random((30, 40)) < density)
        order = random.permutation(len(x))
        x, y = x[order], y[order]
        least = {(a, b): (b, a) for a, b in zip(x.tolist(), y.tolist())}
        changed = True
        while changed:
            changed = False
            for a, b in least:
                near = min((least[n] for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if n in least), default=least[a, b])
                if near < least[a, b]:
                    least[a, b], changed = near, True
        got = label_cells(x, y)
        assert [(int(y[k]), int(x[k])) for k in got] == [least[c] for c in zip(x.tolist(), y.tolist())]
    assert len(label_cells(np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_regions_across_tiles(spark, tile):
    a = np.random.default_rng(11).random((23, 29)) < 0.6
    y, x = np.nonzero(a)
    least = label_cells(x, y)
    want = {(int(p), int(q)): int(y[k]) * (1 << 32) + int(x[k]) for p, q, k in zip(x, y, least)}
    assert values(components.grid_components(grid(spark, a.astype(int), "v").where("v = 1"), tile), "component") == want


def test_components_by_rounds_and_in_one_task_are_alike(spark, monkeypatch):
    random = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in components.connected_components(df).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert {tuple(r) for r in components.connected_components(df).collect()} == one
    assert components.connected_components(df.limit(0)).count() == 0


def test_areas_are_reduced_in_their_tiles(spark):
    """Polygons of any kind over several tiles and beyond the map, against every cell that they cover."""
    random = np.random.default_rng(12)
    base = random.choice([0, 205, 254], (170, 300)).astype(int)
    candidate, dist = random.random(base.shape) < 0.1, np.where(random.random(base.shape) < 0.05, np.nan, random.random(base.shape))
    rows = [(int(x), int(y), int(base[y, x]), bool(candidate[y, x]), None if np.isnan(dist[y, x]) else float(dist[y, x])) for y in range(170) for x in range(300)]
    cells = spark.createDataFrame(rows, "x int, y int, base int, is_candidate boolean, dist_m double")
    shapes = []
    for k in range(120):
        centre = random.uniform([-10, -10], [310, 180])
        shapes.append((k, [tuple(map(float, centre + random.uniform(-8, 8, 2))) for _ in range(5)]))
    areas = spark.createDataFrame(shapes, "k int, area array<struct<x:double,y:double>>")
    for convex in (False, True):
        found = {r.k: r for r in overlap(areas, "area", cells, 23.0, convex).collect()}
        assert len(found) == len(shapes)
        for k, points in shapes:
            points = np.rint(np.array(points))
            if convex:
                points = np.array(hull([tuple(p) for p in points.tolist()]))
            x, y = covered(points[:, 0], points[:, 1])
            on = (x >= 0) & (x < 300) & (y >= 0) & (y < 170)
            v, d = base[y[on], x[on]], dist[y[on], x[on]]
            d = d[~np.isnan(d)]
            r = found[k]
            assert (r.cells, r.occupied, r.unknown, r.candidates) == (on.sum(), (v == 0).sum(), (v == 205).sum(), candidate[y[on], x[on]].sum())
            assert r.near_m == (d.min() if len(d) else None)
            assert r.p10_m == (pytest.approx(np.percentile(d, 10)) if len(d) else None)
    with pytest.raises(Exception, match="margin"):
        overlap(areas, "area", cells, 2.0).collect()


def test_plots_and_pages(spark, tmp_path):
    cells = grid(spark, np.arange(6).reshape(2, 3), "v").where("v <> 1")
    assert values(plots.grid_plot(cells, "v"), "value")[1, 0] is None
    lanes = layers.labelled(aisles(spark, rect(10, 20, 110, 40)))
    assert plots.crop_window(lanes, "A01", 30) == {"x0": -20, "x1": 140, "y0": -10, "y1": 70}
    with pytest.raises(ValueError):
        plots.crop_window(lanes, "A09", 30)
    results = spark.createDataFrame([(1, True, True, 0.5, None)], "aisle_id int, passed boolean, route_recovered boolean, best_offset_m double, best_attempt_offset_m double")
    drawn = {r.kind: (r.x0, r.y0, r.x1, r.y1) for r in plots.offset_overlay(results, lanes, FOOTPRINT, 0.1, 60).collect()}
    assert drawn == {"centreline": (13, 29, 107, 29), "recovered": (13, 24, 107, 24)}
    assert plots.aisle_outlines(lanes).count() == 6
    assert "&lt;x&gt;" in out.write_html(tmp_path, ["<x>.png"]).read_text()
