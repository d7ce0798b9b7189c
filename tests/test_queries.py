"""The named map queries on small tables: they read all of them."""

import math

import numpy as np
import pytest

from furrow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """A grid of 120 x 130 cells, so that its main axis runs along y, with more suppliers than aisles that fit."""
    folder = str(tmp_path_factory.mktemp("tall"))
    custkeys = np.random.default_rng(3).integers(0, 4000, 120 * 130).tolist()
    spark.createDataFrame(list(enumerate(custkeys)), "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(40)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return folder, custkeys


def regions(cells):
    left = set(cells)
    while left:
        ahead, found = [left.pop()], []
        while ahead:
            x, y = ahead.pop()
            found.append((x, y))
            for step in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if step in left:
                    left.remove(step)
                    ahead.append(step)
        yield found


def direction(cells):
    axis = np.linalg.eigh(np.cov(np.array(list(cells), float).T))[1][:, 1]
    return axis * (1 if axis[0] >= 0 else -1)


def test_row_direction_reads_the_whole_mask(spark, tall):
    folder, custkeys = tall
    mask = {(k % 120, k // 120) for k, c in enumerate(custkeys) if c % 40 < 20}
    found, (dx, dy) = QUERIES["row_direction"](spark, folder).first(), direction(mask)
    assert abs(dy) > 0.9
    assert (found.dx, found.dy, found.angle_rad) == pytest.approx((dx, dy, math.atan2(dy, dx)), abs=2e-6)


def test_corridor_reads_the_whole_mask(spark, tall):
    folder, custkeys = tall
    mask = {(k % 120, k // 120) for k, c in enumerate(custkeys) if c % 40 < 20}
    kept = {c for region in regions(mask) if len(region) >= 8 for c in region}
    score = abs(float(direction(mask) @ direction(kept)))
    assert score > 0.75 and max(y for _, y in kept) > 100
    assert {(r.x, r.y) for r in QUERIES["corridor_cells"](spark, folder).collect()} == kept


def test_every_aisle_on_the_grid_is_looked_at(spark, tall):
    folder, _ = tall
    on_grid = [k for k in range(40) if 6 * k + 5 <= 129]
    assert len(on_grid) == 21
    assert sorted(r.aisle_id for r in QUERIES["aisle_geometry"](spark, folder).collect()) == on_grid
    strips = {(x, y) for k in on_grid for x in range(2, 118) for y in range(6 * k + 1, 6 * k + 6)}
    assert {(r.x, r.y) for r in QUERIES["navigation_layers"](spark, folder).where("is_aisle").collect()} == strips


def test_routes_meet_what_lies_between_poses_half_a_metre_apart(spark, tmp_path):
    """Two aisles, the second one shut by a wall one cell thick at x = 5."""
    keys = [(k, 211 if k % 120 == 5 and 7 <= k // 120 <= 11 else 1) for k in range(120 * 13)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,), (1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")

    def found(name):
        return sorted(QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: r.aisle_id)

    assert [(r.pose_count, r.passed, r.first_failure_reason) for r in found("footprint_validation")] == [(114, True, None), (114, False, "occupied")]
    assert [(r.tested_offset_count, r.feasible_offset_count, r.passed) for r in found("offset_search")] == [(7, 7, True), (7, 0, False)]
    assert [(r.control_point_count, r.tested_offset_count, r.b1_passed, r.passed) for r in found("smooth_routes")] == [(24, 7, True, True), (24, 7, False, False)]
