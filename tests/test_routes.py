import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.raster import hull
from furrow.operators import smooth_route as S
from furrow.operators import sweep as W
from tests.grids import FOOTPRINT, FREE, OCCUPIED, UNKNOWN, aisles, area, grid, rect

RES = 0.1


@pytest.fixture(scope="module")
def wide(spark):
    return aisles(spark, rect(10, 20, 110, 40))


def _free(**boxes):
    return area(60, 120, UNKNOWN, free=(20, 41, 10, 111, FREE), **boxes)


def _map(spark, array, candidate=None, **kw):
    return W.Map.of(grid(spark, array, "base", candidate), RES, **kw)


@pytest.mark.parametrize(
    "boxes, spacing, kw, passed, reason",
    [
        ({}, 0.5, {}, True, None),
        ({"o": (23, 28, 49, 52, OCCUPIED)}, 0.2, {}, False, "occupied"),
        ({"o": (23, 28, 49, 52, UNKNOWN)}, 0.2, {}, False, "unknown"),
        ({"o": (23, 28, 49, 52, UNKNOWN)}, 0.2, {"allow_unknown": True}, True, None),
    ],
)
def test_centreline_check(spark, boxes, spacing, kw, passed, reason):
    base = area(50, 100, UNKNOWN, free=(15, 36, 10, 91, FREE), **boxes)
    r = W.validate_footprint(aisles(spark, rect(10, 15, 90, 35)), FOOTPRINT, _map(spark, base, **kw), spacing).first()
    assert (r.passed, r.first_failure_reason, r.label) == (passed, reason, "A01")
    assert r.pose_count == {0.5: 16, 0.2: 38}[spacing]
    assert (r.collision_pose_count > 0) == (reason == "occupied")
    assert (r.unknown_overlap_pose_count > 0) == bool(boxes and reason != "occupied")
    assert r.out_of_bounds_pose_count == 0
    assert (r.first_failure_pose is None) == passed


def test_candidates_are_advisory(spark):
    base = area(50, 100, UNKNOWN, free=(15, 36, 10, 91, FREE))
    candidate = np.zeros(base.shape, bool)
    candidate[23:28, 49:52] = True
    r = W.validate_footprint(aisles(spark, rect(10, 15, 90, 35)), FOOTPRINT, _map(spark, base, candidate), 0.2).first()
    assert r.passed and r.candidate_overlap_pose_count > 0


def test_offsets_fill_the_width(spark, wide):
    offsets = W.offsets_across(wide, FOOTPRINT, RES, 0.2).first().offsets
    assert offsets[0] == pytest.approx(-0.8) and offsets[-1] == pytest.approx(0.8) and 0.0 in offsets
    assert np.allclose(np.diff(offsets), 0.2)
    too_wide = [(x, 6 * y) for x, y in FOOTPRINT]
    assert W.offsets_across(wide, too_wide, RES, 0.2).first().offsets == []


def test_offset_goes_round_an_obstacle(spark, wide):
    r = W.search_offsets(wide, FOOTPRINT, _map(spark, _free(o=(28, 33, 52, 58, OCCUPIED))), 0.2, 0.1).first()
    assert not r.centerline_passed and r.passed and r.route_recovered
    assert abs(r.best_offset_m) >= 0.3 and r.best_clearance_p10_m > 0 and r.best_min_blocked_clearance_m > 0


def test_a_barrier_leaves_an_attempt(spark, wide):
    r = W.search_offsets(wide, FOOTPRINT, _map(spark, _free(o=(20, 41, 52, 58, OCCUPIED))), 0.2, 0.1).first()
    assert not r.passed and r.best_offset_m is None and r.best_attempt_offset_m is not None
    assert r.best_attempt_blocking_pose_count > 0 and r.feasible_offset_count == 0


def test_offset_prefers_clearance(spark, wide):
    r = W.search_offsets(wide, FOOTPRINT, _map(spark, _free(o=(34, 39, 30, 91, OCCUPIED))), 0.2, 0.1).first()
    assert r.passed and r.best_offset_m < 0 and r.best_min_blocked_clearance_m > 0


def test_zero_offset_equals_the_centreline(spark, wide):
    on = _map(spark, _free(o=(28, 33, 52, 58, OCCUPIED), u=(25, 30, 80, 83, UNKNOWN)))
    a = W.validate_footprint(wide, FOOTPRINT, on, 0.2).first()
    b = W.offset_routes(wide, FOOTPRINT, on, 0.2, 0.1).where("offset_m = 0").first()
    for name in ("pose_count", "collision_pose_count", "unknown_overlap_pose_count", "passed", "first_failure_reason"):
        assert a[name] == b[name], name


def test_too_long_footprints_fail_without_poses(spark, wide):
    long = [(20 * x, y) for x, y in FOOTPRINT]
    on = _map(spark, _free())
    a, b = W.validate_footprint(wide, long, on).first(), W.search_offsets(wide, long, on).first()
    assert (a.passed, a.pose_count, a.first_failure_reason, a.first_failure_pose) == (False, 0, "footprint_longer_than_aisle", None)
    assert not b.passed and b.tested_offset_count > 0


def test_bounds_and_parameters(spark, wide):
    base = area(60, 120, FREE)
    r = W.validate_footprint(aisles(spark, rect(0, 0, 119, 2)), FOOTPRINT, _map(spark, base), 0.5).first()
    assert r.first_failure_reason == "out_of_bounds" and r.out_of_bounds_pose_count == r.pose_count
    with pytest.raises(ValueError):
        W.validate_footprint(wide, FOOTPRINT[:2], _map(spark, base))
    with pytest.raises(ValueError):
        W.offsets_across(wide, FOOTPRINT, RES, 0.0)
    with pytest.raises(Exception, match="without four corners or length"):
        W.validate_footprint(aisles(spark, rect(5, 5, 5, 9)), FOOTPRINT, _map(spark, base)).collect()


def test_summary_lists_labels_in_input_order(spark):
    lanes = aisles(spark, rect(10, 20, 110, 40), rect(10, 20, 10 + 1, 40), rect(10, 20, 110, 40)).withColumn("input_ord", -F.col("aisle_id"))
    found = W.summary(W.search_offsets(lanes, FOOTPRINT, _map(spark, _free()), 0.5, 0.4), recovered="route_recovered").first()
    assert (found.pass_count, found.fail_count, found.total_aisles, found.failed_aisles) == (2, 1, 3, ["A02"])
    assert (found.recovered_count, found.recovered_aisles) == (0, [])


S_CURVE = {"a": (20, 30, 42, 48, OCCUPIED), "b": (31, 41, 72, 78, OCCUPIED)}


def _smooth(spark, array, lanes, passed=None, **kw):
    baseline = None if passed is None else spark.createDataFrame([(f"A{k + 1:02d}", p) for k, p in enumerate(passed)], "label string, passed boolean")
    return S.search_smooth_routes(lanes, FOOTPRINT, _map(spark, array, **kw), 0.1, 0.5, 0.1, 0.2, baseline=baseline)


def test_smooth_route_bends(spark, wide):
    r = _smooth(spark, _free(**S_CURVE), wide, [False]).first()
    assert r.passed and r.route_recovered_from_b1 and r.blocking_pose_count == 0 and r.sampled_passed
    assert max(r.control_offsets_m) > 0.2 and min(r.control_offsets_m) < -0.2
    assert np.abs(np.diff(r.control_offsets_m)).max() <= 0.2 + 1e-9
    assert r.max_offset_step_m == pytest.approx(np.abs(np.diff(r.control_offsets_m)).max())
    distances = [p.distance_m for p in r.route_points]
    assert distances == sorted(set(distances)) and len(r.control_offsets_m) == r.control_point_count


def test_smooth_route_and_unknown_space(spark, wide):
    base = _free(u=(20, 41, 58, 62, UNKNOWN))
    r = _smooth(spark, base, wide).first()
    assert not r.passed and r.failure_region == "interior" and r.failure_reason.startswith("no_feasible_transition_at_station_")
    assert r.min_blocked_clearance_m is None and r.blocking_pose_count == 0 and r.b1_passed is None
    assert _smooth(spark, base, wide, allow_unknown=True).first().passed


def test_straight_aisles_stay_straight(spark):
    lanes = aisles(spark, rect(10, 20, 110, 40), rect(10, 20, 110, 40))
    rows = _smooth(spark, _free(), lanes, [False, True]).orderBy("aisle_id").collect()
    for r in rows:
        assert r.passed and max(map(abs, r.control_offsets_m)) <= 0.1 and r.max_heading_deviation_rad < 1e-6
    assert [r.route_recovered_from_b1 for r in rows] == [True, False] and [r.b1_passed for r in rows] == [False, True]


def test_smooth_geometry_failures(spark, wide):
    on = _map(spark, _free())
    wider, longer = [(x, 6 * y) for x, y in FOOTPRINT], [(20 * x, y) for x, y in FOOTPRINT]
    assert S.search_smooth_routes(wide, wider, on).first().failure_reason == "footprint_wider_than_aisle"
    assert S.search_smooth_routes(wide, longer, on).first().failure_reason == "footprint_longer_than_aisle"
    exact = aisles(spark, rect(10, 20, 15, 40))  # just as long as the footprint, without a rounding error: stations coincide
    half = [(0.25, 0.2), (0.25, -0.2), (-0.25, -0.2), (-0.25, 0.2)]
    assert S.search_smooth_routes(exact, half, on).first().failure_reason == "no_feasible_first_transition"


def test_hull_is_convex_and_holds_all_points():
    random = np.random.default_rng(1)
    for _ in range(50):
        points = [tuple(p) for p in random.integers(0, 12, (9, 2)).tolist()]
        ring = hull(points)
        if len(ring) < 3:
            continue
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            assert all((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0 for px, py in points)
        assert set(ring) <= set(points)


def test_program_equals_all_routes():
    random = np.random.default_rng(5)
    offsets = [-0.2, -0.1, 0.0, 0.1, 0.2]
    for _ in range(30):
        stations = 4
        moves = {-1: [(k, 0, abs(o), 0.0, 0) for k, o in enumerate(offsets)]}
        for s in range(stations - 1):
            moves[s] = [(i, j, offsets[j] - offsets[i], float(random.uniform(0.05, 1)), int(random.integers(0, 5))) for i in range(5) for j in range(5) if abs(i - j) <= 1 and random.random() < 0.7]
        table = {(s, m[0], m[1]): m for s in range(stations - 1) for m in moves[s]}

        def cost(path):
            total = S.OFFSET * sum(abs(offsets[k]) for k in path)
            for s, (i, j) in enumerate(zip(path, path[1:])):
                if (s, i, j) not in table:
                    return None
                _, _, change, p10, candidates = table[s, i, j]
                total += S.CLEARANCE / max(p10, 0.1) + S.CHANGE * abs(change) + S.CANDIDATES * candidates
                if s:
                    total += S.BEND * abs(change - table[s - 1, path[s - 1], i][2])
            return total

        every = [c for c in map(cost, __import__("itertools").product(range(5), repeat=stations)) if c is not None]
        path, _ = S.cheapest(moves, stations, 0.1)
        assert (path is None) == (not every)
        if path:
            assert cost(path) == pytest.approx(min(every))
