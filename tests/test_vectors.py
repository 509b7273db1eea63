"""Spatial joins, grids, burning, regridding and mosaics against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import base
from terracell.functions import geometry as G
from terracell.operators import burn, grids, regrid, spatial
from terracell.operators.regions import region_edges


def boxes(spark, rows, key, box):
    df = spark.createDataFrame(rows, f"{key} long, w double, s double, e double, n double")
    return df.select(key, F.struct("w", "s", "e", "n").alias(box))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_box_join_with_a_hot_bucket(spark, hot):
    rng = np.random.default_rng(0)

    def make(count):
        w, s = rng.integers(-30, 30, count) / 2, rng.integers(-30, 30, count) / 2
        w[: count // 3], s[: count // 3] = 1.25, 1.25  # a third on one spot
        return [(i, float(w[i]), float(s[i]), float(w[i] + rng.integers(0, 9) / 2), float(s[i] + rng.integers(0, 9) / 2)) for i in range(count)]

    a, b = make(60), make(50)
    out = spatial.box_join(boxes(spark, a, "i", "p"), boxes(spark, b, "j", "q"), "p", "q", 2.0, "i", hot=hot)
    got = sorted((x["i"], x["j"]) for x in out.collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert got == want


@pytest.mark.parametrize("levels", [10, 3, 1])
def test_boxes_of_mixed_sizes_meet_once(spark, levels):
    rng = np.random.default_rng(levels)

    def make(count, step):
        rows = []
        for i in range(count):
            side = float(rng.choice([0.0, 0.01, 0.25, 2.0, 16.0, 60.0]))
            w, s = float(rng.integers(-40, 40)) / 4, float(rng.integers(-40, 40)) / 4
            rows.append((i, w, s, w + side, s + side / step))
        rows[: count // 3] = [(i, 1.25, 1.25, 1.25 + i % 2, 1.5) for i in range(count // 3)]  # a third on one spot
        return [*rows, (count, None, 0.0, 1.0, 1.0), (count + 1, 3.0, 0.0, 2.0, 1.0)]  # no west side; turned round

    a, b = make(60, 1), make(50, 4)
    out = spatial.boxes_meet(boxes(spark, a, "i", "p"), boxes(spark, b, "j", "q"), "p", "q", finest=0.25, levels=levels)
    got = sorted((x["i"], x["j"]) for x in out.collect())
    want = sorted((x[0], y[0]) for x in a[:60] for y in b[:50] if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert got == want


def test_no_boxes_meet_none(spark):
    some, none = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "i", "p"), boxes(spark, [], "j", "q")
    assert spatial.boxes_meet(some, none, "p", "q").count() == 0


def test_reference_grids_cover_the_region(spark):
    ring = G.box_ring(*[F.lit(v) for v in (10.0, 40.0, 10.5, 40.4)])
    regions = spark.range(1).select(F.col("id").alias("region_id"), ring.alias("ring"))
    out = grids.reference_grids(region_edges(regions, keys=("region_id",)), grid_width=832, step_size=832).toPandas()
    rng = np.random.default_rng(0)
    for x, y in zip(rng.uniform(10, 10.5, 200), rng.uniform(40, 40.4, 200)):
        assert ((out.w <= x) & (x < out.e) & (out.s <= y) & (y < out.n)).sum() == 1
    metres = (out.n - out.s).iloc[0] * math.pi / 180 * 6370e3
    assert abs(metres - 8320) < 30
    assert out.file_name.str.match(r"bbox_\d+\.\d{10}_\d+\.\d{10}_\d+\.\d{10}_\d+\.\d{10}\.tif").all()


@pytest.mark.parametrize("w,e", [(-180.0, -179.5), (179.5, 180.0)])
def test_grids_stay_inside_the_antimeridian(spark, w, e):
    ring = G.box_ring(*[F.lit(v) for v in (w, 0.0, e, 0.3)])
    edges = region_edges(spark.range(1).select(F.col("id").alias("region_id"), ring.alias("ring")), keys=("region_id",))
    out = grids.reference_grids(edges, 500, 500, 20).toPandas()
    assert len(out) and out.w.min() >= -179.999 and out.e.max() <= 179.999


SHAPES = {
    "notch": [[(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]],
    "hole": [[(10, 10), (14, 10), (14, 14), (10, 14)], [(11, 11), (11, 13.3), (13.2, 13.3), (13.2, 11)]],
    "parts": [[(20, -5), (20.4, -4.6), (20, -4.2)], [(22, -3), (23, -2.7), (22.2, -1.9)]],
    "sliver": [[(30, 50), (34, 53.99), (34, 54), (30, 50.01)]],
}


def shape_edges(spark, shapes):
    rows = [(k, n, i, *map(float, (*ring[i], *ring[(i + 1) % len(ring)]))) for k, rings in shapes.items() for n, ring in enumerate(rings) for i in range(len(ring))]
    return spark.createDataFrame(rows, "region_id string, ring int, i int, x0 double, y0 double, x1 double, y1 double")


def box_meets(box, rings):
    """Plain even-odd test of a corner, and plain clipping of every edge."""
    w, s, e, n = box
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            inside ^= (y0 > s) != (y1 > s) and w < x0 + (s - y0) * (x1 - x0) / (y1 - y0)
            low, high = 0.0, 1.0
            for d, a, b in ((x1 - x0, w - x0, e - x0), (y1 - y0, s - y0, n - y0)):
                if d == 0:
                    if a > 0 or b < 0:
                        low = 2.0
                else:
                    low, high = max(low, min(a / d, b / d)), min(high, max(a / d, b / d))
            if low <= high:
                return True
    return inside


def test_grids_of_shapes_equal_a_scan_of_the_whole_lattice(spark):
    out = grids.reference_grids(shape_edges(spark, SHAPES), grid_width=50, step_size=30, grid_res=1000).collect()
    for k, rings in SHAPES.items():
        mine = {(r.grid_row, r.grid_col): (r.w, r.s, r.e, r.n) for r in out if r.region_id == k}
        xs, ys = [x for ring in rings for x, _ in ring], [y for ring in rings for _, y in ring]
        (row, col), (w, s, e, n) = next(iter(mine.items()))
        dx, dy = (e - w) * 30 / 50, (n - s) * 30 / 50
        w, s, wide, high = w - col * dx, s - row * dy, e - w, n - s
        rows, cols = range(int((max(ys) - s) / dy) + 2), range(int((max(xs) - w) / dx) + 2)
        want = {(i, j) for i in rows for j in cols if box_meets((w + j * dx, s + i * dy, w + j * dx + wide, s + i * dy + high), rings)}
        assert set(mine) == want
        whole = len(rows) * len(cols)
        assert k != "sliver" or len(want) < whole / 3


def test_grids_hold_no_ring_in_a_row_and_scan_no_lattice(spark):
    plan = grids.reference_grids(shape_edges(spark, SHAPES))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "collect_list" not in plan


def test_tile_table_covers_the_world_once(spark):
    t = grids.tile_table(spark, 3).toPandas()
    assert len(t) == 64 and t.w.min() == -180 and t.e.max() == 180 and abs(t.n.max() - 85.051128780) < 1e-8
    assert np.allclose(sorted(set(t.n))[:-1], sorted(set(t.s))[1:])


def test_chips_cover_every_cell_once_when_step_is_size(spark):
    rows = [(0, r, c, r * 10 + c) for r in range(6) for c in range(9)]
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, v int")
    out = grids.to_chips(df, (F.lit(6), F.lit(9)), 3).collect()
    assert len(out) == 54 and len({(x["chip_r0"], x["chip_c0"]) for x in out}) == 6
    assert all(x["v"] == (x["chip_r0"] + x["r"]) * 10 + x["chip_c0"] + x["c"] for x in out)
    partial = grids.to_chips(df, (F.lit(6), F.lit(9)), 4, 3, 3).select("chip_r0", "chip_c0").distinct().count()
    assert partial == 1 * 2


def sampled_distance(seg, box, steps=4000):
    t = np.linspace(0, 1, steps)
    x, y = seg[0] + t * (seg[2] - seg[0]), seg[1] + t * (seg[3] - seg[1])
    dx = np.maximum(np.maximum(box[0] - x, x - box[2]), 0)
    dy = np.maximum(np.maximum(box[1] - y, y - box[3]), 0)
    return np.sqrt(dx * dx + dy * dy).min()


def canvas(spark, size):
    return spark.createDataFrame([(0, 0.0, float(size), 1.0, 1.0, size, size)], "scene_id long, w double, n double, x_res double, y_res double, height int, width int")


def test_touched_cells_against_sampling(spark):
    rng = np.random.default_rng(3)
    segs = [tuple(float(v) for v in rng.uniform(-2, 14, 4)) for _ in range(12)] + [(3.0, 3.0, 3.0, 3.0), (2.0, 5.0, 9.0, 5.0), (4.5, 1.0, 4.5, 9.0)]
    rows = [(0, i, i + 1, *s) for i, s in enumerate(segs)]
    df = spark.createDataFrame(rows, "scene_id long, fid long, cls int, x0 double, y0 double, x1 double, y1 double").join(canvas(spark, 12), "scene_id")
    got = {(x["cls"] - 1, x["r"], x["c"]) for x in burn.touched_cells(df, 0.25).collect()}
    for i, s in enumerate(segs):
        for r in range(12):
            for c in range(12):
                d = sampled_distance(s, (c, 11 - r, c + 1, 12 - r))
                if abs(d - 0.25) > 0.01:
                    assert ((i, r, c) in got) == (d < 0.25), (i, r, c, d)


def test_filled_polygon_with_hole(spark):
    outer = [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)]
    hole = [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]
    rows = [(0, 5, 8, *map(float, (*a, *b))) for ring in (outer, hole) for a, b in zip(ring, ring[1:])]
    df = spark.createDataFrame(rows, "scene_id long, fid long, cls int, x0 double, y0 double, x1 double, y1 double").join(canvas(spark, 10), "scene_id")
    got = {(x["r"], x["c"]) for x in burn.filled_cells(df).collect()}
    want = {(9 - y, x) for x in range(1, 9) for y in range(1, 9) if not (3 <= x < 6 and 3 <= y < 6)}
    assert got == want


def test_junction_needs_three_lines(spark):
    rows = [(0, 1, 3, 0.0, 0.0, 5.0, 5.0), (0, 2, 3, 5.0, 5.0, 9.0, 5.0), (0, 3, 3, 5.0, 5.0, 5.0, 9.0), (0, 4, 3, 9.0, 5.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "scene_id long, fid long, cls int, x0 double, y0 double, x1 double, y1 double")
    points = burn.junctions(burn.end_points(df)).collect()
    assert [(p["x"], p["y"], p["lines"]) for p in points] == [(5.0, 5.0, 3)]
    labels = {(x["r"], x["c"]): x["label"] for x in burn.burn_lines(df, canvas(spark, 10), 0.1).collect()}
    assert labels[4, 5] == 22 and labels[9, 0] == 3


def scenes(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, w double, n double, x_res double, y_res double, height int, width int")


def raster(spark, arrays):
    rows = [(i, r, c, None if v != v else float(v)) for i, a in arrays.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "scene_id long, r int, c int, v double")


def test_mosaic_of_one_raster_is_itself(spark):
    a = np.random.default_rng(1).integers(0, 99, (5, 6)).astype(float)
    meta = scenes(spark, [(0, 10.0, 5.0, 1.0, 1.0, 5, 6)])
    for method in ("nearest", "cubic"):
        out = regrid.cut_to_targets(raster(spark, {0: a}), meta, meta, 8.0, method).collect()
        assert len(out) == 30 and all(abs(x["v"] - a[x["r"], x["c"]]) < 1e-9 for x in out)


def test_first_valid_wins_and_gaps_fall_through(spark):
    a, b = np.full((2, 2), 1.0), np.full((2, 2), 2.0)
    a[0, 0] = np.nan
    meta = scenes(spark, [(0, 0.0, 2.0, 1.0, 1.0, 2, 2), (1, 0.0, 2.0, 1.0, 1.0, 2, 2)])
    target = scenes(spark, [(9, 0.0, 2.0, 1.0, 1.0, 2, 2)])
    out = {(x["r"], x["c"]): x["v"] for x in regrid.cut_to_targets(raster(spark, {0: a, 1: b}), meta, target, 4.0).collect()}
    assert out == {(0, 0): 2.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}


def keys_kernel(t):
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else (-0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0)


def test_cubic_with_missing_cells_against_loop(spark):
    a = np.random.default_rng(7).uniform(0, 50, (7, 8))
    a[2, 3] = np.nan
    source, target = scenes(spark, [(0, 0.0, 7.0, 1.0, 1.0, 7, 8)]), scenes(spark, [(0, 0.4, 6.7, 0.3, 0.35, 15, 20)])
    out = {(x["r"], x["c"]): x["v"] for x in regrid.cut_to_targets(raster(spark, {0: a}), source, target, 16.0, "cubic").collect()}
    for r in range(15):
        for c in range(20):
            x, y = 0.4 + (c + 0.5) * 0.3 - 0.5, 7 - (6.7 - (r + 0.5) * 0.35) - 0.5
            top = bottom = 0.0
            for (i, j), v in np.ndenumerate(a):
                k = keys_kernel(x - j) * keys_kernel(y - i)
                if k and v == v:
                    top, bottom = top + k * v, bottom + k
            assert abs(out[r, c] - top / bottom) < 1e-6


def test_merging_first_reaches_across_the_seam(spark):
    a = np.arange(16.0).reshape(2, 8).repeat(3, axis=0)
    whole = scenes(spark, [(0, 0.0, 6.0, 1.0, 1.0, 6, 8)])
    halves = scenes(spark, [(0, 0.0, 6.0, 1.0, 1.0, 6, 4), (1, 4.0, 6.0, 1.0, 1.0, 6, 4)])
    target = scenes(spark, [(5, 2.25, 5.0, 0.5, 0.5, 6, 7)])
    one = regrid.cut_to_targets(raster(spark, {0: a}), whole, target, 4.0, "cubic")
    two = regrid.cut_merged_to_targets(raster(spark, {0: a[:, :4], 1: a[:, 4:]}), halves, target, 4.0, "cubic")
    get = lambda df: {(x["r"], x["c"]): round(x["v"], 9) for x in df.collect()}
    assert get(one) == get(two) and len(get(one)) == 42


def test_weighted_mosaic_skips_missing_and_zero_weight(spark):
    rows = [(0, 0, 0, 6.0, 2.0), (0, 0, 0, None, 1.0), (0, 0, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, vw double, w double")
    assert {(x["c"], x["v"]) for x in regrid.mosaic_weighted(df).collect()} == {(0, 3.0), (1, None)}


def test_clip_and_point_in_ring(spark):
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", (0.0, 0.0, 4.0, 4.0))])
    rows = [(0, -2.0, 2.0, 6.0, 2.0), (1, 5.0, 5.0, 9.0, 9.0), (2, 1.0, 1.0, 1.0, 1.0), (3, -1.0, 3.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double")
    clip = G.clip_segment(*[F.col(k) for k in ("x0", "y0", "x1", "y1")], box)
    out = {x["i"]: None if x["k"] is None else tuple(x["k"]) for x in df.select("i", clip.alias("k")).collect()}
    assert out == {0: (0.0, 2.0, 4.0, 2.0), 1: None, 2: (1.0, 1.0, 1.0, 1.0), 3: (0.0, 4.0, 0.0, 4.0)}


def test_box_meets_ring_with_a_notch(spark):
    """An L: boxes in the notch do not meet it, boxes inside, across and touching do."""
    ring = "array(" + ", ".join(f"struct({x}D AS x, {y}D AS y)" for x, y in ((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6), (0, 0))) + ")"
    cases = {(3, 3, 5, 5): False, (0.5, 0.5, 1, 1): True, (-1, -1, 9, 9): True, (2, 3, 4, 5): True, (6.5, 0, 7, 1): False, (5, 1, 8, 8): True}
    df = spark.createDataFrame([tuple(map(float, k)) for k in cases], "w double, s double, e double, n double")
    met = df.select("w", "s", "e", "n", G.box_meets_ring(F.struct("w", "s", "e", "n"), F.expr(ring)).alias("meets"))
    assert {tuple(x)[:4]: x["meets"] for x in met.collect()} == {tuple(map(float, k)): v for k, v in cases.items()}


def test_fast_rounding_gives_the_same_numbers(spark):
    draw = random.Random(6)
    ties = [(k + 0.5) / 1e6 * s for k in (*range(40), 123456, 10**9, 10**12) for s in (1, -1)]
    odd = [None, 0.0, -0.0, -1e-9, 1e-300, 1e6, 1e17, -1e300, float("inf"), float("-inf"), float("nan")]
    held = [*ties, *odd, *[draw.uniform(-1, 1) * 10 ** draw.randrange(-8, 14) for _ in range(4000)], *[round(draw.uniform(-99, 99), 6) for _ in range(999)]]
    df = spark.createDataFrame([(v,) for v in held], "v double")
    pairs = df.select(base.r6(F.col("v")).alias("a"), base.r6_fast(F.col("v")).alias("b")).collect()
    assert all(repr(x.a) == repr(x.b) for x in pairs)
