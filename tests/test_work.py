"""Joins and grids whose work is pairs or places, not bytes: cut by work, and right wherever they are cut."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as G
from terracell.operators import burn, grids, regions, regrid, spatial
from terracell.plans import skew


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tasks(df):
    return df.rdd.getNumPartitions()


def shapes(spark, n=12):
    """Edges of n squares of side 6 with a square hole, at 5 times their number."""
    ring = lambda x, y, a, b: [(x + a, y + a), (x + b, y + a), (x + b, y + b), (x + a, y + b)]
    held = []
    for k in range(n):
        for corners in (ring(k * 5.0, float(k % 3), 0, 6), ring(k * 5.0, float(k % 3), 2, 4)):
            held += [(k, *a, *b) for a, b in zip(corners, [*corners[1:], corners[0]])]
    return spark.createDataFrame(held, "region_id long, x0 double, y0 double, x1 double, y1 double")


def inside(x, y, k):
    x, y = x - k * 5.0, y - k % 3
    return 0 <= x < 6 and 0 <= y < 6 and not (2 <= x < 4 and 2 <= y < 4)


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("pairs", [1, 7, 50, 10**6])
def test_join_by_work_meets_every_pair_once(spark, pairs, both):
    a = [(i % 3, i) for i in range(40)] + [(None, 99)]
    b = [(j % 4, j) for j in range(30)] + [(None, 98)]
    left, right = spark.createDataFrame(a, "k int, i int"), spark.createDataFrame(b, "k int, j int")
    out = skew.join_by_work(left, right, ["k"], ["i"], ["j"] if both else None, pairs=pairs)
    assert rows(out.select("i", "j")) == sorted((i, j) for k, i in a for l, j in b if k is not None and k == l)
    if not both:
        assert out.groupBy("i", "k").agg(F.count_distinct("_pl").alias("n")).filter("n > 1").count() == 0


def test_small_tables_with_many_pairs_are_no_single_task(spark):
    box = lambda n: spark.range(n).select(F.col("id").alias(f"i{n}"), F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", (0.0, 0.0, 1.0, 1.0))]).alias(f"b{n}"))
    joined = spatial.box_join(box(300), box(301), "b300", "b301", 4.0, "i300", "i301", hot=50)
    assert joined.count() == 300 * 301 and tasks(joined) > 20


def test_points_and_boxes_in_shapes_exchange_no_pairs(spark):
    draw = random.Random(3)
    spots = [(i, draw.uniform(-3, 65), draw.uniform(-3, 12)) for i in range(400)]
    points = spark.createDataFrame(spots, "p long, x double, y double")
    found = regions.points_in_regions(points, shapes(spark), 4.0, "p")
    assert rows(found) == sorted((k, i) for i, x, y in spots for k in range(12) if inside(x, y, k))
    box = lambda i, x, y: (x, y, x + 0.3 * 3 ** (i % 5), y + 0.3 * 3 ** (i % 4))
    boxes = points.select("p", F.struct("x", "y", (F.col("x") + 0.3 * F.pow(F.lit(3.0), F.col("p") % 5)).alias("e"), (F.col("y") + 0.3 * F.pow(F.lit(3.0), F.col("p") % 4)).alias("n")).alias("b"))
    boxes = boxes.select("p", F.struct(F.col("b.x").alias("w"), F.col("b.y").alias("s"), "b.e", "b.n").alias("box"))
    far = lambda lo, hi, a, b: max(lo - b, a - hi, 0.0)
    near = lambda b, k, d: any(
        (far(b[0], b[2], k * 5.0 + u, k * 5.0 + v) ** 2 + far(b[1], b[3], k % 3 + s, k % 3 + t) ** 2) ** 0.5 <= d
        for u, v, s, t in ((0, 6, 0, 2), (0, 6, 4, 6), (0, 2, 0, 6), (4, 6, 0, 6))
    )
    for d in (0.0, 0.4):
        met = regions.regions_meet_boxes(boxes, shapes(spark), 4.0, "p", within=d)
        assert rows(met) == sorted((k, i) for i, x, y in spots for k in range(12) if near(box(i, x, y), k, d))
        # the last exchange lies below the join: what is aggregated stays where it met
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_an_id_of_boxes_in_two_places_is_one_pair(spark):
    at = lambda x: F.struct(F.lit(x).alias("w"), F.lit(1.0).alias("s"), F.lit(x + 0.5).alias("e"), F.lit(1.5).alias("n"))
    boxes = spark.range(1).select(F.lit("f").alias("file"), F.explode(F.array(at(0.2), at(5.2), at(5.9))).alias("box"))
    assert rows(regions.regions_meet_boxes(boxes, shapes(spark, 1), 4.0, "file")) == [(0, "f")]


def test_near_segments_equal_the_distance(spark):
    draw = random.Random(5)
    cut = lambda: draw.choice([0.0, 1.0, 2.0, draw.uniform(-2, 5)])
    held = [(i, cut(), cut(), cut(), cut()) for i in range(600)]
    s = spark.createDataFrame(held, "i int, x0 double, y0 double, x1 double, y1 double")
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", (0.0, 1.0, 2.0, 2.0))])
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    for d in (0.0, 0.5, 1.0):
        assert s.filter((G.segment_box_distance(*ends, box) <= d) != G.segment_near_box(*ends, box, d)).count() == 0


def test_grids_are_made_in_as_many_tasks_as_they_need(spark, monkeypatch):
    whole = rows(grids.reference_grids(shapes(spark), 20, 10, 1000))
    monkeypatch.setattr(grids, "PER_TASK", 100)
    out = grids.reference_grids(shapes(spark), 20, 10, 1000)
    assert rows(out) == whole and tasks(out) > 20


def test_edges_and_segments_are_not_broadcast(spark, tmp_path):
    # a small file of which many rows are made
    spark.range(50).select(F.col("id").alias("fid"), (F.col("id") * 1.0).alias("x")).write.parquet(str(tmp_path / "f"))
    x = F.col("x")
    lines = spark.read.parquet(str(tmp_path / "f")).select(F.lit(1).alias("scene_id"), "fid", F.lit(1).alias("cls"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 2).alias("x1"), F.lit(0.0).alias("y1"))
    scenes = spark.range(1).select(F.col("id").alias("scene_id"), F.lit(0.0).alias("w"), F.lit(8.0).alias("n"), F.lit(1.0).alias("x_res"), F.lit(1.0).alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    for out in (burn.line_junctions(lines, 4.0), burn.edges_in_grids(lines.drop("scene_id"), scenes, 8.0)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    # three lines meet at every place from 2 to 49
    assert burn.line_junctions(lines, 4.0).count() == 48


def test_sources_without_cells_make_no_pairs(spark, monkeypatch):
    scene = "scene_id long, w double, n double, x_res double, y_res double, height int, width int"
    sources = spark.createDataFrame([(k, 0.0, 2.0, 1.0, 1.0, 2, 2) for k in range(50)], scene)
    targets = spark.createDataFrame([(7, 0.0, 2.0, 1.0, 1.0, 2, 2)], scene)
    cells = spark.createDataFrame([(3, r, c, float(r * 2 + c)) for r in range(2) for c in range(2)], "scene_id long, r int, c int, v double")
    seen, pair = [], regrid.raster_pairs
    monkeypatch.setattr(regrid, "raster_pairs", lambda *a: seen.append(pair(*a)) or seen[-1])
    assert rows(regrid.cut_to_targets(cells, sources, targets, 4.0)) == [(7, 0, 0, 0.0), (7, 0, 1, 1.0), (7, 1, 0, 2.0), (7, 1, 1, 3.0)]
    assert seen[0].count() == 1
