"""Nearest cells of many overlapping rasters: the rows of the plan by pairs, however tasks, rounds and parts are cut."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.operators import onto, regrid
from terracell.plans import deploy, skew

SCENE = "scene_id long, w double, n double, x_res double, y_res double, height int, width int"
SMALL = {"PATCH": 4, "PAIRS": 60, "TASK_CELLS": 30, "ROUND_CELLS": 200, "DENSE": 20, "NEAR": 3, "WIDER": (2,)}


def rows(df):
    return sorted(((*r[:3], None if r[3] is None else r[3] if isinstance(r[3], tuple) else round(r[3], 9)) for r in df.collect()), key=str)


def scenes(draw, n, sizes, first=0):
    side = lambda: draw.choice(sizes)
    return [(first + k, draw.uniform(-6, 6), draw.uniform(-6, 6), draw.choice([0.5, 0.7, 1.0]), draw.choice([0.5, 1.0]), side(), side()) for k in range(n)]


def tables(spark, seed=1):
    """Rasters of 1 to 9 cells a side; cells that are null, missing, repeated, outside their raster; repeated, odd and empty rasters."""
    draw = random.Random(seed)
    sources, targets = scenes(draw, 25, [1, 3, 8]), scenes(draw, 14, [2, 5, 9], 100)
    cells = [(s[0], r, c, draw.choice([None, draw.uniform(0, 9)])) for s in sources for r in range(-1, s[5] + 1) for c in range(s[6]) if draw.random() < 0.8]
    # equal rows of a source and of a cell
    cells += [c for c in cells if c[0] % 5 == 0]
    sources += [sources[3], (None, 0.0, 0.0, 1.0, 1.0, 4, 4), (999, 0.0, 3.0, 1.0, 1.0, 4, 4)]
    targets += [(150, None, 0.0, 1.0, 1.0, 3, 3), (151, 0.0, 2.0, 1.0, 1.0, 0, 3), (152, 40.0, 2.0, 1.0, 1.0, 3, 3), (None, 0.0, 2.0, 1.0, 1.0, 3, 3)]
    cells += [(None, 0, 0, 1.0), (5, None, 0, 1.0), (7, 0, None, 2.0)]
    return spark.createDataFrame(cells, "scene_id long, r int, c int, v double"), spark.createDataFrame(sources, SCENE), targets


def by_pairs(cells, sources, targets):
    return regrid.nearest(regrid.pair_cells(cells, regrid.raster_pairs(sources, targets, 3.0)))


def weighted(cells):
    return cells.withColumn("v", F.struct((F.col("v") * (F.col("r") + 2)).alias("vw"), F.when(F.col("c") != 2, F.col("r") + 2.0).alias("w")))


@pytest.mark.parametrize("cut", [{}, SMALL])
@pytest.mark.parametrize("twice", [False, True])
def test_equals_the_plan_by_pairs(spark, monkeypatch, cut, twice):
    cells, sources, listed = tables(spark, 1 + twice)
    # a target of one id in two places
    listed = listed + ([(*listed[0][:1], listed[0][1] + 1, *listed[0][2:]), listed[2]] if twice else [])
    targets = spark.createDataFrame(listed, SCENE)
    for k, v in cut.items():
        monkeypatch.setattr(onto, k, v)
        if k == "PATCH":
            monkeypatch.setattr(skew, k, v)
    # two cells of one source may lie under such a target cell
    flat = cells.withColumn("v", F.when(F.col("v").isNotNull(), F.col("scene_id") * 1.0)) if twice else cells
    first = rows(regrid.mosaic_first(by_pairs(flat, sources, targets)))
    near = by_pairs(weighted(cells), sources, targets).select("scene_id", "r", "c", "v.vw", "v.w")
    mean = rows(regrid.mosaic_weighted(near))
    assert rows(onto.onto_targets(flat, sources, targets, 3.0)) == first
    assert rows(onto.onto_targets(weighted(cells), sources, targets, 3.0, "weighted")) == mean
    assert any(r[3] is None for r in first) and len(first) > 100


@pytest.mark.parametrize("blend", ["first", "weighted"])
def test_pairs_of_overlapping_grids_are_not_exchanged(spark, blend):
    n = 60
    grids = spark.range(n).select(F.col("id").alias("scene_id"), *[F.lit(x).alias(k) for k, x in (("w", 0.0), ("n", 4.0), ("x_res", 1.0), ("y_res", 1.0))], F.lit(4).alias("height"), F.lit(4).alias("width"))
    scores = grids.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    out = deploy.blended_mosaic(scores.withColumn("score", F.col("scene_id") * 1.0), grids, grids, 4.0, blend)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert {r[3] for r in rows(out.select("scene_id", "r", "c", "v"))} == {0.0 if blend == "first" else (n - 1) / 2} and out.count() == n * 16


def test_scores_in_rounds_are_those_of_one(spark):
    from checks.jobs import raw_layers
    from terracell.operators.grids import grid_scenes, reference_grids
    from terracell.operators.scoring import FeatureSpec

    edges, image, image_scenes, elevation, elevation_scenes = raw_layers(spark, "/root/testdata/sf0.001")
    spec, predict = FeatureSpec(mode="deploy"), lambda stack: stack.mean(axis=1)
    grids = grid_scenes(reference_grids(edges, 4, 4, 50000), 4)
    layers = deploy.stage(spark, None, "layers", lambda: deploy.layers_on_grids(image, image_scenes, elevation, elevation_scenes, grids, spec.bands, 4.0, "nearest"))
    whole = rows(deploy.score_in_rounds(layers, spec, predict))
    assert whole and rows(deploy.score_in_rounds(layers, spec, predict, cells=layers.count() // 3)) == whole
