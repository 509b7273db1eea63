"""Whole jobs: stages that a second run does not repeat, both blends, training data without features."""

import os

import pytest
from pyspark.sql import functions as F

from checks.jobs import raw_layers
from terracell.operators.grids import grid_scenes, reference_grids
from terracell.operators.regions import region_edges
from terracell.operators.scoring import FeatureSpec
from terracell.plans.deploy import deploy
from terracell.plans.stages import finished, stage
from terracell.plans.training import training_data

FOLDER = "/root/testdata/sf0.001"
SIZES = dict(grid_width=4, step=2, grid_res=50000, relief="nearest")


def half(stack):
    return stack.mean(axis=1) * 0 + 0.5


def broken(stack):
    raise RuntimeError("model lost")


def test_a_job_goes_on_after_its_last_whole_stage(spark, tmp_path):
    inputs, spec = raw_layers(spark, FOLDER), FeatureSpec(mode="deploy")
    home = str(tmp_path / "job")
    with pytest.raises(Exception, match="model lost"):
        deploy(*inputs, spec, broken, 4.0, folder=home, **SIZES)
    assert finished(spark, f"{home}/scenes") and finished(spark, f"{home}/layers") and not finished(spark, f"{home}/scores")
    written = os.stat(f"{home}/layers/_SUCCESS").st_mtime_ns

    out = deploy(*inputs, spec, half, 4.0, folder=home, out_width=4, out_res=70000, **SIZES)
    assert os.stat(f"{home}/layers/_SUCCESS").st_mtime_ns == written
    values = [x["v"] for x in out.collect()]
    assert values and all(v == pytest.approx(0.5) for v in values)
    # everything is there, so neither the model nor the layers are needed any more
    again = deploy(*inputs, spec, broken, 4.0, folder=home, out_width=4, out_res=70000, **SIZES)
    assert sorted(again.collect()) == sorted(out.collect())
    mosaic = spark.read.parquet(f"{home}/mosaic")
    assert mosaic.join(spark.read.parquet(f"{home}/targets"), "scene_id", "left_anti").count() == 0


def test_a_stage_that_was_cut_off_is_written_anew(spark, tmp_path):
    path = tmp_path / "numbers"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"half a file")
    assert stage(spark, str(tmp_path), "numbers", lambda: spark.range(3)).count() == 3
    assert stage(spark, str(tmp_path), "numbers", lambda: spark.range(9)).count() == 3


def test_no_region_gives_no_rows(spark):
    edges, *layers = raw_layers(spark, FOLDER)
    none = edges.filter("region_id < 0")
    assert deploy(none, *layers, FeatureSpec(mode="deploy"), half, 4.0, **SIZES).count() == 0


def test_training_data_without_features_is_unlabelled(spark):
    empty = spark.createDataFrame([], "fid long, x0 double, y0 double, x1 double, y1 double, cls int")
    inputs = raw_layers(spark, FOLDER)
    out = training_data(*inputs, empty, empty, ("b08", "b04", "b03", "b02"), 4.0, 2, grid_width=4, grid_res=50000, limit=0.3, relief="nearest")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label")).first()
    assert row["n"] > 0 and row["label"] == 0 and "split" not in out.columns
    sizes = out.groupBy("scene_id", "chip_r0", "chip_c0").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(sizes) == (4, 4)


def test_a_grid_cut_at_the_antimeridian_has_fewer_columns(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(point(-179.9, 0), point(-170, 0), point(-170, 4), point(-179.9, 4))
    east = F.array(point(178, 0), point(179.9, 0), point(179.9, 4), point(178, 4))
    regions = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("region_id"), ring.alias("ring")), F.struct(F.lit(2).alias("region_id"), east.alias("ring")))).alias("x")).select("x.*")
    grids = reference_grids(region_edges(regions, keys=("region_id",)), grid_width=8, step_size=4, grid_res=30000)
    scenes = grid_scenes(grids, 8).toPandas()
    assert scenes.scene_id.is_unique and len(scenes) == grids.count() and (scenes.height == 8).all() and scenes.width.between(1, 8).all()
    assert (scenes.w + scenes.width * scenes.x_res <= 179.999 + scenes.x_res / 2 + 1e-9).all() and (scenes.w >= -179.999 - 8 * scenes.x_res).all()
