"""Small inputs on which rows were once lost or shapes misjudged."""

import pytest
from pyspark.sql import functions as F

from terracell.operators import burn, catalog, layers as L, metrics, scoring
from terracell.plans.training import training_chips
from terracell.sources import layers, records
from terracell.streaming.incremental import process_new


def cells(spark, side, without=(), nan=()):
    rows = [(1, r, c, float("nan") if (r, c) in nan else float(r + c)) for r in range(side) for c in range(side) if (r, c) not in without]
    return spark.createDataFrame(rows, "scene_id long, r int, c int, v double")


def test_a_scene_in_several_batches_is_kept_whole(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k), (2, k), (1, 0)], "scene_id long, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scene_id long, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: process_new(stream, lambda df: df.dropDuplicates(), str(tmp_path / "out"), str(tmp_path / "check"), "scene_id")
    want = [(s, k) for s in (1, 2) for k in range(3)]
    assert sorted(map(tuple, run().collect())) == want
    # the same files delivered again bring nothing, a new piece of an old scene does
    spark.createDataFrame([(2, 2), (2, 9), (None, 1)], "scene_id long, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, run().filter("scene_id is not null").collect())) == sorted([*want, (2, 9)])


@pytest.mark.parametrize("files", [1, 2, 100])
def test_repeats_inside_and_across_batches_are_left_out(spark, tmp_path, files):
    """However the files fall into batches; a restart knows what came before without the sink."""
    deliver = lambda *rows: spark.createDataFrame(rows, "scene_id long, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        deliver((1, 1), (1, 2), (2, 1), (1, 1))
    deliver((1, 2), (3, 1), (None, 5), (None, 5))
    stream = spark.readStream.schema("scene_id long, b int").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    run = lambda out: sorted(map(str, map(tuple, process_new(stream, lambda df: df, str(tmp_path / out), str(tmp_path / "check"), "scene_id").collect())))
    assert run("out") == sorted(map(str, [(1, 1), (1, 2), (2, 1), (3, 1), (None, 5)]))
    deliver((1, 1), (4, 1), (4, 1))
    # another sink: only what is new arrives there, so nothing of the first sink was read
    assert run("other") == ["(4, 1)"]


def test_pieces_are_forgotten_behind_the_watermark(spark, tmp_path):
    for rows in ([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00")], [(2, "2024-01-09 00:00:00")], [(1, "2024-01-01 00:00:00")]):
        df = spark.createDataFrame(rows, "scene_id long, t string").selectExpr("scene_id", "cast(t as timestamp) as ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scene_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = process_new(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "check"), "scene_id", time="ts", delay="1 day")
    assert sorted(r.scene_id for r in out.collect()) == [1, 2]


def test_bounds_select_or_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 5, 2.0), (2, 0, 0, 3.0)], "scene_id long, r int, c int, v double")
    scenes = spark.createDataFrame([(1, 0.0, 10.0, 1.0, 1.0, 10, 10), (2, 50.0, 10.0, 1.0, 1.0, 10, 10)], "scene_id long, w double, n double, x_res double, y_res double, height int, width int")
    layers.write_layer(df, str(tmp_path / "with"), "image", scenes=scenes)
    read = lambda *b: sorted(r.v for r in layers.read_layer(spark, str(tmp_path / "with"), "image", b).collect())
    assert read(0.0, 0.0, 4.0, 10.0) == [1.0] and read(100.0, 0.0, 120.0, 10.0) == [] and read(0.0, 0.0, 60.0, 10.0) == [1.0, 2.0, 3.0]
    layers.write_layer(df, str(tmp_path / "without"), "image")
    with pytest.raises(ValueError):
        layers.read_layer(spark, str(tmp_path / "without"), "image", (0.0, 0.0, 1.0, 1.0))


def test_absent_and_undefined_cells_are_missing(spark):
    df = cells(spark, 4, without={(0, 0), (3, 3)}, nan={(1, 1)})
    assert L.missing_share(df, ["scene_id"], area=16).first().missing_share == pytest.approx(3 / 16)
    assert L.tolerated_chips(df.withColumn("layer", F.lit("a")), ["scene_id"], limit=0.15, area=16).count() == 0


def test_training_counts_cells_that_a_layer_lacks(spark):
    image = cells(spark, 4).withColumnRenamed("v", "image")
    relief = cells(spark, 4, without={(r, c) for r in range(3) for c in range(3)}).withColumnRenamed("v", "relief")
    assert training_chips([image, relief], ["image", "relief"], 4, shape=(4, 4)).count() == 0
    whole = cells(spark, 4, without={(0, 0)}).withColumnRenamed("v", "relief")
    assert training_chips([image, whole], ["image", "relief"], 4, shape=(4, 4)).count() == 16


def test_a_chip_with_a_hole_is_not_whole(spark):
    holed = cells(spark, 4, without={(1, 2)})
    assert L.drop_odd_sized_chips(holed, ["scene_id"], 4).count() == 0
    both = holed.union(cells(spark, 4).withColumn("scene_id", F.lit(2).cast("long")))
    assert L.drop_odd_sized_chips(both, ["scene_id"], 4).count() == 16
    tensors = scoring.chip_tensors(both, ["scene_id"], ["v"])
    scored = scoring.score_chips(tensors, ["scene_id"], ["v"], lambda x: x[:, 0])
    assert [r.scene_id for r in scored.collect()] == [2]


LINES = "scene_id long, fid long, part int, seq int, x0 double, y0 double, x1 double, y1 double"


def test_junctions_of_lines(spark):
    cross = [(1, f, 0, s, *p) for f, ps in enumerate([((0, 0, 5, 5), (5, 5, 10, 10)), ((0, 10, 5, 5), (5, 5, 10, 0)), ((5, 0, 5, 5), (5, 5, 5, 10))]) for s, p in enumerate(ps)]
    tee = [(2, 0, 0, 0, 0.0, 0.0, 10.0, 0.0), (2, 1, 0, 0, 5.0, 0.0, 5.0, 5.0), (2, 2, 0, 0, 5.0, 0.0, 5.0, -5.0)]
    parts = [(3, 7, p, 0, 0.0, 0.0, x, y) for p, (x, y) in enumerate([(4.0, 0.0), (0.0, 4.0), (-4.0, 0.0)])]
    rows = [(a, b, c, d, *map(float, xy)) for a, b, c, d, *xy in cross + tee + parts]
    df = spark.createDataFrame(rows, LINES)
    for lines in (df, df.drop("seq")):
        assert sorted(map(tuple, burn.line_junctions(lines, 2.0).collect())) == [(2, 5.0, 0.0, 3), (3, 0.0, 0.0, 3)]


def test_history_counts_batches_not_numbers(spark):
    rows = [(100 * b, 1e9 + (1000.0 if b == 30 and k == 0 else float(k % 2))) for b in range(31) for k in range(40)]
    out = metrics.clip_hard_images(spark.createDataFrame(rows, "batch long, entropy double"))
    assert [r.entropy for r in out.filter("clipped = 0").collect()] == [1e9 + 1000.0]


def test_ties_and_repeats_have_one_result(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c")], "item_id long, query int, x string")
    assert {r.item_id: r.x for r in catalog.latest_by_id(rows.repartition(3)).collect()} == {1: "b", 2: "c"}
    new = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "file_name string, k int")
    records.append_stats(spark, new, str(tmp_path / "s"))
    records.append_stats(spark, new, str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == [("f", 2), ("g", 1)]


def test_a_chip_without_its_last_line_is_ragged(spark):
    whole = [(1, r, c, 1.0) for r in range(3) for c in range(3)]
    short = [(2, r, c, 1.0) for r in range(2) for c in range(3)]
    cells = spark.createDataFrame(whole + short, "scene_id long, r int, c int, v double")
    assert [x["scene_id"] for x in scoring.chip_tensors(cells, ["scene_id"], ["v"], (3, 3)).collect()] == [1]
    assert scoring.chip_tensors(cells, ["scene_id"], ["v"]).count() == 2
