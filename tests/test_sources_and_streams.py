"""Sinks read back, streams equal batches, plans run end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators.metrics import confusion, confusion_columns
from terracell.operators.scoring import FeatureSpec, score_chips, scores_to_cells
from terracell.plans import lineage, training
from terracell.sources import layers, manifests, records, vectors
from terracell.streaming import incremental


def test_manifest_from_a_directory(spark, tmp_path):
    for name in ("bbox_1.5_2_3_4.tif", "bbox_-5_-6_-4_-5.tif", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    out = {r["file_name"]: (r["w"], r["s"], r["e"], r["n"]) for r in manifests.footprints(manifests.list_rasters(spark, str(tmp_path))).collect()}
    assert out == {"bbox_1.5_2_3_4.tif": (1.5, 2.0, 3.0, 4.0), "bbox_-5_-6_-4_-5.tif": (-5.0, -6.0, -4.0, -5.0)}


def test_manifest_refresh_drops_and_adds(spark):
    files = lambda *n: spark.createDataFrame([(f"bbox_{i}_0_{i}_1.tif",) for i in n], "file_name string")
    out = manifests.refreshed(manifests.footprints(files(1, 2)), files(2, 3))
    assert sorted(r["w"] for r in out.collect()) == [2.0, 3.0]


def test_links_skip_blank_lines(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text("https://a.example/x/one.zip\n\nhttps://a.example/two.zip\n")
    assert sorted(r["file_name"] for r in manifests.read_links(spark, str(path)).collect()) == ["one.zip", "two.zip"]


def test_basin_manifest(spark):
    ids = manifests.basin_ids(spark)
    out = manifests.basin_manifest(ids, "https://example.org/?f=%s", "basin_%s.gpkg")
    assert out.count() == 62 and out.select("basin_id").distinct().count() == 62


def test_region_lookup_reads_one_directory(spark, tmp_path):
    df = spark.createDataFrame([("0101", 1), ("0102", 2)], "region_key string, x int")
    vectors.write_features(df, str(tmp_path / "f"))
    table = spark.read.schema("x int, region_key string").parquet(str(tmp_path / "f"))
    picked = vectors.region(table, 102)
    assert [r["x"] for r in picked.collect()] == [2] and vectors.has_region(table, 101) and not vectors.has_region(table, 7)
    plan = picked._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(region_key" in plan


def test_convert_if_absent_keeps_the_first(spark, tmp_path):
    vectors.convert_if_absent(spark.range(3), str(tmp_path / "t"))
    vectors.convert_if_absent(spark.range(9), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_split_lists_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "val"), ("b", "test"), ("c", "val")], "file_name string, split string")
    records.write_split_lists(df, str(tmp_path / "s"))
    assert sorted(map(tuple, records.read_split_lists(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, df.collect()))


def test_statistics_extend_only_new_images(spark, tmp_path):
    stats = lambda ids: spark.createDataFrame([(i, len(ids)) for i in ids], "file_name string, n int")
    for ids in (["a", "b"], ["b", "c", "d"]):
        records.append_stats(spark, stats(ids), str(tmp_path / "e"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "e")).collect())) == [("a", 2), ("b", 2), ("c", 3), ("d", 3)]


def test_layers_are_pruned_by_layer(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, 0, float(i)) for i in range(5)], "scene_id long, r int, c int, v double")
    layers.write_layer(df, str(tmp_path / "l"), "image")
    layers.write_layer(df, str(tmp_path / "l"), "elevation")
    assert layers.read_layer(spark, str(tmp_path / "l"), "image").count() == 5


def files_of(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, "img long, p int, t int").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("img long, p int, t int").option("maxFilesPerTrigger", 1).parquet(path)


PARTS = [[(1, 1, 1), (2, 0, 1)], [(1, 0, 1), (3, 1, 0)], [(2, 1, 1), (3, 1, 1)]]


def test_running_totals_equal_the_batch(spark, tmp_path):
    source = files_of(spark, str(tmp_path / "in"), PARTS)
    out = incremental.running_totals(source, ["img"], confusion_columns(), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = confusion(spark.read.parquet(str(tmp_path / "in")), ["img"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select(out.columns).collect()))


def folders(path):
    return sorted(f.name for f in path.iterdir() if f.is_dir()) if path.exists() else []


def test_totals_are_compacted_and_survive_a_kill(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    batch_of = lambda: [(int(rng.integers(0, 6)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for _ in range(20)]
    source = files_of(spark, str(tmp_path / "in"), [batch_of() for _ in range(3)])
    sink = tmp_path / "out"
    run = lambda: incremental.running_totals(source, ["img"], confusion_columns(), str(sink), str(tmp_path / "ck"))

    def equal(out):
        want = confusion(spark.read.parquet(str(tmp_path / "in")), ["img"])
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(out.columns).collect()))

    equal(run())
    assert folders(sink / "updates") == [] and folders(sink / "snapshots") == ["upto=2"]
    # the stream goes on, but the run ends before its updates are merged, and leaves half a snapshot
    files_of(spark, str(tmp_path / "in"), [batch_of(), batch_of()])
    with monkeypatch.context() as m:
        m.setattr(incremental, "compact", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run()
    assert folders(sink / "updates") == ["batch=3", "batch=4"]
    (sink / "snapshots" / "upto=4").mkdir()
    (sink / "snapshots" / "upto=4" / "part-0.parquet").write_bytes(b"half")
    files_of(spark, str(tmp_path / "in"), [batch_of()])
    equal(run())
    # the one before stays for its readers; the half one never counted and goes
    assert folders(sink / "updates") == [] and folders(sink / "snapshots") == ["upto=2", "upto=5"]
    equal(run())
    files_of(spark, str(tmp_path / "in"), [batch_of()])
    equal(run())
    assert "upto=2" not in folders(sink / "snapshots")


def test_totals_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("img long, p int, t int").parquet(str(tmp_path / "in"))
    out = incremental.running_totals(source, ["img"], confusion_columns(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.count() == 0 and "num_correct" in out.columns


def test_a_small_window_needs_few_files_along_the_curve(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    rows = [(i, float(w), float(n), 0.5, 0.5, 2, 2) for i, (w, n) in enumerate(zip(rng.uniform(-180, 179, 900), rng.uniform(-89, 90, 900)))]
    scenes = spark.createDataFrame(rows, "scene_id long, w double, n double, x_res double, y_res double, height int, width int")
    cells = scenes.select("scene_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("r")).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.col("r"))
    layers.write_layer_by_place(cells, str(tmp_path / "l"), "image", scenes, files=32)
    window = (10.0, 20.0, 25.0, 30.0)
    files = list((tmp_path / "l").rglob("*.parquet"))

    def may_hold(path):
        meta = pq.ParquetFile(path).metadata
        bounds = {}
        for g in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                column = meta.row_group(g).column(k)
                bounds[column.path_in_schema] = column.statistics
        return bounds["bw"].min <= window[2] and bounds["be"].max >= window[0] and bounds["bs"].min <= window[3] and bounds["bn"].max >= window[1]

    assert len(files) >= 28 and sum(map(may_hold, files)) <= 4
    got = {(x["scene_id"], x["r"], x["c"]) for x in layers.read_layer(spark, str(tmp_path / "l"), "image", window).collect()}
    corner = lambda x, r, c: (x[1] + c * 0.5, x[2] - (r + 1) * 0.5)
    want = set()
    for x in rows:
        for r in (0, 1):
            for c in (0, 1):
                west, south = corner(x, r, c)
                if west <= window[2] and west + 0.5 >= window[0] and south <= window[3] and south + 0.5 >= window[1]:
                    want.add((x[0], r, c))
    assert got == want and want


def test_new_scenes_are_processed_once(spark, tmp_path):
    source = files_of(spark, str(tmp_path / "in"), PARTS)
    run = lambda: incremental.process_new(
        source, lambda df: df.groupBy("img").agg(F.sum("p").alias("total")), str(tmp_path / "out"), str(tmp_path / "ck"), "img", part=["img"]
    )
    assert sorted(r["img"] for r in run().collect()) == [1, 2, 3]
    spark.createDataFrame([(1, 9, 9), (8, 1, 1)], "img long, p int, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = run().collect()
    assert sorted(r["img"] for r in out) == [1, 2, 3, 8] and all(r["total"] < 9 for r in out)


def test_repeated_granules_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([("g1", "2024-01-01 00:00:00"), ("g2", "2024-01-01 00:10:00")], [("g1", "2024-01-01 00:20:00")]):
        spark.createDataFrame(rows, "g string, t string").select("g", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("g string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = incremental.append_available(incremental.first_acquisitions(source, "ts", "2 hours", "g"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["g"] for r in out.collect()) == ["g1", "g2"]


def test_feature_spec_round_trip():
    spec = FeatureSpec(weights={8: 7.0}, mode="deploy", derivatives=False)
    assert FeatureSpec.from_json(spec.to_json()) == spec
    assert spec.channels() == ("b08", "b04", "b03", "b02", "ndwi", "ndvi", "elevation")


def test_scores_of_a_coarser_model(spark):
    rows = [(i, 4, 4, [float(i)] * 16) for i in range(5)] + [(9, 2, 2, [1.0] * 4)]
    tensors = spark.createDataFrame(rows, "scene_id long, h int, w int, b08 array<double>")

    def halve(stack):
        return stack[:, 0, ::2, ::2]

    out = scores_to_cells(score_chips(tensors, ["scene_id"], ["b08"], halve, per_call=2), ["scene_id"]).collect()
    assert len(out) == 5 * 4 + 1 and all(x["score"] == (x["scene_id"] if x["scene_id"] < 9 else 1.0) for x in out)


def test_training_chips_route_and_reject(spark):
    rows = [(s, r, c, None if s == 1 and r < 2 else 1.0) for s in (0, 1) for r in range(4) for c in range(4)]
    image = spark.createDataFrame(rows, "scene_id long, r int, c int, b08 double")
    labels = image.select("scene_id", "r", "c", F.lit(3).alias("cls"))
    lists = spark.createDataFrame([(1, "test")], "scene_id long, split string")
    out = training.training_chips([image, labels], ["b08", "cls"], 2, lists=lists, shape=(4, 4))
    found = sorted((x["scene_id"], x["chip_r0"], x["chip_c0"], x["split"]) for x in out.select("scene_id", "chip_r0", "chip_c0", "split").distinct().collect())
    assert found == [(0, r, c, "train") for r in (0, 2) for c in (0, 2)] + [(1, 2, 0, "test"), (1, 2, 2, "test")]


def test_shared_dir_is_the_configured_one(spark):
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert lineage.scratch_path(spark, "a") != lineage.scratch_path(spark, "a")
