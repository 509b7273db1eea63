"""Physical plans have the shape the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

import checks
from checks.base import BANDS, stack, table
from terracell.operators import catalog, composite, neighbourhood as N
from terracell.sources import layers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


def test_mask_growing_needs_one_exchange(spark):
    df = stack(spark, FOLDER)
    assert exchanges(N.grown_cloud_mask(df, ["scene_id", "item_id"], 1)) == 1
    assert exchanges(N.grown_cloud_mask(df, ["scene_id", "item_id"], 500)) == 1


def test_composite_has_three_exchanges(spark):
    df = composite.composite(stack(spark, FOLDER), BANDS, 1)
    assert exchanges(df) == 3
    assert plan(df).count("partial_sum") > 0


def test_slopes_need_one_exchange(spark):
    df = stack(spark, FOLDER).select("scene_id", "item_id", "r", "c", "v")
    assert exchanges(N.slopes(df, ["scene_id", "item_id"])) == 1


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_no_nested_loops_or_row_python(spark, name):
    if name.startswith(("x", "t2", "e4", "s", "z6_deployed", "e1_training_data")):
        pytest.skip("runs jobs while it is built")
    text = plan(checks.QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_search_reaches_the_scan(spark):
    items = table(spark, FOLDER, "supplier").select(
        F.col("s_suppkey").alias("item_id"), F.col("s_nationkey").alias("cloud"), F.col("s_acctbal").alias("dt"), F.col("s_name").alias("tile")
    )
    text = plan(catalog.search(items, 10, 0.0, 500.0, "Supplier#1").select("item_id"))
    assert "LessThan(s_nationkey,10)" in text and "EqualTo(s_name,Supplier#1)" in text and "GreaterThanOrEqual(s_acctbal,0.0)" in text


def test_only_needed_columns_are_read(spark):
    text = plan(checks.QUERIES["m1_confusion_counts"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_discount:double>", text)


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(checks.QUERIES["t4_top_per_tile"](spark, FOLDER))


def test_layer_is_a_partition_filter(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "scene_id long, r int, c int, v double")
    layers.write_layer(df, str(tmp_path / "l"), "image")
    assert "PartitionFilters: [isnotnull(layer" in plan(layers.read_layer(spark, str(tmp_path / "l"), "image"))


def test_log_views_share_one_pass(spark):
    history = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("user_id").alias("model"), F.col("event_id").alias("step"), F.col("value").alias("m"))
    from terracell.operators import logs

    df = logs.metric_history(history, ["model"], "step", "m", patience=3)
    assert exchanges(df) <= 4 and plan(df).count("FileScan") <= 2
    assert exchanges(logs.new_best(history, ["model"], "step", "m")) <= 4


def test_box_join_reads_each_side_once(spark):
    df = checks.QUERIES["j1_boxes_of_all_sizes"](spark, FOLDER)
    assert plan(df).count("FileScan") == 2 and exchanges(df) <= 2
