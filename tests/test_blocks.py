"""Operators on blocks with borders against the same operators on cells and plain loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import blocks as K, metrics, neighbourhood as N
from terracell.plans.evaluate import evaluate_scenes
from terracell.plans.lineage import scratch_path

KEYS = ["scene_id"]


def ragged(spark, seed, shape=(13, 17), holes=0.08):
    """Two rasters with missing values, NaN, infinity and, in the second, cells without a row and a line cut short."""
    rng = np.random.default_rng(seed)
    rows = []
    for scene in (1, 2):
        for r, c in np.ndindex(shape):
            if scene == 2 and (rng.random() < holes or (r == shape[0] - 1 and c > 4)):
                continue
            v = rng.choice([None, float("nan"), float("inf"), 1.0], p=[holes / 2, holes / 4, holes / 4, 1 - holes])
            rows.append((scene, r, c, v if v != 1.0 else float(rng.integers(0, 90)), int(rng.integers(0, 2)), int(rng.integers(0, 2))))
    return spark.createDataFrame(rows, "scene_id long, r int, c int, v double, p int, t int")


def cleaned(df):
    return df.withColumn("v", F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v")))


def rows(df, *names):
    shown = lambda x: x if not isinstance(x, float) else round(x, 9) + 0.0
    return sorted((tuple(shown(x[n]) for n in names) for x in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 4, 5, 32])
def test_cells_come_back(spark, block):
    df = ragged(spark, 1)
    back = K.to_cells(K.to_blocks(df, KEYS, ["v", "p"], block), KEYS, ["v", "p"], block)
    assert rows(back, "scene_id", "r", "c", "v", "p") == rows(cleaned(df).withColumn("p", F.col("p").cast("double")), "scene_id", "r", "c", "v", "p")


@pytest.mark.parametrize("block", [1, 4, 7, 32])
def test_slopes_equal_those_on_cells(spark, block):
    df = ragged(spark, 2)
    names = ("x_slope", "y_slope", "gradient")
    on_blocks = K.to_cells(K.slopes(K.to_blocks(df, KEYS, ["v"], block), KEYS, block=block), KEYS, names, block)
    assert rows(on_blocks, "scene_id", "r", "c", *names) == rows(N.slopes(cleaned(df), KEYS), "scene_id", "r", "c", *names)


@pytest.mark.parametrize("n,block", [(1, 4), (2, 3), (3, 3), (1, 32), (0, 4)])
def test_near_misses_equal_those_on_cells(spark, n, block):
    df = ragged(spark, 3).withColumn("p", F.when(F.col("r") % 5 != 0, F.col("p")))  # missing predictions too
    on_blocks = K.tolerant_confusion(K.to_blocks(df, KEYS, ["p", "t"], block), KEYS, n, block=block)
    names = ("scene_id", *K.NEAR_COUNTS)
    found = rows(on_blocks, *names)
    whole = rows(metrics.tolerant_confusion(df.filter("scene_id = 1"), KEYS, n), *names)
    assert found == whole + [(2, *slow_counts(df.filter("scene_id = 2"), n))]


def slow_counts(df, n):
    """Counts by plain loops; squares reach past cells that have no row."""
    at = {(x["r"], x["c"]): (x["p"], x["t"]) for x in df.collect()}
    out = [0] * 7
    for (r, c), (p, t) in at.items():
        if p is None or t is None:
            out[1] += p == 1
            out[2] += t == 1
            continue
        near = [at[i, j] for i in range(r - n, r + n + 1) for j in range(c - n, c + n + 1) if (i, j) in at]
        seen = lambda k, v: any(x[k] == v for x in near)
        flags = (p == t, p == 1, t == 1, p == t == 1, p != t, p > t and seen(1, 1) and seen(0, 0), p < t and seen(1, 0) and seen(0, 1))
        out = [a + b for a, b in zip(out, flags)]
    return tuple(out)


@pytest.mark.parametrize("n,largest", [(1, True), (4, False)])
def test_extremes_equal_those_on_cells(spark, n, largest):
    df = cleaned(ragged(spark, 4)).filter("scene_id = 1")
    on_blocks = K.to_cells(K.extreme(K.to_blocks(df, KEYS, ["v"], 4), KEYS, "v", n, "x", largest, block=4), KEYS, ["x"], 4)
    assert rows(on_blocks, "scene_id", "r", "c", "x") == rows(N.box_extreme(df, KEYS, "v", n, "x", largest), "scene_id", "r", "c", "x")


def test_scores_see_their_context(spark):
    a = np.random.default_rng(5).random((11, 14))
    df = spark.createDataFrame([(7, r, c, float(x)) for (r, c), x in np.ndenumerate(a)], "scene_id long, r int, c int, v double")

    def predict(stack):  # mean of the 5 x 5 square, outside left out
        padded = np.pad(stack[:, 0], ((0, 0), (2, 2), (2, 2)), constant_values=np.nan)
        h, w = stack.shape[2:]
        return np.nanmean([padded[:, i : i + h, j : j + w] for i in range(5) for j in range(5)], axis=0)

    out = K.to_cells(K.score(K.to_blocks(df, KEYS, ["v"], 4), KEYS, ["v"], predict, n=2, per_call=3, block=4), KEYS, ["score"], 4)
    found = {(x["r"], x["c"]): x["score"] for x in out.collect()}
    assert len(found) == a.size
    for r, c in np.ndindex(a.shape):
        assert np.isclose(found[r, c], a[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].mean())


def test_evaluation_equals_that_on_cells(spark):
    rng = np.random.default_rng(8)
    rows_ = [(s, r, c, float(rng.random()), int(rng.integers(0, 4))) for s in (1, 2, 3) for r, c in np.ndindex(9, 11)]
    df = spark.createDataFrame(rows_, "scene_id long, r int, c int, v double, cls int")
    broken = df.withColumn("v", F.when(~((F.col("scene_id") == 3) & (F.col("r") == 8)), F.col("v")))  # scene 3 lacks a line of values
    of = K.to_blocks(broken, KEYS, ["v", "cls"], 4)
    out = evaluate_scenes(of, KEYS, ["v"], lambda x: x[:, 0] * 0.5 + 0.25, context=1, classes=range(4), block=4)
    table = metrics.evaluation_table(df.filter("scene_id < 3").withColumn("prob", F.col("v") * 0.5 + 0.25), KEYS, classes=range(4))
    names = sorted(table.columns)
    assert sorted(out.columns) == names and rows(out, *names) == rows(table, *names)


def test_calls_are_filled_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(40).select(F.col("id").alias("scene_id"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("id").alias("v"))
    of = K.to_blocks(df, KEYS, ["v"], 2).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sizes = K.to_cells(K.score(of, KEYS, ["v"], lambda x: np.full((len(x), 1, 1), len(x)), per_call=16, block=2), KEYS, ["score"], 2)
        assert sorted(x["score"] for x in sizes.collect()) == [8.0] * 8 + [16.0] * 32
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_row_per_cell_is_exchanged(spark):
    """From written blocks on, an exchange carries arrays; from cells on, what is gathered in the task before it."""
    df = ragged(spark, 6)
    path = scratch_path(spark, "blocks")
    K.to_blocks(df, KEYS, ["v", "p", "t"], 4).write.parquet(path)
    stored = spark.read.parquet(path)
    for out, most in ((K.slopes(stored, KEYS, block=4), 1), (K.tolerant_confusion(stored, KEYS, block=4), 2)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", text)) == most
        assert "Generate" not in text and "Window" not in text
    text = K.to_blocks(df, KEYS, ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in text and text.count("Exchange hashpartitioning") == 1


def test_repeats_null_keys_and_nothing(spark):
    schema = "scene_id long, r int, c int, v double, note string"
    df = spark.createDataFrame([(None, 0, 0, 1.0, "a"), (None, 0, 0, 5.0, "a"), (None, 0, 1, None, "b")], schema)
    out = K.to_cells(K.slopes(K.to_blocks(df, KEYS, ["v"], 4), KEYS, block=4), KEYS, ["x_slope", "y_slope"], 4)
    assert rows(out, "scene_id", "r", "c", "x_slope", "y_slope") == [(None, 0, 0, None, 0.0), (None, 0, 1, None, None)]
    back = K.to_cells(K.to_blocks(df, KEYS, ["v"], 4), KEYS, ["v"], 4)
    assert rows(back, "r", "c", "v") == [(0, 0, 5.0), (0, 1, None)]
    empty = K.to_blocks(spark.createDataFrame([], schema), KEYS, ["v"])
    assert K.slopes(empty, KEYS).count() == 0 and K.score(empty, KEYS, ["v"], lambda x: x[:, 0]).count() == 0
    with pytest.raises(ValueError):
        K.with_border(empty, KEYS, ["v"], 5, 4)
