"""Neighbourhood, composite and metric operators against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import bands as B
from terracell.operators import composite, layers, metrics, neighbourhood as N
from terracell.model import blocks_to_cells, cells_to_blocks

CLEAR = set(B.CLEAR_CLASSES)


def frame(spark, array, name="v", scene=0):
    rows = [(scene, r, c, None if x is None or x != x else float(x)) for (r, c), x in np.ndenumerate(array)]
    return spark.createDataFrame(rows, f"scene_id long, r int, c int, {name} double")


def grid(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row["r"], row["c"]] = np.nan if row[name] is None else row[name]
    return out


def square(a, n, fn):
    h, w = a.shape
    return np.array([[fn(a[max(r - n, 0) : r + n + 1, max(c - n, 0) : c + n + 1]) for c in range(w)] for r in range(h)])


@pytest.mark.parametrize("n", [0, 1, 3, 17, 40])
def test_dilation_over_block_borders(spark, n):
    flags = (np.random.default_rng(n).random((37, 45)) < 0.01).astype(int)
    df = N.with_halo(frame(spark, flags, "flag"), ["scene_id"], n, block=16)
    df = N.without_halo(N.dilate_flag(df, ["scene_id"], "flag", n, "near"), n, block=16)
    assert df.count() == flags.size
    assert np.array_equal(grid(df, flags.shape, "near"), square(flags, n, np.max))


def test_dilation_grows_with_n(spark):
    flags = (np.random.default_rng(5).random((12, 12)) < 0.05).astype(int)
    sums = []
    for n in (0, 1, 2, 20):
        df = N.dilate_flag(N.with_halo(frame(spark, flags, "flag"), ["scene_id"], n), ["scene_id"], "flag", n, "near")
        sums.append(N.without_halo(df, n).agg(F.sum("near")).first()[0])
    assert sums == sorted(sums)


def slow_composite(values, scl, n):
    times, h, w = scl.shape
    mask = np.isin(scl, list(CLEAR)).astype(int)
    if times > 1:
        padded = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
        around = padded[:, :-2, 1:-1] + padded[:, 2:, 1:-1] + padded[:, 1:-1, :-2] + padded[:, 1:-1, 2:]
        edge = (mask == 0) & (around > 0)
        grown = np.stack([np.where(square(e.astype(int), n, np.max) > 0, 0, m) for e, m in zip(edge, mask)])
        any_grown, any_clear = grown.sum(0) > 0, mask.sum(0) > 0
        mask = np.where(any_grown, grown, np.where(any_clear, mask, 1))
    else:
        mask = np.ones_like(mask)
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            kept = [v for v in values[:, r, c] * mask[:, r, c] if v != 0]
            out[r, c] = int(sum(kept) / len(kept)) if kept else 0
    return out


@pytest.mark.parametrize("times,n,kind", [(3, 1, "mixed"), (4, 2, "mixed"), (2, 0, "mixed"), (1, 1, "mixed"), (3, 1, "clear"), (3, 1, "cloud"), (2, 20, "mixed")])
def test_composite_against_loop(spark, times, n, kind):
    rng = np.random.default_rng(times * 10 + n)
    scl = {"mixed": rng.integers(0, 12, (times, 9, 11)), "clear": np.full((times, 9, 11), 4), "cloud": np.full((times, 9, 11), 9)}[kind]
    values = rng.integers(0, 4, scl.shape) * 60
    rows = [(7, t, r, c, int(values[t, r, c]), int(scl[t, r, c])) for t, r, c in np.ndindex(scl.shape)]
    df = spark.createDataFrame(rows, "scene_id long, item_id int, r int, c int, b08 int, scl int")
    assert np.array_equal(grid(composite.composite(df, ["b08"], n), scl.shape[1:], "b08"), slow_composite(values, scl, n))


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (6, 1), (2, 2), (7, 9)])
def test_slopes(spark, shape):
    a = np.random.default_rng(1).integers(0, 100, shape).astype(float)
    df = N.slopes(frame(spark, a), ["scene_id"])
    x, y = np.zeros(shape), np.zeros(shape)
    if shape[1] > 1:
        x = np.gradient(a, axis=1)
    if shape[0] > 1:
        y = -np.gradient(a, axis=0)
    assert np.allclose(grid(df, shape, "x_slope"), x)
    assert np.allclose(grid(df, shape, "y_slope"), y)
    assert np.allclose(grid(df, shape, "gradient"), np.hypot(x, y))


def test_missing_neighbour_gives_missing_slope(spark):
    a = np.arange(9.0).reshape(3, 3)
    a[1, 1] = np.nan
    x = grid(N.slopes(frame(spark, a), ["scene_id"]), (3, 3), "x_slope")
    assert np.isnan(x[1]).all() and not np.isnan(x[0]).any()


def test_slopes_do_not_depend_on_blocks(spark, monkeypatch):
    a = np.random.default_rng(2).integers(0, 50, (20, 23)).astype(float)
    whole = grid(N.slopes(frame(spark, a), ["scene_id"]), a.shape, "gradient")
    monkeypatch.setattr(N, "block_side", lambda halo, block=8: 8)
    assert np.array_equal(grid(N.slopes(frame(spark, a), ["scene_id"]), a.shape, "gradient"), whole)


def test_max_pool_drops_odd_edges_and_commutes_with_flips(spark):
    a = np.random.default_rng(3).integers(0, 99, (7, 10)).astype(float)
    pooled = grid(N.max_pool(frame(spark, a), ["scene_id"], 1), (3, 5))
    assert np.array_equal(pooled, a[:6].reshape(3, 2, 5, 2).max(axis=(1, 3)))
    b = a[:6]
    flipped = grid(N.max_pool(frame(spark, b[:, ::-1]), ["scene_id"], 1), (3, 5))
    assert np.array_equal(flipped, pooled[:, ::-1])


def slow_near(model, target, value, n):
    hits = 0
    for r, c in zip(*np.where((model == value) & (model != target))):
        box = (slice(max(r - n, 0), r + n + 1), slice(max(c - n, 0), c + n + 1))
        hits += bool((target[box] == value).any() and (model[box] == 1 - value).any())
    return hits


@pytest.mark.parametrize("n", [1, 2])
def test_near_misses_against_loop(spark, n):
    rng = np.random.default_rng(n)
    p, t = (rng.random((13, 12)) < 0.4).astype(int), (rng.random((13, 12)) < 0.3).astype(int)
    df = frame(spark, p, "p").join(frame(spark, t, "t"), ["scene_id", "r", "c"])
    row = metrics.tolerant_confusion(df, ["scene_id"], n).first()
    assert (row["num_fp_f"], row["num_fn_f"]) == (slow_near(p, t, 1, n), slow_near(p, t, 0, n))
    assert row["num_one_correct"] == int((p * t).sum()) and row["num_wrong"] == int((p != t).sum())


def test_undefined_ratios_are_missing(spark):
    zero = np.zeros((3, 3))
    df = frame(spark, zero, "p").join(frame(spark, zero, "t"), ["scene_id", "r", "c"])
    out = metrics.tolerant_confusion(df, ["scene_id"]).withColumns({**metrics.plain_ratios(), **metrics.tolerant_ratios()}).first()
    assert out["a_n"] == 1 and out["p_n"] is None and out["r_n"] is None and out["f1_n"] is None and out["f1"] is None


def test_tolerant_equals_plain_without_near_misses(spark):
    p, t = np.array([[1, 1, 1]]), np.array([[1, 0, 1]])
    df = frame(spark, p, "p").join(frame(spark, t, "t"), ["scene_id", "r", "c"])
    out = metrics.tolerant_confusion(df, ["scene_id"]).withColumns({**metrics.plain_ratios(), **metrics.tolerant_ratios()}).first()
    assert out["num_fp_f"] == 0 and (out["p_n"], out["r_n"]) == (out["p_f"], out["r_f"])


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(4)
    p, t, w = rng.random((5, 6)), (rng.random((5, 6)) < 0.5).astype(float), rng.integers(1, 4, (5, 6)) / 2
    p[0, 0], t[0, 0] = 0.0, 1.0
    df = frame(spark, p, "prob").join(frame(spark, t, "t"), ["scene_id", "r", "c"]).join(frame(spark, w, "weight"), ["scene_id", "r", "c"])
    row = metrics.losses(df, ["scene_id"]).first()
    with np.errstate(divide="ignore"):
        logs = lambda x: np.maximum(np.log(x), -100)
        bce = (-w * (t * logs(p) + (1 - t) * logs(1 - p))).mean()
    w1 = np.minimum(w, 1)
    sim = lambda a, b: (a * b).sum() / (a * a + b * b - a * b).sum()
    tan = 1 - 0.5 * (sim(w1 * p, w1 * t) + sim(w1 - w1 * p, w1 - w1 * t))
    assert np.isclose(row["bce"], bce) and np.isclose(row["tanimoto"], tan) and np.isclose(row["total"], 0.7 * tan + 0.3 * bce)


def test_blocks_and_cells_are_inverse(spark):
    a = np.random.default_rng(6).integers(0, 9, (11, 7)).astype(float)
    a[3, 3] = np.nan
    blocks = cells_to_blocks(frame(spark, a), ["scene_id"], block=4)
    back = grid(blocks_to_cells(blocks, ["scene_id"], block=4), a.shape)
    assert np.array_equal(back, a, equal_nan=True)


def test_blocks_of_gaps_repeats_and_full_size(spark):
    rows = [(1, 2, 1, 3), (1, 2, 1, 5), (1, 2, 1, None), (1, 0, 2, 4), (2, 9, 9, 7), (None, 1, 0, 6)]
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, v int")
    found = {(x["scene_id"], x["br"], x["bc"]): (x["h"], x["w"], x["data"]) for x in cells_to_blocks(df, ["scene_id"], block=4).collect()}
    assert found[1, 0, 0] == (3, 3, [None, None, 4, None, None, None, None, 5, None])
    assert found[2, 2, 2] == (2, 2, [None, None, None, 7]) and found[None, 0, 0] == (2, 1, [None, 6]) and len(found) == 3
    whole = spark.range(256 * 256).select(F.lit(0).alias("scene_id"), F.expr("int(id div 256)").alias("r"), F.expr("int(id % 256)").alias("c"), F.col("id").alias("v"))
    row = cells_to_blocks(whole.filter("v % 97 <> 0"), ["scene_id"]).first()  # quadratic work would take half a minute
    assert [x for x in row["data"] if x is not None] == [v for v in range(256 * 256) if v % 97] and len(row["data"]) == 256 * 256


def test_blend_weight_peaks_at_one(spark):
    for h, w in ((1, 1), (2, 2), (3, 4), (5, 5), (1, 6)):
        df = frame(spark, np.zeros((h, w))).withColumn("k", B.blend_weight(F.col("r"), F.col("c"), F.lit(h), F.lit(w)))
        k = grid(df, (h, w), "k")
        assert np.isclose(k.max(), 1) and np.allclose(k, k[::-1, ::-1])


def test_imputation_limits(spark):
    rows = [(0, 0, 0, 0, 4.0), (0, 0, 1, 0, None), (0, 0, 0, 1, 6.0), (0, 0, 1, 1, 8.0)]  # a quarter missing
    rows += [(1, 0, 0, 0, None), (1, 0, 1, 0, None), (1, 0, 0, 1, 6.0), (1, 0, 1, 1, 8.0)]  # half missing: left alone
    rows += [(2, 0, c, 0, None) for c in range(1)] + [(2, 0, c, 1, 1.0) for c in range(2)]  # an empty channel
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, channel int, v double")
    out = {(x["scene_id"], x["c"], x["channel"]): x["v"] for x in layers.impute(df, ["scene_id"]).collect()}
    assert out[0, 1, 0] == 4.0 and out[1, 0, 0] is None and out[2, 0, 0] == 0.0 and len(out) == 11


def test_normalise_single_value_and_no_clear_cell(spark):
    rows = [(0, 0, 0, c, 80, 4) for c in range(3)] + [(1, 0, 0, c, 80, 9) for c in range(3)]
    df = spark.createDataFrame(rows, "scene_id long, item_id int, r int, c int, b08 int, scl int")
    out = {(x["scene_id"], x["c"]): x["b08"] for x in composite.normalise(df, ["scene_id", "item_id"], ["b08"]).collect()}
    assert {out[0, c] for c in range(3)} == {127} and {out[1, c] for c in range(3)} == {0}


def test_joins_by_patch_equal_joins_by_raster(spark, monkeypatch):
    from terracell.operators import regrid
    from terracell.plans import skew

    a = np.random.default_rng(8).integers(1, 90, (13, 17)).astype(float)
    a[2, 5] = np.nan
    cells = frame(spark, a).unionByName(frame(spark, a + 5, scene=1))
    meta = spark.createDataFrame(
        [(0, 0.0, 13.0, 1.0, 1.0, 13, 17), (1, 8.0, 13.0, 1.0, 1.0, 13, 17)],
        "scene_id long, w double, n double, x_res double, y_res double, height int, width int",
    )
    target = spark.createDataFrame([(5, 3.2, 11.0, 0.5, 0.5, 9, 30)], meta.schema)

    def results():
        return [
            sorted(map(tuple, layers.rebase(cells, ["scene_id"]).select("scene_id", "r", "c", "v").collect()), key=str),
            sorted(map(tuple, regrid.cut_to_targets(cells, meta, target, 8.0, "nearest").collect()), key=str),
            sorted((x["r"], x["c"], round(x["v"], 9)) for x in regrid.cut_to_targets(cells, meta, target, 8.0, "cubic").collect()),
            layers.drop_missing_chips(cells, ["scene_id"], ["v"]).count(),
            layers.drop_odd_sized_chips(cells, ["scene_id"], 13).count(),
        ]

    whole = results()
    monkeypatch.setattr(skew, "PATCH", 4)
    assert results() == whole
    assert len(whole[0]) == 2 * a.size and len(whole[1]) == 270 and whole[3:] == [0, 0]
