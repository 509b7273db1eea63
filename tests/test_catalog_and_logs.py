"""Greedy cover, ladders, histories, splits, chip walk and skew helpers against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import catalog, chips, layers, logs, splits
from terracell.plans import skew


def slow_cover(items, masks, total, outside, min_share, max_items, max_remaining):
    """The walk item by item; ``items`` are (tier, score, id, granule)."""
    covered, found, chosen, seen = set(outside), len(outside) / total, [], set()
    for tier in sorted({i[0] for i in items}):
        for _, _, item, granule in sorted(i for i in items if i[0] == tier):
            if granule in seen:
                continue
            seen.add(granule)
            new = len(covered | masks[item]) / total
            if new - found >= min_share * (1 - found):
                covered, found = covered | masks[item], new
                chosen.append(item)
            if 1 - found < 1e-4 or len(chosen) >= max_items:
                break
        if 1 - found < max_remaining / 5 or len(chosen) >= max_items:
            break
    return chosen if 1 - found < max_remaining else []


@pytest.mark.parametrize("min_share,max_items,max_remaining", [(0.1, 4, 0.5), (0.3, 2, 0.9), (0.05, 10, 0.05), (0.5, 3, 0.2), (0.1, 4, 1e-4)])
def test_greedy_cover_against_loop(spark, min_share, max_items, max_remaining):
    rng = np.random.default_rng(max_items)
    width, total, rows, cells, outside_cells, want = 12, 144, [], [], [], {}
    for tile in range(5):
        items, masks = [], {}
        outside = set(range(0, 10 * tile))
        for i in range(9):
            item = tile * 100 + i
            start, size = rng.integers(0, 120), rng.integers(1, 60)
            masks[item] = {int(x) for x in range(start, min(start + size, total))}
            tier, score, granule = int(rng.integers(0, 3)), int(rng.integers(0, 5)), f"g{tile}-{i // 2}"
            items.append((tier, score, item, granule))
            rows.append((tile, item, granule, tier, score))
            cells += [(tile, item, p // width, p % width, 1) for p in masks[item]]
        outside_cells += [(tile, p // width, p % width, 1) for p in outside]
        chosen = slow_cover(items, masks, total, outside, min_share, max_items, max_remaining)
        if chosen:
            want[tile] = chosen
    candidates = spark.createDataFrame(rows, "tile long, item_id long, granule_id string, tier int, score int")
    packed = catalog.pack_masks(spark.createDataFrame(cells, "tile long, item_id long, r int, c int, clear int"), width)
    out_df = spark.createDataFrame(outside_cells, "tile long, r int, c int, clear int")
    outside = catalog.pack_masks(out_df, width, keys=("tile",))
    tiles = spark.range(5).select(F.col("id").alias("tile"), F.lit(total).alias("total"))
    got = {}
    for x in catalog.greedy_cover(candidates, packed, tiles, min_share, max_items, max_remaining, outside).orderBy("tile", "place").collect():
        got.setdefault(x["tile"], []).append(x["item_id"])
    assert got == want


def test_packed_masks_hold_all_64_bits(spark):
    df = spark.range(64).select(F.lit(1).alias("tile"), F.lit(2).alias("item_id"), (F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), F.lit(1).alias("clear"))
    row = catalog.pack_masks(df, 8).first()
    assert row["mask"] == -1 and row["word"] == 0


def test_tiers(spark):
    rows = [(0, 2024, 0), (1, 2024, 1), (2, 2024, 5), (3, 2024, 6), (4, 2024, 49), (5, 2024, 50), (6, 2023, 3), (7, 2022, 49), (8, 2021, 0), (9, 2025, 0)]
    df = spark.createDataFrame(rows, "item_id int, yr int, cloud int")
    got = {x["item_id"]: x["tier"] for x in catalog.tiered(df, 2024, 1, 50, 5, 2022).collect()}
    # limits 1, 6, 11, ..., 46, 50 in the first year
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 10, 6: 11, 7: 12}


@pytest.mark.parametrize("segment", [3, 7, 10**6])
@pytest.mark.parametrize("mode", ["max", "min"])
def test_history_summaries(spark, segment, mode):
    rng = np.random.default_rng(segment % 100)
    rows = []
    for model in range(3):
        steps = sorted(rng.choice(200, size=40 if model else 4, replace=False))
        rows += [(model, int(s), float(rng.integers(0, 12))) for s in steps]
    df = spark.createDataFrame(rows, "model int, step long, m double")
    best_of = max if mode == "max" else min
    summary = {(x["model"], x["step"]): x for x in logs.trailing_summary(df, ["model"], "step", "m", mode, segment).collect()}
    streaks = {(x["model"], x["step"]): x for x in logs.bad_streak(df, ["model"], "step", "m", 4, mode, segment).collect()}
    assert len(summary) == len(streaks) == len(rows)
    for model in range(3):
        past, best, bad = [], None, 0
        for _, step, value in [r for r in rows if r[0] == model]:
            past.append(value)
            x, s = summary[model, step], streaks[model, step]
            assert x["best"] == best_of(past) and x["p1"] == value
            assert x["p5"] == (pytest.approx(np.mean(past[-5:])) if len(past) >= 5 else None)
            assert x["p10"] == (pytest.approx(np.mean(past[-10:])) if len(past) >= 11 else None)
            if best is None or best_of(value, best) == value:
                best, bad = value, 0
            else:
                bad = bad + 1 if bad + 1 <= 4 else 0
            assert s["is_best"] == (value == best_of(past)) and s["bad_epochs"] == bad


@pytest.mark.parametrize("segment", [1, 4, 1000])
@pytest.mark.parametrize("mode", ["max", "min"])
def test_metric_history_against_loop(spark, segment, mode):
    rng = np.random.default_rng(segment)
    rows = [(model, 3 * k, None if (k + model) % 7 == 0 else float(rng.integers(0, 6))) for model in range(3) for k in range(40)]
    rows.append((9, 5, None))
    out = logs.metric_history(spark.createDataFrame(rows, "model int, step int, m double"), ["model"], "step", "m", mode, 2, segment)
    got = {(x["model"], x["step"]): x for x in out.collect()}
    assert len(got) == len(rows)
    better = (lambda a, b: a >= b) if mode == "max" else (lambda a, b: a <= b)
    mean = lambda values: np.mean(values) if values else None
    for model in {x[0] for x in rows}:
        seen, best, last = [], None, None
        for n, (_, step, m) in enumerate(sorted(x for x in rows if x[0] == model), 1):
            seen.append(m)
            is_best = None if m is None else best is None or better(m, best)
            if is_best:
                best, last = m, n
            x = got[model, step]
            streak = None if last is None else n - last
            assert (x["rn"], x["best"], x["streak"]) == (n, best, streak)
            assert x["is_best"] == is_best
            for k, since in ((5, 5), (10, 11)):
                want = mean([v for v in seen[-k:] if v is not None]) if n >= since else None
                assert x[f"p{k}"] == (want if want is None else pytest.approx(want))
            if streak is not None:
                assert (x["bad_epochs"], x["plateaus"]) == (streak % 3, streak // 3)


def test_interval_ladder_against_loop(spark):
    import datetime as dt

    day = dt.date
    plans = {1: (day(2024, 1, 1), day(2024, 6, 30)), 2: (day(2024, 2, 29), day(2024, 2, 29)), 3: (day(2023, 11, 20), day(2024, 1, 10)), 4: (day(2021, 5, 1), day(2021, 5, 2))}
    rng = np.random.default_rng(2)
    rows = [(i, i % 6, day(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 1800))), int(rng.integers(0, 60))) for i in range(900)]
    rows += [(1000, 2, day(2024, 2, 29), 0), (1001, 2, day(2023, 2, 28), 49), (1002, 2, day(2022, 2, 28), 50), (1003, 1, None, 0), (1004, 1, day(2024, 1, 1), None), (1005, 4, day(2021, 5, 1), 3)]

    def back(d, years):
        return d.replace(year=d.year - years, day=28 if (d.month, d.day) == (2, 29) else d.day)

    want = {}
    for item, tile, when, cloud in rows:
        if tile not in plans or when is None or cloud is None:
            continue
        start, end = plans[tile]
        steps = [(start, end, limit) for limit in (1, 6, 11, 16, 18)]
        steps += [(back(start, k), back(end, k), 18) for k in range(1, start.year - 2022 + 1)]
        tier = next((t for t, (a, b, limit) in enumerate(steps) if a <= when <= b and cloud < limit), None)
        if tier is not None:
            want[item] = tier
    searches = spark.createDataFrame([(t, *p) for t, p in plans.items()], "tile int, start date, end date")
    ladder = catalog.search_ladder(searches, cloud=1, max_cloud=18, step=5, min_year=2022)
    items = spark.createDataFrame(rows, "item_id int, tile int, dt date, cloud int")
    assert {x["item_id"]: x["tier"] for x in catalog.tiered_by_interval(items, ladder).collect()} == want
    assert len(set(want.values())) >= 6
    assert catalog.search_ladder(searches, cloud=5, max_cloud=5, step=5, min_year=2024).count() == 4


def test_granules_outside_the_polygon_are_spent_where_first_met(spark):
    candidates = spark.createDataFrame(
        [(1, 10, "a", 0, 1, False), (1, 11, "a", 0, 2, True), (1, 12, "b", 0, 3, True), (2, 20, "c", 0, 1, False)],
        "tile int, item_id int, granule_id string, tier int, score int, meets boolean",
    )
    masks = spark.createDataFrame([(t, i, 0, -1) for t, i in ((1, 10), (1, 11), (1, 12), (2, 20))], "tile int, item_id int, word long, mask long")
    tiles = spark.createDataFrame([(1, 64), (2, 64)], "tile int, total long")
    chosen = catalog.greedy_cover(candidates, masks, tiles, 0.1, 4, 0.5)
    assert [(x["tile"], x["item_id"]) for x in chosen.collect()] == [(1, 12)]


def test_clip_hard_images_segments(spark):
    from terracell.operators.metrics import clip_hard_images

    rng = np.random.default_rng(0)
    rows = [(b, float(rng.integers(0, 9) ** 2)) for b in range(45) for _ in range(6)]
    df = spark.createDataFrame(rows, "batch long, entropy double")
    got = sorted((x["batch"], x["entropy"], x["clipped"]) for x in clip_hard_images(df, segment=16).collect())
    want = []
    for b in range(45):
        kept = [v for k, v in rows if b - 19 <= k <= b]
        top = np.mean(kept) + 2.5 * np.std(kept)
        want += [(b, v, 0.0 if v > top else v) for k, v in rows if k == b]
    assert got == sorted(want)


def test_paging_covers_every_epoch_in_order(spark):
    out = splits.paged(spark.range(100).withColumnRenamed("id", "chip"), "chip", 3, 40).toPandas().sort_values("position")
    assert out.position.tolist() == list(range(300)) and (out.load == out.position // 40).all()
    assert all(sorted(g.chip) == list(range(100)) for _, g in out.groupby("epoch"))
    assert out[out.epoch == 0].chip.tolist() != out[out.epoch == 1].chip.tolist()


def test_samples_do_not_meet_test_chips(spark):
    test = spark.range(0, 50).withColumnRenamed("id", "chip")
    out = splits.sample_first(spark.range(200).withColumnRenamed("id", "chip"), "chip", 30, exclude=test).toPandas()
    assert len(out) == 30 and out.chip.min() >= 50 and out.h.is_monotonic_increasing


def slow_walk(missing, size, row_step, col_step, step, limit):
    h, w = missing.shape
    out, r, c, k = [], 0, 0, 1
    while r + size <= h and c + size <= w:
        if missing[r : r + size, c : c + size].mean() >= limit:
            r, c, k = r + step * k, c + step * k, k + 1
        else:
            out.append((r, c))
            c, k = c + col_step, 1
        if c + size > w:
            r, c = r + row_step, 0
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5])
def test_chip_walk_against_loop(spark, share):
    rng = np.random.default_rng(1)
    grids = {0: rng.random((30, 34)) < share, 1: rng.random((10, 10)) < share, 2: rng.random((4, 40)) < share}
    grids[0][5:14, 5:20] |= share > 0
    rows = [(s, r, c, "el", None if m else 1.0) for s, g in grids.items() for (r, c), m in np.ndenumerate(g)]
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, layer string, v double")
    shapes = spark.createDataFrame([(s, *g.shape) for s, g in grids.items()], "scene_id long, height int, width int")
    out = chips.walk_chips(df, shapes, 5, 5, 4, missing_step=2, limit=0.2).collect()
    for s, g in grids.items():
        assert sorted((x["chip_r0"], x["chip_c0"]) for x in out if x["scene_id"] == s) == slow_walk(g, 5, 5, 4, 2, 0.2)


@pytest.mark.parametrize("kind", ["null", "nan", "infinite", "absent", "absent lines"])
def test_chip_walk_around_cells_without_a_value(spark, kind):
    rng = np.random.default_rng(4)
    gone = rng.random((30, 34)) < 0.1
    gone[8:15] |= kind == "absent lines"
    gone[4:12, 6:20] = True
    value = {"null": None, "nan": float("nan"), "infinite": float("-inf")}.get(kind)
    rows = [(0, r, c, "el", value if m else 1.0) for (r, c), m in np.ndenumerate(gone) if not (m and kind.startswith("absent"))]
    rows += [(1, r, c, "el", None) for r in range(6) for c in range(6)] + [(1, r, c, "im", 1.0) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, "scene_id long, r int, c int, layer string, v double").repartition(5)
    shapes = spark.createDataFrame([(0, 30, 34), (1, 6, 6), (2, 6, 6)], "scene_id long, height int, width int")
    out = chips.walk_chips(df, shapes, 5, 5, 4, missing_step=2, limit=0.2).collect()
    assert sorted((x["chip_r0"], x["chip_c0"]) for x in out if x["scene_id"] == 0) == slow_walk(gone, 5, 5, 4, 2, 0.2)
    assert not [x for x in out if x["scene_id"] != 0]


def test_numbering_and_stats_with_one_hot_key(spark):
    rows = [(0, i * 3) for i in range(400)] + [(k, i) for k in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o long")
    out = skew.numbered(df, ["k"], "o", 50).toPandas().sort_values(["k", "o"])
    assert all(g.rn.tolist() == list(range(1, len(g) + 1)) for _, g in out.groupby("k"))
    stats = skew.attach_stats(df, ["k"], [F.max("o").alias("top")]).toPandas()
    assert len(stats) == 600 and (stats.top == stats.k.map({0: 1197, 1: 99, 2: 99})).all()


def test_drop_missing_also_drops_infinite_and_nan(spark):
    rows = [(0, 0, 0, 1.0), (1, 0, 0, float("nan")), (2, 0, 0, float("inf")), (3, 0, 0, None), (4, 0, 0, -2.0)]
    df = spark.createDataFrame(rows, "chip long, r int, c int, v double")
    assert sorted(x["chip"] for x in layers.drop_missing_chips(df, ["chip"], ["v"]).collect()) == [0, 4]
