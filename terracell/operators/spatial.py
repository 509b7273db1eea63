"""Joins of boxes and segments."""

import math

from pyspark.sql import functions as F

from terracell.functions import geometry as G
from terracell.plans.skew import dealt_to_tasks, join_by_work

HOT_BUCKET = 2_000


def _to_buckets(df, box, cell):
    index = lambda v: F.floor(v / F.lit(cell)).cast("int")
    df = df.withColumn("_bx", F.explode(F.sequence(index(df[box]["w"]), index(df[box]["e"]))))
    return df.withColumn("_by", F.explode(F.sequence(index(F.col(box)["s"]), index(F.col(box)["n"]))))


def box_join(left, right, left_box, right_box, cell, left_id, right_id=None, hot=HOT_BUCKET):
    """Pairs of rows whose closed boxes intersect.

    Boxes are structs w,s,e,n in columns ``left_box`` and ``right_box``, and column names of the two
    sides must differ. Both sides are dealt to square buckets of side ``cell`` (choose about a typical
    box), so the overlap test becomes a filter on an equi join. A pair is reported only from the bucket
    that holds the lower left corner of its overlap, so no distinct is needed. A task tests about ``hot`` times
    ``hot`` pairs, and buckets with more are split over several tasks by the ids (by the box where none is given).
    """
    keys = ["_bx", "_by"]
    joined = join_by_work(_to_buckets(left, left_box, cell), _to_buckets(right, right_box, cell), keys, [left_id], [right_id or right_box], hot * hot)
    corner = lambda side: F.floor(F.greatest(F.col(left_box)[side], F.col(right_box)[side]) / F.lit(cell)).cast("int")
    joined = joined.filter(G.boxes_intersect(F.col(left_box), F.col(right_box)))
    return joined.filter((corner("w") == F.col("_bx")) & (corner("s") == F.col("_by"))).drop(*keys, "_pl", "_pr")


def _levels(box, finest, levels, spread):
    """Cells of a box at its own level and at every coarser one: ``_lv``, ``_bx``, ``_by``, ``_own``."""
    side = F.greatest(F.col(box)["e"] - F.col(box)["w"], F.col(box)["n"] - F.col(box)["s"])
    fit = F.ceil(F.log(F.greatest(side / F.lit(finest), F.lit(1.0))) / math.log(spread))
    own = F.least(fit, F.lit(levels - 1)).cast("int")
    width = lambda lv: F.lit(float(finest)) * F.pow(F.lit(float(spread)), lv)
    place = lambda edge, lv: F.floor(F.col(box)[edge] / width(lv)).cast("long")
    steps = lambda low, high, lv: F.sequence(place(low, lv), place(high, lv))
    whole = (F.col(box)["w"] <= F.col(box)["e"]) & (F.col(box)["s"] <= F.col(box)["n"])

    def place_all(df):
        df = df.filter(whole).withColumn("_fit", own).withColumn("_lv", F.explode(F.sequence("_fit", F.lit(levels - 1))))
        df = df.withColumn("_bx", F.explode(steps("w", "e", F.col("_lv")))).withColumn("_by", F.explode(steps("s", "n", F.col("_lv"))))
        return df.withColumn("_own", F.col("_lv") == F.col("_fit")).drop("_fit")

    return place_all, place


def boxes_meet(left, right, left_box, right_box, finest=2.0**-10, levels=10, spread=4):
    """Pairs of rows whose closed boxes intersect, for boxes of any mix of sizes.

    Boxes are structs w, s, e, n; column names of the two sides must differ. A box belongs to the level whose cells are
    just larger than itself (side ``finest`` times a power of ``spread``), where it lies in at most four cells, and is also
    listed in the cells of the coarser levels. Two boxes meet at the level of the larger one: the larger is there at its
    own level, the smaller on its own or as a guest, and guests never meet guests. So one equi join serves all sizes,
    each side is read once, and no box is cut into cells smaller than itself. ``finest`` and ``levels`` only set the
    range of sizes that is told apart; boxes beyond it are right but lie in more cells or share them with more others. A pair is
    reported from the cell with the lower left corner of its overlap. Tasks hold about equal numbers of pairs, and a crowded
    cell is split on both sides.
    """
    spread_left, place_left = _levels(left_box, finest, levels, spread)
    spread_right, place_right = _levels(right_box, finest, levels, spread)
    # boxes are few and small in their files but lie in many cells, so they are dealt to tasks first
    left, right = dealt_to_tasks(left, left_box), dealt_to_tasks(right, right_box)
    # side 0: the right box is at its own level; side 1: the left one is, and the right one is a guest
    a = spread_left(left).withColumn("_side", F.explode(F.when(F.col("_own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_own")
    b = spread_right(right).withColumn("_side", F.when(F.col("_own"), F.lit(0)).otherwise(F.lit(1))).drop("_own")
    met = join_by_work(a, b, ["_side", "_lv", "_bx", "_by"], [left_box], [right_box]).filter(G.boxes_intersect(F.col(left_box), F.col(right_box)))
    corner = lambda side: F.greatest(place_left(side, F.col("_lv")), place_right(side, F.col("_lv")))
    return met.filter((corner("w") == F.col("_bx")) & (corner("s") == F.col("_by"))).drop("_side", "_lv", "_bx", "_by", "_pl", "_pr")


def tiles_for_regions(tiles, regions, cell, expand=0.15, shrink=2e-7, region_id="region_id"):
    """Tiles (``tile``, ``box``) whose box meets a region's box grown by ``expand``; boxes come back shrunk."""
    r = regions.withColumn("region_box", G.grow(F.col("region_box"), expand))
    pairs = box_join(tiles, r, "box", "region_box", cell, "tile", region_id)
    return pairs.select(region_id, "tile", G.grow(F.col("box"), -shrink).alias("box"))


def segments_in_boxes(segments, boxes, cell, segment_id="fid"):
    """Segments x0,y0,x1,y1 joined to the boxes they meet and clipped to them."""
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    s = segments.withColumn(
        "segment_box",
        F.struct(
            low("x0", "x1").alias("w"), low("y0", "y1").alias("s"), high("x0", "x1").alias("e"), high("y0", "y1").alias("n")
        ),
    )
    pairs = box_join(s, boxes, "segment_box", "box", cell, segment_id)
    x0, y0, x1, y1 = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    t0, t1, dx, dy = F.col("_t.t0"), F.col("_t.t1"), x1 - x0, y1 - y0
    part = F.struct(
        (x0 + t0 * dx).alias("cx0"), (y0 + t0 * dy).alias("cy0"), (x0 + t1 * dx).alias("cx1"), (y0 + t1 * dy).alias("cy1")
    )
    pairs = pairs.withColumn("_t", G.clip_range(x0, y0, x1, y1, F.col("box")))
    # inline drops pairs without a common part, and unlike a filter is not moved below the clipping
    pairs = pairs.select("*", F.inline(F.when(t0 <= t1, F.array(part))))
    clipped = {k: F.col(f"c{k}") for k in ("x0", "y0", "x1", "y1")}
    return pairs.withColumns(clipped).drop("_t", "segment_box", *[f"c{k}" for k in clipped])


def cells_in_ring(cells, ring, x="x", y="y"):
    """Keep cells whose centre is in the ring (even-odd)."""
    return cells.filter(G.point_in_ring(F.col(x), F.col(y), F.col(ring)))
