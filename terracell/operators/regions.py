"""Regions of any shape as a table of edges: several parts, holes and notches, tested exactly.

An edge row is ``region_id``, ``part``, ``ring`` and ``x0, y0, x1, y1``. Inside is even-odd over all rings of a region. No
ring is held in one row of an exchange, and the work is linear in edges and candidates.
"""

import math

from pyspark.sql import functions as F

from terracell.functions import geometry as G
from terracell.plans.skew import join_by_work


def region_edges(regions, ring="ring", keys=("region_id", "part", "ring_id")):
    """Edges of rings given as arrays of points x, y; the last point is joined to the first."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)
    edge = lambda i: F.struct(at(i)["x"].alias("x0"), at(i)["y"].alias("y0"), at(i + 1)["x"].alias("x1"), at(i + 1)["y"].alias("y1"))
    out = regions.filter(n > 0).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n - 1), edge)).alias("_e"))
    return out.select(*keys, "_e.*")


def _box(edges, by=0.0):
    low, high = (lambda a, b: F.least(F.col(a), F.col(b)) - by), (lambda a, b: F.greatest(F.col(a), F.col(b)) + by)
    return F.struct(low("x0", "x1").alias("w"), low("y0", "y1").alias("s"), high("x0", "x1").alias("e"), high("y0", "y1").alias("n"))


def _bounds(edges, region_id):
    b = _box(edges)
    return edges.groupBy(region_id).agg(
        F.struct(F.min(b["w"]).alias("w"), F.min(b["s"]).alias("s"), F.max(b["e"]).alias("e"), F.max(b["n"]).alias("n")).alias("region_box")
    )


def _crossed(x, y):
    """Whether a ray to the right from the point crosses the edge."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))


def _edges_from_west(edges, region_id):
    """Edges with ``_west``, the west of their region's bounds: a ray to the right may start from there."""
    bounds = _bounds(edges, region_id).select(region_id, F.col("region_box.w").alias("_west"))
    held = edges.select(region_id, "x0", "y0", "x1", "y1").hint("merge").join(bounds, region_id, "left")
    return held.withColumn("_west", F.least("_west", "x0", "x1"))


def _by_pair(found, spots, home, id_column, region_id, keys):
    """Aggregation over the edges that a row of ``spots`` meets of a region.

    A join on ``keys`` and the parts of the left side has all edges for a row in one task, so pairs are not exchanged. Only if
    an id stands for rows with different homes, they are gathered from all places.
    """
    places = spots.groupBy(id_column).agg((F.min(home) < F.max(home)).alias("_apart")).agg(F.bool_or("_apart")).first()[0]
    return found.groupBy(region_id, id_column, *([] if places else [*keys, "_pl", "_pr"]))


def points_in_regions(points, edges, cell, point_id, region_id="region_id", x="x", y="y"):
    """Pairs (region, point id) of points inside a region; ``points`` has ``point_id``, x and y.

    A point is in one square of side ``cell``. An edge goes to the squares of its rows from the west of its region to its own
    east end, where it may cross a ray to the right; an odd number of crossings means inside. So a point meets all edges
    it needs in its square, and no pair is exchanged.
    """
    place = lambda v: F.floor(v / F.lit(cell)).cast("long")
    spots = points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumns({"_bx": place(F.col("_x")), "_by": place(F.col("_y"))})
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dealt = _edges_from_west(edges.filter(F.col(region_id).isNotNull()), region_id).filter(y0 != y1)
    dealt = dealt.withColumn("_by", F.explode(F.sequence(place(F.least(y0, y1)), place(F.greatest(y0, y1)))))
    dealt = dealt.withColumn("_bx", F.explode(F.sequence(place(F.col("_west")), place(F.greatest(x0, x1)))))
    met = join_by_work(spots, dealt, ["_bx", "_by"], [point_id]).filter((F.col("_x") >= F.col("_west")) & _crossed(F.col("_x"), F.col("_y")))
    counted = _by_pair(met, spots, F.struct("_x", "_y"), point_id, region_id, ["_bx", "_by"]).agg((F.count(F.lit(1)) % 2 == 1).alias("_in"))
    return counted.filter("_in").select(region_id, point_id)


def regions_meet_boxes(boxes, edges, cell, box_id, region_id="region_id", box="box", within=0.0):
    """Pairs (region, box id) where the closed box comes within ``within`` of the region.

    Either an edge of the region comes that near to the box, or the box lies inside and so does its lower left corner. A box
    is at home in one square, that of its corner, of side ``cell`` times the power of 4 that is just larger than itself. An
    edge goes to all squares whose boxes may reach it, and to those where it may cross a ray from a corner. So a box
    meets all edges it needs at home, and no pair is exchanged.
    """
    side = F.greatest(F.col("_box")["e"] - F.col("_box")["w"], F.col("_box")["n"] - F.col("_box")["s"])
    level = F.greatest(F.ceil(F.log(F.greatest(side, F.lit(float(cell))) * (1 + 1e-9) / F.lit(float(cell))) / math.log(4) - 1e-9), F.lit(0))
    place = lambda v: F.floor(v / F.col("_side")).cast("long")
    spots = boxes.select(box_id, F.col(box).alias("_box")).withColumn("_level", level.cast("int"))
    spots = spots.withColumn("_side", F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("_level")))
    spots = spots.withColumns({"_bx": place(F.col("_box")["w"]), "_by": place(F.col("_box")["s"])}).filter("_bx is not null and _by is not null and _level is not null").drop("_side")
    sizes = spots.groupBy("_level").agg(F.max(F.col("_box")["e"] - F.col("_box")["w"]).alias("w"), F.max(F.col("_box")["n"] - F.col("_box")["s"]).alias("h")).collect()
    one = lambda z: F.struct(*[F.lit(v).alias(k) for k, v in (("_level", z[0]), ("_side", float(cell) * 4.0 ** z[0]), ("_w", z[1]), ("_h", z[2]))])
    levels = F.array(*[one(z) for z in sizes or [(0, 0.0, 0.0)]])

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    d = F.lit(float(within))
    dealt = _edges_from_west(edges, region_id).select("*", F.inline(levels))
    dealt = dealt.withColumn("_by", F.explode(F.sequence(place(F.least(y0, y1) - d - F.col("_h")), place(F.greatest(y0, y1) + d))))
    # a flat edge crosses no ray
    first = F.least(x0, x1) - d - F.col("_w")
    first = F.when(y0 == y1, first).otherwise(F.least(first, F.col("_west")))
    dealt = dealt.withColumn("_bx", F.explode(F.sequence(place(first), place(F.greatest(x0, x1) + d)))).drop("_w", "_h", "_side")
    keys = ["_level", "_bx", "_by"]
    b = F.col("_box")
    beside = (F.least(x0, x1) - d <= b["e"]) & (F.greatest(x0, x1) + d >= b["w"]) & (F.least(y0, y1) - d <= b["n"]) & (F.greatest(y0, y1) + d >= b["s"])
    crossed = F.col(region_id).isNotNull() & (b["w"] >= F.col("_west")) & F.coalesce(_crossed(b["w"], b["s"]), F.lit(False))
    # most pairs end at this cheap test, inside the join
    met = join_by_work(spots, dealt, keys, [box_id]).filter(beside | crossed)
    met = met.select(box_id, region_id, *keys, "_pl", "_pr", G.segment_near_box(x0, y0, x1, y1, b, within).alias("_near"), crossed.alias("_crossed"))
    found = _by_pair(met, spots, F.struct("_box.w", "_box.s", "_box.e", "_box.n"), box_id, region_id, keys)
    found = found.agg(F.bool_or("_near").alias("_near"), F.count_if("_crossed").alias("_n"))
    return found.filter(F.col("_near") | (F.col("_n") % 2 == 1)).select(region_id, box_id)


def regions_to_footprints(regions, footprints, cell, ring="ring", region_id="region_id", file="file_name"):
    """Pairs of a region, given as one ring of any shape, and the footprints (box column ``box``) it meets."""
    return regions_meet_boxes(footprints, region_edges(regions, ring, (region_id,)), cell, file, region_id)
