"""Burning vector features into label rasters."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from terracell.functions.classes import JUNCTION_CLASS
from terracell.functions.geometry import point_segment_distance
from terracell.functions.ranges import explode_range
from terracell.operators.spatial import box_join
from terracell.plans.skew import join_by_work, salted_join

RADIUS = 5e-5


EPSILON = 1e-9


def _side(sign, y, d):
    """Left (-1) or right (+1) border at height ``y`` of the points within ``d`` of the segment.

    The border is the segment moved sideways by ``d``, closed by a circle around either end.
    """
    x0, y0, x1, y1 = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    dx, dy = x1 - x0, y1 - y0
    length = F.sqrt(dx * dx + dy * dy)
    arc = lambda x, centre: x + sign * F.sqrt(F.greatest(d * d - (y - centre) * (y - centre), F.lit(0.0)))
    t = F.try_divide(y - y0 + sign * d * F.try_divide(dx * F.signum(dy), length), dy)
    flat = arc(F.least(x0, x1) if sign < 0 else F.greatest(x0, x1), y0)
    return (
        F.when(dy == 0, flat).when(t < 0, arc(x0, y0)).when(t > 1, arc(x1, y1))
        .otherwise(x0 + t * dx + sign * d * F.abs(dy) / length)
    )


def touched_cells(segments, d, keys=("scene_id",), keep=("cls",)):
    """Cells whose box comes within ``d`` of a segment.

    Segments carry x0,y0,x1,y1 and their raster's w, n, x_res, y_res, height, width. The points within
    ``d`` of a segment form a convex shape, so what it shares with one raster row is one run of columns
    whose ends have a closed form: the cost is the number of burned cells, with no candidates to test.
    """
    d = F.lit(float(d))
    x0, y0, x1, y1, w, n, x_res, y_res = (F.col(k) for k in ("x0", "y0", "x1", "y1", "w", "n", "x_res", "y_res"))
    top, bottom = F.greatest(y0, y1) + d, F.least(y0, y1) - d
    rows = explode_range(
        segments, "r", F.ceil((n - top) / y_res - 1 - EPSILON), F.floor((n - bottom) / y_res + EPSILON), F.col("height")
    )
    low = F.greatest(n - (F.col("r") + 1) * y_res, bottom)
    high = F.least(n - F.col("r") * y_res, top)
    # each border bulges most at the end point on its side, so its extreme in the row is nearest to that height
    rows = rows.withColumns(
        {
            "_yl": F.least(F.greatest(F.when(x0 <= x1, y0).otherwise(y1), low), high),
            "_yr": F.least(F.greatest(F.when(x0 >= x1, y0).otherwise(y1), low), high),
        }
    )
    rows = rows.withColumns({"_xl": _side(-1, F.col("_yl"), d), "_xr": _side(1, F.col("_yr"), d)})
    cells = explode_range(
        rows, "c", F.ceil((F.col("_xl") - w) / x_res - 1 - EPSILON), F.floor((F.col("_xr") - w) / x_res + EPSILON), F.col("width")
    )
    return cells.select(*keys, *keep, "r", "c")


def filled_cells(edges, keys=("scene_id",), feature="fid", keep=("cls",)):
    """Cells whose centre lies inside a polygon given by its edges (even-odd, holes included).

    Scan lines: every edge meets the row centres it spans in one x each; the sorted crossings of a row
    pair up into runs of inside cells. No polygon is held in memory.
    """
    x0, y0, x1, y1, w, n, x_res, y_res = (F.col(k) for k in ("x0", "y0", "x1", "y1", "w", "n", "x_res", "y_res"))
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    rows = explode_range(
        edges, "r", F.floor((n - high) / y_res - 0.5), F.ceil((n - low) / y_res - 0.5), F.col("height")
    )
    y = n - (F.col("r") + 0.5) * y_res
    rows = rows.filter((y0 > y) != (y1 > y)).withColumn("_x", x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    line = Window.partitionBy(*keys, feature, "r").orderBy("_x")
    rows = rows.withColumns({"_i": F.row_number().over(line), "_to": F.lead("_x").over(line)}).filter(F.col("_i") % 2 == 1)
    # a centre on the right crossing is outside
    cells = explode_range(
        rows, "c", F.ceil((F.col("_x") - w) / x_res - 0.5), F.ceil((F.col("_to") - w) / x_res - 0.5) - 1, F.col("width")
    )
    return cells.select(*keys, *keep, "r", "c")


def edges_in_grids(edges, grids, cell, grid="scene_id", feature="fid", by=0.0):
    """Polygon edges next to every grid that their polygon's bounds (grown by ``by``) meet and whose rows they span.

    Nothing is clipped: an edge beside a grid still decides what is inside, and a grid may lie wholly inside. Edges and
    grids meet by polygon and by strip of height ``cell``, from the first strip they share only.
    """
    low, high = F.least("y0", "y1") - by, F.greatest("y0", "y1") + by
    bounds = edges.groupBy(feature).agg(
        F.struct(F.min(F.least("x0", "x1") - by).alias("w"), F.min(low).alias("s"), F.max(F.greatest("x0", "x1") + by).alias("e"), F.max(high).alias("n")).alias("feature_box")
    )
    south = F.col("n") - F.col("height") * F.col("y_res")
    box = F.struct(F.col("w"), south.alias("s"), (F.col("w") + F.col("width") * F.col("x_res")).alias("e"), F.col("n"))
    pairs = box_join(grids.withColumn("grid_box", box), bounds, "grid_box", "feature_box", cell, grid, feature).drop("feature_box")
    strip = lambda v: F.floor(v / F.lit(cell)).cast("long")
    pairs = pairs.withColumn("_strip", F.explode(F.sequence(strip(F.col("grid_box.s")), strip(F.col("grid_box.n")))))
    dealt = edges.withColumns({"_low": low, "_high": high})
    dealt = dealt.withColumn("_strip", F.explode(F.sequence(strip(F.col("_low")), strip(F.col("_high")))))
    # not broadcast: by the size of the files the edges would seem small enough, before they are dealt to strips
    met = dealt.hint("merge").join(pairs, [feature, "_strip"]).filter((F.col("_low") <= F.col("grid_box.n")) & (F.col("_high") >= F.col("grid_box.s")))
    first = F.greatest(strip(F.col("_low")), strip(F.col("grid_box.s")))
    return met.filter(F.col("_strip") == first).drop("_strip", "_low", "_high", "grid_box")


def burn_features(lines, polygons, grids, cell, d=RADIUS, grid="scene_id", feature="fid"):
    """Label raster of each grid from lines and polygon edges together, all grown by ``d``; the highest class wins.

    ``lines`` and ``polygons`` are segments (feature, x0, y0, x1, y1, cls); polygons are also filled, even-odd.
    """
    edges = edges_in_grids(polygons, grids, cell, grid, feature, d)
    near = edges_in_grids(lines, grids, cell, grid, feature, d)
    touched = touched_cells(near, d, (grid,)).union(touched_cells(edges, d, (grid,)))
    return burn(touched.union(filled_cells(edges, (grid,), feature)), (grid,))


def burn(touched, keys=("scene_id",), cls="cls"):
    """Label of each touched cell: the highest class."""
    return touched.groupBy(*keys, "r", "c").agg(F.max(cls).alias("label"))


def junctions(vertices, keys=("scene_id",), feature="fid", least=3):
    """End points shared by at least ``least`` lines.

    ``vertices`` has one row per line vertex (x, y) with ``is_end``. An end point counts its own line.
    """
    grouped = vertices.groupBy(*keys, "x", "y").agg(
        F.count_distinct(feature).alias("lines"), F.bool_or("is_end").alias("_end")
    )
    return grouped.filter(F.col("_end") & (F.col("lines") >= least)).drop("_end")


def end_points(segments, keys=("scene_id",), feature="fid"):
    """Head and tail of each line as vertices."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(True).alias("is_end"))
    return segments.select(*keys, feature, F.inline(F.array(point("x0", "y0"), point("x1", "y1"))))


def line_ends(segments, line):
    """Head and tail of each line.

    With a column ``seq`` they come from its first and last segment. Without, they are the points that an odd number
    of its segments begin or end at, so a closed line has none, and both points of a segment without length.
    """
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    if "seq" in segments.columns:
        ends = segments.groupBy(*line).agg(F.min_by(point("x0", "y0"), "seq").alias("_head"), F.max_by(point("x1", "y1"), "seq").alias("_tail"))
        return ends.select(*line, F.inline(F.array("_head", "_tail"))).distinct()
    flat = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    ends = segments.select(*line, flat.alias("_flat"), F.inline(F.array(point("x0", "y0"), point("x1", "y1"))))
    kept = ends.groupBy(*line, "x", "y").agg(((F.count(F.lit(1)) % 2 == 1) | F.bool_or("_flat")).alias("_end"))
    return kept.filter("_end").drop("_end")


def line_junctions(segments, bucket, keys=("scene_id",), line=None, least=3, tolerance=1e-9):
    """Ends of lines that lie on at least ``least`` lines, their own included.

    A line is the segments of one part of one feature; an end may lie on the inside of another line, and a vertex
    inside its own line is no end. Ends meet the segments of their square buckets of side ``bucket``.
    """
    line = list(line or ([*keys, "fid", "part"] if "part" in segments.columns else [*keys, "fid"]))
    place = lambda v: F.floor(v / F.lit(bucket)).cast("long")
    points = line_ends(segments, line).select(*keys, "x", "y").distinct().withColumns({"_bx": place(F.col("x")), "_by": place(F.col("y"))})
    span = lambda a, b: F.explode(F.sequence(place(F.least(a, b) - tolerance), place(F.greatest(a, b) + tolerance)))
    dealt = segments.select(*line, "x0", "y0", "x1", "y1").withColumn("_bx", span(F.col("x0"), F.col("x1"))).withColumn("_by", span(F.col("y0"), F.col("y1")))
    far = point_segment_distance(F.col("x"), F.col("y"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    own = [c for c in line if c not in keys]
    met = join_by_work(points, dealt, [*keys, "_bx", "_by"], ["x", "y"], [*own, "x0", "y0", "x1", "y1"])
    met = met.filter(far <= tolerance)
    return met.groupBy(*keys, "x", "y").agg(F.count_distinct(*own).alias("lines")).filter(F.col("lines") >= least)


def mark_junctions(labels, near, keys=("scene_id",), junction_class=JUNCTION_CLASS):
    """Labelled cells near a junction become the junction class."""
    cell = [*keys, "r", "c"]
    flags = near.select(*cell).distinct().withColumn("_near", F.lit(True))
    out = labels.join(flags, cell, "left")
    marked = F.when((F.col("label") > 0) & F.col("_near"), F.lit(junction_class)).otherwise(F.col("label"))
    return out.withColumn("label", marked).drop("_near")


def burn_lines(segments, scenes, d=RADIUS, keys=("scene_id",), bucket=None):
    """Label raster of classified segments: touch, highest class, junctions on top.

    Segments belong to the line ``fid`` (and ``part``, if there is such a column); ``bucket`` is for
    :func:`line_junctions`, by default a thousand times ``d``.
    """
    placed = salted_join(segments, scenes, keys)
    labels = burn(touched_cells(placed, d, keys), keys)
    points = salted_join(line_junctions(segments, bucket or 1000 * d, keys), scenes, keys)
    points = points.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    return mark_junctions(labels, touched_cells(points, 4 * d, keys, keep=()), keys)
