"""Boxes, rings and segments as column expressions."""

from pyspark.sql import functions as F


def ring_bounds(ring):
    """Struct w,s,e,n of an array of points."""
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n")
    )


def box_ring(w, s, e, n):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def head_point(ring):
    return F.element_at(ring, 1)


def tail_point(ring):
    return F.element_at(ring, -1)


def boxes_intersect(a, b):
    """Closed boxes given as structs w,s,e,n share at least a point."""
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def grow(box, d):
    d = F.lit(float(d))
    return F.struct(
        (box["w"] - d).alias("w"), (box["s"] - d).alias("s"), (box["e"] + d).alias("e"), (box["n"] + d).alias("n")
    )


def ring_edges(ring):
    """Array of structs x0,y0,x1,y1, one per consecutive pair of points."""
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.element_at(ring, i)["x"].alias("x0"), F.element_at(ring, i)["y"].alias("y0"),
            F.element_at(ring, i + 1)["x"].alias("x1"), F.element_at(ring, i + 1)["y"].alias("y1"),
        ),
    )


def point_in_ring(x, y, ring):
    """Even-odd rule."""
    def flips(edge):
        spans = (edge["y0"] > y) != (edge["y1"] > y)
        at = edge["x0"] + (y - edge["y0"]) * F.try_divide(edge["x1"] - edge["x0"], edge["y1"] - edge["y0"])
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    count = F.aggregate(F.transform(ring_edges(ring), flips), F.lit(0), lambda a, b: a + b)
    return count % 2 == 1


def point_segment_distance(px, py, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    along = F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_box_distance(px, py, box):
    dx = F.greatest(box["w"] - px, px - box["e"], F.lit(0.0))
    dy = F.greatest(box["s"] - py, py - box["n"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def clip_range(x0, y0, x1, y1, box):
    """Liang-Barsky: struct t0,t1 of the part of the segment inside the box; t0 > t1 if none."""
    dx, dy = x1 - x0, y1 - y0

    def limits(d, low, high):
        # low <= d*t <= high
        a, b = F.try_divide(low, d), F.try_divide(high, d)
        outside = (low > 0) | (high < 0)
        enter = F.when(d == 0, F.when(outside, F.lit(2.0)).otherwise(F.lit(0.0))).otherwise(F.least(a, b))
        leave = F.when(d == 0, F.when(outside, F.lit(-1.0)).otherwise(F.lit(1.0))).otherwise(F.greatest(a, b))
        return enter, leave

    ex, lx = limits(dx, box["w"] - x0, box["e"] - x0)
    ey, ly = limits(dy, box["s"] - y0, box["n"] - y0)
    return F.struct(
        F.greatest(ex, ey, F.lit(0.0)).alias("t0"), F.least(lx, ly, F.lit(1.0)).alias("t1")
    )


def box_meets_ring(box, ring):
    """A box and a closed ring of any shape share at least a point: an edge enters the box, or the box lies inside."""
    def enters(edge):
        t = clip_range(edge["x0"], edge["y0"], edge["x1"], edge["y1"], box)
        return t["t0"] <= t["t1"]

    return F.exists(ring_edges(ring), enters) | point_in_ring(box["w"], box["s"], ring)


def clip_segment(x0, y0, x1, y1, box):
    """Struct x0,y0,x1,y1 of the part inside the box, NULL if there is none."""
    t = clip_range(x0, y0, x1, y1, box)
    dx, dy = x1 - x0, y1 - y0
    return F.when(
        t["t0"] <= t["t1"],
        F.struct(
            (x0 + t["t0"] * dx).alias("x0"), (y0 + t["t0"] * dy).alias("y0"),
            (x0 + t["t1"] * dx).alias("x1"), (y0 + t["t1"] * dy).alias("y1"),
        ),
    )


def segment_box_distance(x0, y0, x1, y1, box):
    """0 when they touch, else the least of corner-to-segment and endpoint-to-box distances."""
    t = clip_range(x0, y0, x1, y1, box)
    corners = [point_segment_distance(box[i], box[j], x0, y0, x1, y1) for i in "we" for j in "sn"]
    ends = [point_box_distance(x0, y0, box), point_box_distance(x1, y1, box)]
    return F.when(t["t0"] <= t["t1"], F.lit(0.0)).otherwise(F.least(*corners, *ends))


def segment_near_box(x0, y0, x1, y1, box, within=0.0):
    """The segment comes within ``within`` of the closed box: :func:`segment_box_distance` without divisions, for many pairs.

    They touch if their bounds do and the corners are not all on one side of the line. Else the nearest points are an end
    of the segment and the box, or the corner next to the line and a point between the ends.
    """
    dx, dy = x1 - x0, y1 - y0
    # how far a corner lies to the right of the line, times its length: right of its column less that of its row
    column, row = {i: dy * (box[i] - x0) for i in "we"}, {j: dx * (box[j] - y0) for j in "sn"}
    least = F.least(*column.values()) - F.greatest(*row.values())
    most = F.greatest(*column.values()) - F.least(*row.values())
    bounds = (F.least(x0, x1) <= box["e"]) & (F.greatest(x0, x1) >= box["w"]) & (F.least(y0, y1) <= box["n"]) & (F.greatest(y0, y1) >= box["s"])
    touch = bounds & (least <= 0) & (most >= 0)
    if not within:
        return touch
    d = F.lit(float(within))
    near = touch | (point_box_distance(x0, y0, box) <= d) | (point_box_distance(x1, y1, box) <= d)
    length = dx * dx + dy * dy
    right = least > 0
    along = (F.when((dy >= 0) == right, box["w"]).otherwise(box["e"]) - x0) * dx + (F.when((dx <= 0) == right, box["s"]).otherwise(box["n"]) - y0) * dy
    return near | ((F.greatest(least, -most) <= d * F.sqrt(length)) & (along > 0) & (along < length))
