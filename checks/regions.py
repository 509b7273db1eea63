"""Regions with notches, holes and second parts, against the same shapes as unions of rectangles in SQL."""

from pyspark.sql import functions as F

from checks.base import classed, prints, query, zones
from terracell.operators import burn, regions as R

# per region: an L of two rectangles (even ids) or a square with a square hole (odd ids), and a second part to the right
RECTS = """rects AS (SELECT region_id, w, s, w+6 AS e, s+2 AS n FROM zones WHERE region_id%2=0 UNION ALL SELECT region_id, w, s, w+2, s+6 FROM zones WHERE region_id%2=0
    UNION ALL SELECT region_id, w, s, w+6, s+2 FROM zones WHERE region_id%2=1 UNION ALL SELECT region_id, w, s+4, w+6, s+6 FROM zones WHERE region_id%2=1
    UNION ALL SELECT region_id, w, s, w+2, s+6 FROM zones WHERE region_id%2=1 UNION ALL SELECT region_id, w+4, s, w+6, s+6 FROM zones WHERE region_id%2=1
    UNION ALL SELECT region_id, w+8, s, w+9, s+1 FROM zones)"""
SMALL = "small AS (SELECT fid, w+0.25e0 AS w, s+0.25e0 AS s, w+0.75e0 AS e, s+0.75e0 AS n FROM prints)"


def shapes(spark, folder):
    """Edges of the regions; the SQL twin says the same with rectangles."""
    z = zones(spark, folder)
    at = lambda dx, dy: F.struct((F.col("w") + dx).alias("x"), (F.col("s") + dy).alias("y"))
    ring = lambda *points: F.array(*[at(float(x), float(y)) for x, y in points])
    one = lambda part, ring_id, points: F.struct(F.lit(part).alias("part"), F.lit(ring_id).alias("ring_id"), points.alias("ring"))
    second = one(1, 0, ring((8, 0), (9, 0), (9, 1), (8, 1)))
    notched = F.array(one(0, 0, ring((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6))), second)
    holed = F.array(one(0, 0, ring((0, 0), (6, 0), (6, 6), (0, 6))), one(0, 1, ring((2, 2), (4, 2), (4, 4), (2, 4))), second)
    return R.region_edges(z.select("region_id", F.inline(F.when(F.col("region_id") % 2 == 0, notched).otherwise(holed))))


# grids of 8 x 8 cells over the canvas, and boxes of 20 x 18 units, so that some grids lie wholly inside one
TILED = """cells8 AS (SELECT g AS scene_id, r, c, (g%8)*8+c AS x, 64-(g//8)*8-r AS y FROM (SELECT unnest(range(64)) AS g), (SELECT cast(unnest(range(8)) AS int) AS r), (SELECT cast(unnest(range(8)) AS int) AS c)),
    blocks AS (SELECT fid, x0, y0, x0+20 AS x1, y0+18 AS y1, cast(fid%11 AS int)+1 AS cls FROM classed)"""


def tiled(spark, folder):
    """The grids, and the edges of the boxes."""
    grids = spark.range(64).select(
        F.col("id").alias("scene_id"), ((F.col("id") % 8) * 8.0).alias("w"), (64.0 - F.floor(F.col("id") / 8) * 8.0).alias("n"),
        F.lit(1.0).alias("x_res"), F.lit(1.0).alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width"),
    )
    at = lambda dx, dy: ((F.col("x0") + dx).cast("double"), (F.col("y0") + dy).cast("double"))
    corners = [at(0.0, 0.0), at(20.0, 0.0), at(20.0, 18.0), at(0.0, 18.0)]
    side = lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    sides = F.array(*[side(a, b) for a, b in zip(corners, [*corners[1:], corners[0]])])
    boxes = classed(spark, folder).select("fid", ((F.col("fid") % 11).cast("int") + 1).alias("cls"), F.explode(sides).alias("_e"))
    return grids, boxes.select("fid", "cls", "_e.*")


@query(
    "j4_polygon_fill_in_grids",
    f"WITH {TILED} SELECT scene_id, r, c, max(cls) AS label FROM cells8 JOIN blocks ON x+0.5>x0 AND x+0.5<x1 AND y-0.5>y0 AND y-0.5<y1 GROUP BY ALL", ["classed"],
)
def j4_fill(spark, folder):
    grids, boxes = tiled(spark, folder)
    return burn.burn(burn.filled_cells(burn.edges_in_grids(boxes, grids, 8.0)))


@query(
    "j10_burned_features",
    f"""WITH {TILED} SELECT scene_id, r, c, max(cls) AS label FROM (
    SELECT scene_id, r, c, cls FROM cells8 JOIN blocks ON sqrt(pow(greatest(x0-x-1, x-x1, 0), 2)+pow(greatest(y0-y, y-1-y1, 0), 2))<=0.3e0
    UNION ALL SELECT scene_id, r, c, 22 FROM cells8 JOIN (SELECT fid, x0, y0 FROM classed) ON fid%5=0 AND sqrt(pow(greatest(x0-x-1, x-x0-2, 0), 2)+pow(greatest(y0-y, y-1-y0, 0), 2))<=0.3e0) GROUP BY ALL""",
    ["classed"],
)
def j10_features(spark, folder):
    grids, boxes = tiled(spark, folder)
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    lines = classed(spark, folder).filter("fid % 5 = 0").select("fid", F.lit(22).alias("cls"), x0.alias("x0"), y0.alias("y0"), (x0 + 2).alias("x1"), y0.alias("y1"))
    return burn.burn_features(lines, boxes, grids, 8.0, 0.3)


def small(spark, folder):
    b = F.struct((F.col("w") + 0.25).alias("w"), (F.col("s") + 0.25).alias("s"), (F.col("w") + 0.75).alias("e"), (F.col("s") + 0.75).alias("n"))
    return prints(spark, folder).select("fid", b.alias("box"))


@query("j2_boxes_of_shapes", f"WITH {RECTS}, {SMALL} SELECT DISTINCT region_id, fid FROM rects r JOIN small b ON b.w<=r.e AND b.e>=r.w AND b.s<=r.n AND b.n>=r.s", ["zones", "prints"])
def j2(spark, folder):
    return R.regions_meet_boxes(small(spark, folder), shapes(spark, folder), 4.0, "fid")


@query(
    "j3_boxes_near_shapes",
    f"""WITH {RECTS}, {SMALL} SELECT DISTINCT region_id, fid FROM rects r JOIN small b
    ON sqrt(pow(greatest(r.w-b.e, b.w-r.e, 0), 2)+pow(greatest(r.s-b.n, b.s-r.n, 0), 2))<=0.3e0""",
    ["zones", "prints"],
)
def j3(spark, folder):
    return R.regions_meet_boxes(small(spark, folder), shapes(spark, folder), 4.0, "fid", within=0.3)


@query("j17_points_in_shapes", f"WITH {RECTS}, {SMALL} SELECT DISTINCT region_id, fid FROM rects r JOIN small b ON b.w BETWEEN r.w AND r.e AND b.s BETWEEN r.s AND r.n", ["zones", "prints"])
def j17(spark, folder):
    points = small(spark, folder).select("fid", F.col("box.w").alias("x"), F.col("box.s").alias("y"))
    return R.points_in_regions(points, shapes(spark, folder), 4.0, "fid")
