"""G: grids, tiles and lattices."""

from pyspark.sql import functions as F

from checks.base import cells, features, prints, query, r6s, rasters, relief, table, zones
from checks.projections import rings
from terracell.functions import affine, geodesy, geometry as G
from terracell.operators import chips, grids
from terracell.operators.regions import region_edges

LAT = "radians((s+n)/2)"
GRIDS = """WITH a AS (SELECT region_id, w AS rw, s AS rs, e AS re, n AS rn, w, s, e, n, (1/298.257223563e0)*(2-1/298.257223563e0) AS e2 FROM zones),
b AS (SELECT *, degrees(1000/(6378137e0*(1-e2)/pow(1-e2*sin(LAT)*sin(LAT),1.5e0))) AS yres FROM a),
c AS (SELECT * REPLACE (s-yres*50 AS s, n+yres*50 AS n) FROM b),
d AS (SELECT *, degrees(1000/(6378137e0/sqrt(1-e2*sin(LAT)*sin(LAT))*cos(LAT))) AS xres FROM c),
f AS (SELECT * REPLACE (w-xres*50 AS w, e+xres*50 AS e) FROM d),
g AS (SELECT * REPLACE (CASE WHEN w<-179.999e0 THEN -179.999e0 WHEN e>179.999e0 THEN w-xres*50 ELSE w END AS w,
    CASE WHEN w<-179.999e0 THEN e+xres*50 WHEN e>179.999e0 THEN 179.999e0 ELSE e END AS e) FROM f),
h AS (SELECT *, unnest(range(cast(floor(ceil((n-s)/yres)/50) AS int)+1)) AS grid_row FROM g),
i AS (SELECT *, unnest(range(cast(floor(ceil((e-w)/xres)/50) AS int)+1)) AS grid_col FROM h),
j AS (SELECT region_id, rw, rs, re, rn, grid_row, grid_col, s+50*grid_row*yres AS bs, s+50*grid_row*yres+100*yres AS bn,
    CASE WHEN e=179.999e0 THEN e-50*grid_col*xres-100*xres ELSE w+50*grid_col*xres END AS bw,
    CASE WHEN e=179.999e0 THEN e-50*grid_col*xres ELSE least(w+50*grid_col*xres+100*xres,179.999e0) END AS be FROM i)
SELECT region_id, cast(grid_row AS int) AS grid_row, cast(grid_col AS int) AS grid_col, round(bw,6)+0e0 AS w, round(bs,6)+0e0 AS s,
    round(be,6)+0e0 AS e, round(bn,6)+0e0 AS n FROM j WHERE bw<=re AND rw<=be AND bs<=rn AND rs<=bn""".replace("LAT", LAT)


@query("g1_reference_grids", GRIDS, ["zones"])
def g1(spark, folder):
    ring = G.box_ring(*[F.col(k) for k in "wsen"])
    regions = zones(spark, folder).select("region_id", ring.alias("ring"))
    out = grids.reference_grids(region_edges(regions, keys=("region_id",)), grid_width=100, step_size=50, grid_res=1000)
    return r6s(out.drop("file_name"), *"wsen")


RING_GRIDS = GRIDS.replace("w, s, e, n, (1/298", "w-2 AS w, s-2 AS s, e+2 AS e, n+2 AS n, (1/298").replace(
    "WHERE bw<=re AND rw<=be AND bs<=rn AND rs<=bn", "WHERE greatest(bw-(rw+1), rw+1-be, 0)+greatest(bs-(rs+1), rs+1-bn, 0)<=3"
)


@query("g1_reference_grids_in_rings", RING_GRIDS, ["zones"])
def g1_ring(spark, folder):
    edges = region_edges(rings(spark, folder), keys=("region_id",))
    return r6s(grids.reference_grids(edges, grid_width=100, step_size=50, grid_res=1000).drop("file_name"), *"wsen")


# a notched part with a hole and a part of its own, relative to the zone's corner
SHAPE_GRIDS = GRIDS.replace("w, s, e, n, (1/298", "w, s, w+9 AS e, s+9 AS n, (1/298").replace(
    "WHERE bw<=re AND rw<=be AND bs<=rn AND rs<=bn",
    """WHERE bw<=rw+6 AND rw<=be AND bs<=rs+4 AND rs<=bn AND NOT (bw>rw+1.5 AND be<rw+5 AND bs>rs+0.7 AND bn<rs+3.4)
    OR bw<=rw+2 AND rw<=be AND bs<=rs+9 AND rs+4<=bn OR bw<=rw+9 AND rw+8<=be AND bs<=rs+9 AND rs+6<=bn""",
)


@query("g1_reference_grids_of_shapes", SHAPE_GRIDS, ["zones"])
def g1_shapes(spark, folder):
    w, s = F.col("w"), F.col("s")
    ring = lambda *points: F.array(*[F.struct((w + x).alias("x"), (s + y).alias("y")) for x, y in points])
    parts = F.array(
        ring((0, 0), (6, 0), (6, 4), (2, 4), (2, 9), (0, 9)), ring((1.5, 0.7), (1.5, 3.4), (5, 3.4), (5, 0.7)), ring((8, 6), (9, 6), (9, 9), (8, 9))
    )
    edges = region_edges(zones(spark, folder).select("region_id", F.explode(parts).alias("ring")), keys=("region_id",))
    return r6s(grids.reference_grids(edges, grid_width=100, step_size=50, grid_res=1000).drop("file_name"), *"wsen")


TILE = """degrees(atan(sinh(pi()*(1-2*{0}/pow(2e0,zoom)))))"""


@query(
    "g2_tile_table",
    """WITH p AS (SELECT cast(least(63,greatest(0,floor((w+1+180)/360e0*64))) AS int) AS x_index,
        cast(least(63,greatest(0,floor((1-ln(tan(radians(s+1))+1/cos(radians(s+1)))/pi())/2*64))) AS int) AS y_index FROM prints),
    k AS (SELECT x_index, y_index, count(*) AS footprints FROM p GROUP BY ALL),
    t AS (SELECT cast(a.i AS int) AS x_index, cast(b.i AS int) AS y_index, 6 AS zoom FROM range(64) a(i) CROSS JOIN range(64) b(i))
    SELECT x_index, y_index, round(x_index/64e0*360-180,9)+0e0 AS w, round("""
    + TILE.format("(y_index+1)") + ",9)+0e0 AS s, round((x_index+1)/64e0*360-180,9)+0e0 AS e, round(" + TILE.format("y_index")
    + ",9)+0e0 AS n, coalesce(footprints,0) AS footprints FROM t LEFT JOIN k USING (x_index, y_index)",
    ["prints"],
)
def g2(spark, folder):
    at = geodesy.tile_index(F.col("w") + 1, F.col("s") + 1, F.lit(6))
    counts = prints(spark, folder).groupBy(at["x"].alias("x_index"), at["y"].alias("y_index")).agg(F.count(F.lit(1)).alias("footprints"))
    out = grids.tile_table(spark, 6).join(counts, ["x_index", "y_index"], "left")
    return r6s(out.withColumn("footprints", F.coalesce("footprints", F.lit(0))), *"wsen", digits=9)


@query(
    "g3_tile_bounds",
    """SELECT c_custkey, zoom, x_index, y_index, round(x_index/pow(2e0,zoom)*360-180,9)+0e0 AS w, round("""
    + TILE.format("(y_index+1)") + ",9)+0e0 AS s, round((x_index+1)/pow(2e0,zoom)*360-180,9)+0e0 AS e, round(" + TILE.format("y_index")
    + """,9)+0e0 AS n FROM (SELECT c_custkey, cast(c_custkey%10+1 AS int) AS zoom, cast(c_custkey*7%pow(2,c_custkey%10+1) AS int) AS x_index,
    cast(c_custkey*11%pow(2,c_custkey%10+1) AS int) AS y_index FROM customer)""",
)
def g3(spark, folder):
    k = F.col("c_custkey")
    zoom = (k % 10 + 1).cast("int")
    side = F.pow(F.lit(2), zoom)
    tiles = table(spark, folder, "customer").select(
        "c_custkey", zoom.alias("zoom"), (k * 7 % side).cast("int").alias("x_index"), (k * 11 % side).cast("int").alias("y_index")
    )
    return r6s(grids.with_tile_bounds(tiles, F.col("zoom")), *"wsen", digits=9)


@query(
    "g4_grid_of_ones",
    """SELECT s_suppkey AS scene_id, cast(r AS int) AS r, cast(c AS int) AS c, 1 AS v FROM supplier, range(7) a(r), range(5) b(c)
    WHERE r<s_suppkey%7+1 AND c<s_suppkey%5+1""",
)
def g4(spark, folder):
    k = F.col("s_suppkey")
    scenes = table(spark, folder, "supplier").select(k.alias("scene_id"), (k % 7 + 1).cast("int").alias("height"), (k % 5 + 1).cast("int").alias("width"))
    return grids.grid_cells(scenes)


@query(
    "g5_chip_lattice",
    """SELECT scene_id, cast(y*3 AS int) AS chip_r0, cast(x*3 AS int) AS chip_c0, cast(r-y*3 AS int) AS r, cast(c-x*3 AS int) AS c, v
    FROM rasters, range(2) a(y), range(2) b(x) WHERE r BETWEEN y*3 AND y*3+3 AND c BETWEEN x*3 AND x*3+3""",
    ["rasters"],
)
def g5(spark, folder):
    return grids.to_chips(rasters(spark, folder), (F.lit(8), F.lit(8)), 4, 3, 3)


WALK = """WITH RECURSIVE seen AS (FROM_WHERE),
size AS (SELECT scene_id, max(r)+1 AS h, max(c)+1 AS w FROM seen GROUP BY scene_id),
lattice AS (SELECT scene_id, r, unnest(range(w)) AS c FROM (SELECT scene_id, w, unnest(range(h)) AS r FROM size)),
m AS (SELECT l.scene_id, l.r, l.c, sum(CASE WHEN v IS NULL OR NOT isfinite(v) THEN 1 ELSE 0 END) OVER (PARTITION BY l.scene_id, l.r ORDER BY l.c RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k
    FROM lattice l LEFT JOIN seen ON seen.scene_id=l.scene_id AND seen.r=l.r AND seen.c=l.c),
pos AS (SELECT scene_id, r, c, sum(k) OVER (PARTITION BY scene_id, c ORDER BY r RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING)<LIMITe0*64 AS good FROM m),
walk AS (SELECT scene_id, 0::BIGINT AS r, 0::BIGINT AS c, 1 AS k FROM size WHERE h>=8 AND w>=8
    UNION ALL SELECT scene_id, r, c, k FROM (SELECT scene_id, h, CASE WHEN nc+8>w THEN nr+6 ELSE nr END AS r, CASE WHEN nc+8>w THEN 0 ELSE nc END AS c, k
        FROM (SELECT a.scene_id, h, w, CASE WHEN good THEN a.r ELSE a.r+2*k END AS nr, CASE WHEN good THEN a.c+6 ELSE a.c+2*k END AS nc, CASE WHEN good THEN 1 ELSE k+1 END AS k
            FROM walk a JOIN pos p ON a.scene_id=p.scene_id AND a.r=p.r AND a.c=p.c JOIN size z ON a.scene_id=z.scene_id)) WHERE r+8<=h)
SELECT scene_id, cast(r AS int) AS chip_r0, cast(c AS int) AS chip_c0 FROM walk JOIN pos USING (scene_id, r, c) WHERE good"""
# cells that are not finite, and cells that have no row
GAPS = """SELECT scene_id, r, c, CASE WHEN (r*5+c*3)%29=0 THEN 'nan'::DOUBLE WHEN (r*7+c)%37=0 THEN 'infinity'::DOUBLE ELSE v END AS v FROM relief WHERE (r*3+c*11)%31<>0"""


def walked(raster, limit):
    raster = raster.withColumn("layer", F.lit("elevation"))
    scenes = raster.groupBy("scene_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return chips.walk_chips(raster, scenes, 8, 6, 6, missing_step=2, limit=limit)


@query("g6_chip_walk", WALK.replace("FROM_WHERE", "SELECT * FROM relief").replace("LIMIT", "0.02"), ["relief"])
def g6(spark, folder):
    return walked(relief(spark, folder), 0.02)


@query("g6_chip_walk_around_gaps", WALK.replace("FROM_WHERE", GAPS).replace("LIMIT", "0.12"), ["relief"])
def g6_gaps(spark, folder):
    r, c = F.col("r"), F.col("c")
    odd = F.when((r * 5 + c * 3) % 29 == 0, F.lit(float("nan"))).when((r * 7 + c) % 37 == 0, F.lit(float("inf"))).otherwise(F.col("v"))
    return walked(relief(spark, folder).filter((r * 3 + c * 11) % 31 != 0).withColumn("v", odd), 0.12)


@query(
    "g7_single_parts",
    """SELECT fid, 0 AS part, least(x0,x1) AS w, greatest(y0,y1) AS n FROM features UNION ALL
    SELECT fid, 1, least(x0,x1)+10, greatest(y0,y1)+10 FROM features""",
    ["features"],
)
def g7(spark, folder):
    point = lambda x, y, d: F.struct((F.col(x) + d).alias("x"), (F.col(y) + d).alias("y"))
    part = lambda d: F.array(point("x0", "y0", d), point("x1", "y1", d))
    multi = features(spark, folder).select("fid", F.array(part(0), part(10)).alias("parts"))
    b = G.ring_bounds(F.col("ring"))
    return grids.single_parts(multi).select("fid", "part", b["w"].alias("w"), b["n"].alias("n"))


@query(
    "g8_chip_transform",
    """SELECT scene_id, chip_r0, chip_c0, scene_id+chip_c0*0.25e0 AS w, 10-(chip_r0+4)*0.5e0 AS s, scene_id+(chip_c0+4)*0.25e0 AS e, 10-chip_r0*0.5e0 AS n
    FROM (SELECT DISTINCT scene_id, cast(r//4*4 AS int) AS chip_r0, cast(c//4*4 AS int) AS chip_c0 FROM cells)""",
    ["cells"],
)
def g8(spark, folder):
    start = lambda k: (F.floor(F.col(k) / 4) * 4).cast("int")
    windows = cells(spark, folder).select("scene_id", start("r").alias("chip_r0"), start("c").alias("chip_c0")).distinct()
    b = affine.window_bounds(F.col("chip_r0"), F.col("chip_c0"), 4, 4, F.col("scene_id").cast("double"), F.lit(10.0), F.lit(0.25), F.lit(0.5))
    return windows.select("*", *[b[k].alias(k) for k in "wsen"])
