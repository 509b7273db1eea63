"""Whole jobs from polygons and raw layers: deployment (Z6, E2) and training data (E1)."""

from pyspark.sql import functions as F

from checks.base import BANDS, bands, query, r6s, zones
from checks.generators import GRIDS
from checks.metrics import _by_value, linear
from terracell.functions import geometry as G
from terracell.operators.regions import region_edges
from terracell.operators.scoring import FeatureSpec
from terracell.plans.deploy import deploy
from terracell.plans.training import training_data


def lattice_sql(width, step, res):
    """The reference grids of the zones as rasters, in SQL."""
    text = GRIDS[: GRIDS.rindex("SELECT region_id, cast")].replace("degrees(1000/", f"degrees({res}/")
    text = text.replace("50*grid", f"{step}*grid").replace("/50)", f"/{step})").replace("*50", f"*{width // 2}")
    text = text.replace("100*yres", f"{width}*yres").replace("100*xres", f"{width}*xres")
    return f"""({text} SELECT *, cast(round((be-w)/xr) AS int) AS width FROM (SELECT region_id*1099511627776+grid_row*1048576+grid_col AS scene_id, bw AS w, bn AS n, be,
        max(be-bw) OVER (PARTITION BY region_id)/{width}e0 AS xr, (bn-bs)/{width}e0 AS yr FROM j WHERE bw<=re AND rw<=be AND bs<=rn AND rs<=bn))"""


def nearest_sql(source, size_r, size_c):
    """Cells ``cel`` next to the cells of the rasters ``source`` (src, sw, sn, sx, sy) that lie under their centres."""
    i, j = "floor((sn-n)/sy+(yr/sy)*(r+5e-1))", "floor((w-sw)/sx+(xr/sx)*(c+5e-1))"
    return f"SELECT cel.scene_id, cel.r, cel.c, src, cast({i} AS int) AS sr, cast({j} AS int) AS sc FROM cel JOIN {source} ON {i}>=0 AND {i}<{size_r} AND {j}>=0 AND {j}<{size_c}"


# each zone has an image of 8 x 8 cells of 0.625 degrees around it, with holes, and an elevation raster shifted by 0.25
LAYERS = """img AS (SELECT scene_id AS src, r AS sr, c AS sc, CASE WHEN (scene_id+r*5+c*3)%13=0 THEN 0 ELSE b08 END AS b08, CASE WHEN (scene_id+r*5+c*3)%13=0 THEN 0 ELSE b04 END AS b04,
    CASE WHEN (scene_id+r*5+c*3)%13=0 THEN 0 ELSE b03 END AS b03, CASE WHEN (scene_id+r*5+c*3)%13=0 THEN 0 ELSE b02 END AS b02 FROM bands),
ele AS (SELECT scene_id AS src, r AS sr, c AS sc, CASE WHEN (scene_id+r+c)%11>0 THEN cast(3*b08+b02 AS double) END AS v FROM bands),
isc AS (SELECT region_id AS src, w-15e-1 AS sw, s+35e-1 AS sn, 625e-3 AS sx, 625e-3 AS sy FROM zones), esc AS (SELECT src, sw-25e-2 AS sw, sn+25e-2 AS sn, sx, sy FROM isc),
sce AS LATTICE, cel AS (SELECT scene_id, cast(r AS int) AS r, cast(c AS int) AS c, w, n, xr, yr, width FROM sce, range(4) a(r), range(4) b(c) WHERE c<width),
icut AS (SELECT scene_id, r, c, arg_min(b08, src) AS b08, arg_min(b04, src) AS b04, arg_min(b03, src) AS b03, arg_min(b02, src) AS b02 FROM (NEAR_IMAGE) JOIN img USING (src, sr, sc) WHERE b08+b04+b03+b02>0 GROUP BY ALL),
ecut AS (SELECT scene_id, r, c, arg_min(v, src) AS elevation FROM (NEAR_ELEVATION) JOIN ele USING (src, sr, sc) WHERE v IS NOT NULL GROUP BY ALL),
lay AS (SELECT scene_id, r, c, width, b08, b04, b03, b02, elevation FROM cel LEFT JOIN icut USING (scene_id, r, c) LEFT JOIN ecut USING (scene_id, r, c))""".replace(
    "NEAR_IMAGE", nearest_sql("isc", 8, 8)
).replace("NEAR_ELEVATION", nearest_sql("esc", 8, 8))

CHANNELS = FeatureSpec(mode="deploy").channels()
SLOPE = "CASE WHEN {i}=0 AND {i}={last} THEN elevation-elevation WHEN {i}=0 THEN {after}-elevation WHEN {i}={last} THEN elevation-{before} ELSE ((elevation-{before})+({after}-elevation))/2e0 END"
X_SLOPE = SLOPE.format(i="c", last="width-1", before="lag(elevation) OVER a", after="lead(elevation) OVER a")
Y_SLOPE = SLOPE.format(i="r", last="3", before="lag(elevation) OVER b", after="lead(elevation) OVER b")
SCORES = f"""WITH {LAYERS},
fea AS (SELECT scene_id, r, c, width, 2e0*b08/255-1 AS b08, 2e0*b04/255-1 AS b04, 2e0*b03/255-1 AS b03, 2e0*b02/255-1 AS b02, 2*((b03-b08)/(b03+b08+255e-9))-1 AS ndwi,
    2*((b08-b04)/(b08+b04+255e-9))-1 AS ndvi, elevation-min(elevation) OVER (PARTITION BY scene_id) AS elevation, {X_SLOPE} AS x_slope, -({Y_SLOPE}) AS y_slope FROM lay
    WINDOW a AS (PARTITION BY scene_id, r ORDER BY c), b AS (PARTITION BY scene_id, c ORDER BY r)),
wid AS (SELECT *, sqrt(x_slope*x_slope+y_slope*y_slope) AS gradient FROM fea),
sta AS (SELECT scene_id, {", ".join(f"coalesce(avg({ch}),0) AS m_{ch}" for ch in CHANNELS)}, ({"+".join(f"sum(CASE WHEN {ch} IS NULL THEN 1 ELSE 0 END)" for ch in CHANNELS)})/(1e1*count(*)) AS gone FROM wid GROUP BY scene_id),
sco AS (SELECT scene_id AS src, r AS sr, c AS sc, 1/(1+exp(-({"+".join(f"{k}*coalesce({ch},m_{ch})" for k, ch in enumerate(CHANNELS, 1))})/1000e0+1)) AS score,
    (pow(pow(1/3e0,10)+pow(CASE WHEN width%2=0 THEN 1e0/(width-1) ELSE 0 END,10),0.1e0)+1)/(pow(pow(abs(r/15e-1-1),10)+pow(CASE WHEN width>1 THEN abs(c/((width-1)/2e0)-1) ELSE 0 END,10),0.1e0)+1) AS weight
    FROM wid JOIN sta USING (scene_id) WHERE gone<0.5e0),
ssc AS (SELECT scene_id AS src, w AS sw, n AS sn, xr AS sx, yr AS sy FROM sce)"""
FIRST = SCORES.replace("LATTICE", lattice_sql(4, 2, 50000)) + f" SELECT scene_id, r, c, round(arg_min(score, src),6)+0e0 AS v FROM ({nearest_sql('ssc', 4, 4)}) JOIN sco USING (src, sr, sc) GROUP BY ALL"
WEIGHTED = (
    SCORES.replace("LATTICE", lattice_sql(4, 2, 50000))
    + f", tsc AS {lattice_sql(4, 4, 70000)}, tel AS (SELECT scene_id, cast(r AS int) AS r, cast(c AS int) AS c, w, n, xr, yr FROM tsc, range(4) a(r), range(4) b(c) WHERE c<width)"
    + f" SELECT scene_id, r, c, round(sum(score*weight)/sum(weight),6)+0e0 AS v FROM ({nearest_sql('ssc', 4, 4).replace('cel', 'tel')}) JOIN sco USING (src, sr, sc) GROUP BY ALL"
)


def raw_layers(spark, folder):
    """Edges of the zones, and image and elevation with their metadata."""
    z = zones(spark, folder)
    edges = region_edges(z.select("region_id", G.box_ring(*[F.col(k) for k in "wsen"]).alias("ring")), keys=("region_id",))
    flat = bands(spark, folder)
    hole = (F.col("scene_id") + F.col("r") * 5 + F.col("c") * 3) % 13 == 0
    image = flat.withColumns({b: F.when(hole, F.lit(0)).otherwise(F.col(b)) for b in BANDS})
    value = F.when((F.col("scene_id") + F.col("r") + F.col("c")) % 11 > 0, (F.col("b08") * 3 + F.col("b02")).cast("double"))
    meta = lambda by: z.select(
        F.col("region_id").alias("scene_id"), (F.col("w") - 1.5 - by).alias("w"), (F.col("s") + 3.5 + by).alias("n"),
        F.lit(0.625).alias("x_res"), F.lit(0.625).alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width"),
    )
    return edges, image, meta(0.0), flat.select("scene_id", "r", "c", value.alias("v")), meta(0.25)


def deployed(spark, folder, **kwargs):
    spec = FeatureSpec(mode="deploy")
    out = deploy(*raw_layers(spark, folder), spec, _by_value(linear), 4.0, grid_width=4, step=2, grid_res=50000, relief="nearest", **kwargs)
    return r6s(out, "v")


@query("z6_deployed_first_on_own_grids", FIRST, ["zones", "bands"])
def z6_first(spark, folder):
    return deployed(spark, folder, blend="first")


@query("z6_deployed_weighted_on_coarser_grids", WEIGHTED, ["zones", "bands"])
def z6_weighted(spark, folder):
    return deployed(spark, folder, out_width=4, out_res=70000)


# a level line of class 1 to 20 and a box of class 5 per zone; cells within 0.05 degrees of either are labelled
DISTANCE = "sqrt(pow(greatest(x0-x-xr, x-x1, 0), 2)+pow(greatest(y0-y, y-yr-y1, 0), 2))<=0.05e0"
TRAINING = (
    f"WITH {LAYERS}".replace("LATTICE", lattice_sql(4, 4, 50000))
    + f""", fea AS (SELECT region_id%20+1 AS cls, w-1 AS x0, w+1 AS x1, s+13e-1 AS y0, s+13e-1 AS y1 FROM zones UNION ALL SELECT 5, w+5e-1, w+12e-1, s+5e-1, s+11e-1 FROM zones),
lab AS (SELECT scene_id, r, c, max(cls) AS label FROM (SELECT *, w+c*xr AS x, n-r*yr AS y FROM cel) JOIN fea ON {DISTANCE} GROUP BY ALL),
chi AS (SELECT scene_id, cast(r//2*2 AS int) AS chip_r0, cast(c//2*2 AS int) AS chip_c0, cast(r%2 AS int) AS r, cast(c%2 AS int) AS c, b08, b04, b03, b02, elevation, cast(coalesce(label,0) AS int) AS label
    FROM lay LEFT JOIN lab USING (scene_id, r, c)),
kep AS (SELECT scene_id, chip_r0, chip_c0 FROM chi GROUP BY ALL HAVING count(b08)>2 AND count(elevation)>2)
SELECT chi.scene_id, chip_r0, chip_c0, r, c, b08, b04, b03, b02, elevation, label, CASE WHEN (chi.scene_id//1099511627776)%3=0 THEN 'test' ELSE 'train' END AS split
FROM chi SEMI JOIN kep USING (scene_id, chip_r0, chip_c0)"""
)


@query("e1_training_data", TRAINING, ["zones", "bands"])
def e1_data(spark, folder):
    z = zones(spark, folder)
    w, s = F.col("w"), F.col("s")
    side = lambda x0, y0, x1, y1: F.struct((w + x0).alias("x0"), (s + y0).alias("y0"), (w + x1).alias("x1"), (s + y1).alias("y1"))
    fid = F.col("region_id").alias("fid")
    lines = z.select(fid, (F.col("region_id") % 20 + 1).cast("int").alias("cls"), F.inline(F.array(side(-1.0, 1.3, 1.0, 1.3))))
    corners = [(0.5, 0.5), (1.2, 0.5), (1.2, 1.1), (0.5, 1.1)]
    sides = F.array(*[side(*a, *b) for a, b in zip(corners, [*corners[1:], corners[0]])])
    polygons = z.select(fid, F.lit(5).alias("cls"), F.inline(sides))
    order = ["fid", "x0", "y0", "x1", "y1", "cls"]
    held = z.filter("region_id % 3 = 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9))))
    lists = held.select((F.col("region_id") * 2**40 + F.col("i") * 2**20 + F.col("j")).cast("long").alias("scene_id"), F.lit("test").alias("split"))
    return training_data(
        *raw_layers(spark, folder), lines.select(*order), polygons.select(*order), BANDS, 4.0, 2, grid_width=4, grid_res=50000,
        lists=lists, limit=0.3, radius=0.05, relief="nearest",
    )
