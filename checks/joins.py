"""J: joins."""

from pyspark.sql import functions as F

from checks.base import bands, canvas, cells, classed, features, prints, query, r6_fast, r6s, rasters, relief, scored, stack, table, zones
from checks.projections import ALONG, CLIP_OUT, CLIPPED, rings
from terracell.operators import burn, composite, layers, regrid, spatial, splits
from terracell.operators.regions import regions_to_footprints
from terracell.sources.manifests import existing, pending


def print_boxes(spark, folder):
    return prints(spark, folder).select("fid", "file_name", F.struct("w", "s", "e", "n").alias("box"))


def zone_boxes(spark, folder, name="region_box"):
    return zones(spark, folder).select("region_id", F.struct("w", "s", "e", "n").alias(name))


@query("j1_boxes_intersect", "SELECT fid, region_id FROM prints p JOIN zones z ON p.w<=z.e AND z.w<=p.e AND p.s<=z.n AND z.s<=p.n", ["prints", "zones"])
def j1(spark, folder):
    pairs = spatial.boxes_meet(print_boxes(spark, folder), zone_boxes(spark, folder), "box", "region_box")
    return pairs.select("fid", "region_id")


# sides from 0.002 to 60 degrees on the left, from 0.02 to 20 on the right
@query(
    "j1_boxes_of_all_sizes",
    """WITH a AS (SELECT fid, w, s, w+2e0*pow(10e0, fid%4-3)*(1+fid%3) AS e, s+2e0*pow(10e0, fid%4-3)*(1+fid%2) AS n FROM prints),
    b AS (SELECT region_id, w, s, w+2e0*pow(10e0, region_id%3-2) AS e, s+2e0*pow(10e0, region_id%3-1) AS n FROM zones)
    SELECT fid, region_id FROM a JOIN b ON a.w<=b.e AND b.w<=a.e AND a.s<=b.n AND b.s<=a.n""",
    ["prints", "zones"],
)
def j1_sizes(spark, folder):
    w, s = F.col("w"), F.col("s")
    box = lambda dx, dy: F.struct("w", "s", (w + dx).alias("e"), (s + dy).alias("n"))
    fid, zone = F.col("fid"), F.col("region_id")
    size = lambda k: 2.0 * F.pow(F.lit(10.0), k)
    left = prints(spark, folder).select("fid", box(size(fid % 4 - 3) * (1 + fid % 3), size(fid % 4 - 3) * (1 + fid % 2)).alias("box"))
    right = zones(spark, folder).select("region_id", box(size(zone % 3 - 2), size(zone % 3 - 1)).alias("region_box"))
    return spatial.boxes_meet(left, right, "box", "region_box").select("fid", "region_id")


DIAMOND = "greatest(p.w-(z.w+1), (z.w+1)-p.e, 0)+greatest(p.s-(z.s+1), (z.s+1)-p.n, 0)<=3"


@query("j2_chips_of_regions", f"SELECT DISTINCT file_name FROM prints p JOIN zones z ON {DIAMOND}", ["prints", "zones"])
def j2(spark, folder):
    regions = rings(spark, folder)
    pairs = regions_to_footprints(regions, print_boxes(spark, folder), 5.0)
    return splits.chips_of_regions(pairs, regions)


@query(
    "j3_tiles_for_regions",
    """SELECT region_id, fid AS tile, round(p.w+2e-7,9) AS w, round(p.s+2e-7,9) AS s, round(p.e-2e-7,9) AS e, round(p.n-2e-7,9) AS n
    FROM prints p JOIN zones z ON p.w<=z.e+0.15e0 AND z.w-0.15e0<=p.e AND p.s<=z.n+0.15e0 AND z.s-0.15e0<=p.n""",
    ["prints", "zones"],
)
def j3(spark, folder):
    tiles = print_boxes(spark, folder).select(F.col("fid").alias("tile"), "box")
    out = spatial.tiles_for_regions(tiles, zone_boxes(spark, folder), 5.0)
    return r6s(out.select("region_id", "tile", "box.*"), *"wsen", digits=9)


GRID_BOXES = "(SELECT s_suppkey AS grid, cast(s_suppkey*13%57 AS double) AS bw, cast(s_suppkey*29%57 AS double) AS bs, cast(s_suppkey*13%57+7 AS double) AS be, cast(s_suppkey*29%57+7 AS double) AS bn FROM supplier)"
PAIRED = f"(SELECT * FROM features JOIN {GRID_BOXES} ON least(x0,x1)<=be AND bw<=greatest(x0,x1) AND least(y0,y1)<=bn AND bs<=greatest(y0,y1))"


def grid_boxes(spark, folder):
    k = F.col("s_suppkey")
    x, y = (k * 13 % 57).cast("double"), (k * 29 % 57).cast("double")
    box = F.struct(x.alias("w"), y.alias("s"), (x + 7).alias("e"), (y + 7).alias("n"))
    return table(spark, folder, "supplier").select(k.alias("grid"), box.alias("box"))


@query("j4_features_clipped_to_grids", f"SELECT fid, grid, {CLIP_OUT} FROM {CLIPPED.format(PAIRED)} WHERE t0<=t1", ["features"])
def j4(spark, folder):
    segments = features(spark, folder).select("fid", "x0", "y0", "x1", "y1")
    out = spatial.segments_in_boxes(segments, grid_boxes(spark, folder), 8.0)
    return out.select("fid", "grid", *[r6_fast(F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(
    "j5_training_layers",
    "SELECT scene_id, r, c, b08, b04, b03, b02, e.v AS elevation, cls FROM bands JOIN relief e USING (scene_id, r, c) JOIN scored USING (scene_id, r, c)",
    ["bands", "relief", "scored"],
)
def j5(spark, folder):
    elevation = relief(spark, folder).withColumnRenamed("v", "elevation")
    return layers.training_layers([bands(spark, folder), elevation, scored(spark, folder).drop("prob")])


@query(
    "j6_deployment_layers",
    "SELECT scene_id, r, c, b08, b04, b03, b02, e.v AS elevation FROM bands FULL JOIN relief e USING (scene_id, r, c)", ["bands", "relief"],
)
def j6(spark, folder):
    return layers.deployment_layers(bands(spark, folder), relief(spark, folder).withColumnRenamed("v", "elevation"))


# Rasters in a row, each overlapping the next by two columns; targets are finer and shifted.
TARGETS = """src AS (SELECT scene_id AS src, r AS sr, c AS sc, v, scene_id*6e0 AS w FROM rasters),
tgt AS (SELECT g AS scene_id, cast(r AS int) AS r, cast(c AS int) AS c, g*6e0+0.25e0+0.75e0*(c+0.5e0) AS x, 7.75e0-0.75e0*(r+0.5e0) AS y
    FROM (SELECT DISTINCT scene_id AS g FROM rasters), range(9) a(r), range(9) b(c))"""
NEAREST = f"WITH {TARGETS}, near AS (SELECT t.scene_id, src, r, c, v FROM tgt t JOIN src ON src BETWEEN scene_id-2 AND scene_id+2 AND sc=floor(x-w) AND sr=floor(8-y))"


def raster_scenes(spark, folder, cells=None):
    ids = (rasters(spark, folder) if cells is None else cells).select("scene_id").distinct()
    f = lambda v: F.lit(float(v))
    sources = ids.select(
        "scene_id", (F.col("scene_id") * 6.0).alias("w"), f(8).alias("n"), f(1).alias("x_res"), f(1).alias("y_res"),
        F.lit(8).alias("height"), F.lit(8).alias("width"),
    )
    targets = ids.select(
        "scene_id", (F.col("scene_id") * 6.0 + 0.25).alias("w"), f(7.75).alias("n"), f(0.75).alias("x_res"), f(0.75).alias("y_res"),
        F.lit(9).alias("height"), F.lit(9).alias("width"),
    )
    return sources, targets


@query("j7_regrid_nearest", f"{NEAREST} SELECT scene_id, src AS src_scene_id, r, c, v FROM near", ["rasters"])
def j7(spark, folder):
    pairs = regrid.raster_pairs(*raster_scenes(spark, folder), 16.0)
    return regrid.nearest(regrid.pair_cells(rasters(spark, folder), pairs))


KERNEL = "CASE WHEN abs({0})<=1 THEN 1.5e0*pow(abs({0}),3)-2.5e0*pow(abs({0}),2)+1 WHEN abs({0})<2 THEN -0.5e0*pow(abs({0}),3)+2.5e0*pow(abs({0}),2)-4*abs({0})+2 ELSE 0e0 END"
CUBIC = f"""WITH {TARGETS}, k AS (SELECT t.scene_id, src, r, c, v, ({KERNEL.format('(x-w-0.5e0-sc)')})*({KERNEL.format('(8-y-0.5e0-sr)')}) AS k
    FROM tgt t JOIN src ON src BETWEEN scene_id-2 AND scene_id+2 AND abs(x-w-0.5e0-sc)<=2 AND abs(8-y-0.5e0-sr)<=2
    WHERE w<=scene_id*6e0+0.25e0+6.75e0 AND scene_id*6e0+0.25e0<=w+8)"""


@query(
    "j8_regrid_cubic",
    f"{CUBIC} SELECT scene_id, src AS src_scene_id, r, c, CASE WHEN abs(sum(k))>1e-12 THEN round(sum(k*v)/sum(k),6)+0e0 END AS v FROM k GROUP BY scene_id, src, r, c",
    ["rasters"],
)
def j8(spark, folder):
    pairs = regrid.raster_pairs(*raster_scenes(spark, folder), 16.0)
    return r6s(regrid.cubic(regrid.pair_cells(rasters(spark, folder), pairs)), "v")


@query(
    "j9_cropped_sources",
    """SELECT t.scene_id AS target_id, s.scene_id, r, c, v FROM rasters s JOIN (SELECT DISTINCT scene_id FROM rasters) t
    ON s.scene_id BETWEEN t.scene_id-3 AND t.scene_id+3 AND s.scene_id*6e0<=t.scene_id*6e0+7 AND t.scene_id*6e0+0.25e0<=s.scene_id*6e0+8
    WHERE s.scene_id*6e0+c+0.5e0 BETWEEN t.scene_id*6e0+0.25e0-2 AND t.scene_id*6e0+7+2 AND 8-(r+0.5e0) BETWEEN 1-2 AND 7.75e0+2""",
    ["rasters"],
)
def j9(spark, folder):
    return regrid.crop_to_targets(rasters(spark, folder), *raster_scenes(spark, folder), 16.0, margin=2)


# Distance from a segment to a unit cell: 0 when they touch, else least corner or end distance.
def _least_distance():
    corners = []
    for dx in ("c", "c+1"):
        for dy in ("64-r", "63-r"):
            t = ALONG.format(px=f"({dx})", py=f"({dy})")
            corners.append(f"sqrt(pow(({dx})-(x0+({t})*(x1-x0)),2)+pow(({dy})-(y0+({t})*(y1-y0)),2))")
    for x, y in (("x0", "y0"), ("x1", "y1")):
        corners.append(f"sqrt(pow(greatest(c-{x},{x}-(c+1),0),2)+pow(greatest(63-r-{y},{y}-(64-r),0),2))")
    return f"CASE WHEN t0<=t1 THEN 0e0 ELSE least({', '.join(corners)}) END"


def touched_sql(source, d):
    near = f"""(SELECT *, c AS bw, 63-r AS bs, c+1 AS be, 64-r AS bn FROM {source}, range(64) a(r), range(64) b(c)
        WHERE c BETWEEN least(x0,x1)-{d}-1 AND greatest(x0,x1)+{d} AND 63-r BETWEEN least(y0,y1)-{d}-1 AND greatest(y0,y1)+{d})"""
    return f"(SELECT * FROM {CLIPPED.format(near)} WHERE {_least_distance()}<={d}+1e-12)"


BURNED = f"""(SELECT scene_id, cast(r AS int) AS r, cast(c AS int) AS c, max(cls) AS label FROM {touched_sql('classed', '0.3e0')} GROUP BY scene_id, r, c)"""


def junction_sql(ends, segments, least=3):
    """Line ends lying on at least ``least`` lines (feature and part); both inputs are SQL with scene_id, fid, part."""
    return f"""(SELECT p.scene_id, x, y, count(DISTINCT (s.fid, s.part)) AS lines FROM (SELECT DISTINCT scene_id, x, y FROM {ends}) p JOIN {segments} s ON p.scene_id=s.scene_id
    AND x BETWEEN least(x0,x1) AND greatest(x0,x1) AND y BETWEEN least(y0,y1) AND greatest(y0,y1) AND (x1-x0)*(y-y0)=(y1-y0)*(x-x0)
    GROUP BY ALL HAVING count(DISTINCT (s.fid, s.part))>={least})"""


CLASSED_ENDS = "(SELECT scene_id, x0 AS x, y0 AS y FROM classed UNION ALL SELECT scene_id, x1, y1 FROM classed)"
CLASSED_LINES = "(SELECT *, 0 AS part FROM classed)"
JUNCTIONS = junction_sql(CLASSED_ENDS, CLASSED_LINES)
# two-segment lines, two of them to a feature, with a vertex in the middle
POLYLINES = """(SELECT scene_id, fid//8 AS fid, cast(fid%8 AS int) AS part, seq, CASE seq WHEN 0 THEN x0 ELSE x0+2 END AS x0, CASE seq WHEN 0 THEN y0 ELSE y0+2 END AS y0,
    CASE seq WHEN 0 THEN x0+2 ELSE x1 END AS x1, CASE seq WHEN 0 THEN y0+2 ELSE y1 END AS y1 FROM classed, (SELECT unnest([0,1]) AS seq))"""
POLYLINE_ENDS = "(SELECT scene_id, x0 AS x, y0 AS y FROM classed UNION ALL SELECT scene_id, x1, y1 FROM classed)"


def placed(spark, folder):
    lines = classed(spark, folder)
    return lines.join(canvas(lines), "scene_id")


@query("j10_burned_lines", f"SELECT * FROM {BURNED}", ["classed"])
def j10(spark, folder):
    return burn.burn(burn.touched_cells(placed(spark, folder), 0.3))


# Triangles with one corner on each segment end and one below
TRIANGLE = ("x0", "y0"), ("x1", "y1"), ("x0+5", "y1-6")


def triangle_edges(spark, folder):
    lines = placed(spark, folder)
    x = {"a": F.col("x0"), "b": F.col("x1"), "c": F.col("x0") + 5}
    y = {"a": F.col("y0"), "b": F.col("y1"), "c": F.col("y1") - 6}
    edge = lambda p, q: F.struct(x[p].alias("ex0"), y[p].alias("ey0"), x[q].alias("ex1"), y[q].alias("ey1"))
    edges = lines.select("*", F.inline(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a")))).drop("x0", "y0", "x1", "y1")
    for k in ("x0", "y0", "x1", "y1"):
        edges = edges.withColumnRenamed(f"e{k}", k)
    return edges


def _crossing(a, b):
    (xa, ya), (xb, yb) = a, b
    y = "(63.5e0-r)"
    return f"CASE WHEN (({ya})>{y})<>(({yb})>{y}) AND c+0.5e0<({xa})+({y}-({ya}))*(({xb})-({xa}))/nullif(({yb})-({ya}),0) THEN 1 ELSE 0 END"


INSIDE = "(" + "+".join(_crossing(TRIANGLE[i], TRIANGLE[(i + 1) % 3]) for i in range(3)) + ")%2=1"


@query(
    "j10_filled_polygons",
    f"SELECT fid, scene_id, cast(r AS int) AS r, cast(c AS int) AS c FROM classed, range(64) a(r), range(64) b(c) WHERE {INSIDE}", ["classed"],
)
def j10_fill(spark, folder):
    return burn.filled_cells(triangle_edges(spark, folder), keep=("fid",)).select("fid", "scene_id", "r", "c")


@query("j11_junctions", f"SELECT * FROM {JUNCTIONS}", ["classed"])
def j11(spark, folder):
    return burn.line_junctions(classed(spark, folder), 4.0)


@query("j11_junctions_of_polylines", f"SELECT * FROM {junction_sql(POLYLINE_ENDS, POLYLINES)}", ["classed"])
def j11_polylines(spark, folder):
    lines = classed(spark, folder).withColumns({"part": (F.col("fid") % 8).cast("int"), "fid": F.expr("fid div 8")})
    mid = {"mx": F.col("x0") + 2, "my": F.col("y0") + 2}
    piece = lambda seq, *at: F.struct(F.lit(seq).alias("seq"), *[F.col(c).alias(k) for c, k in zip(at, ("x0", "y0", "x1", "y1"))])
    both = lines.withColumns(mid).select("scene_id", "fid", "part", F.inline(F.array(piece(0, "x0", "y0", "mx", "my"), piece(1, "mx", "my", "x1", "y1"))))
    return burn.line_junctions(both, 4.0)


@query("j12_images_with_scene_class", "SELECT scene_id, item_id, r, c, b08, scl FROM stack", ["stack"])
def j12(spark, folder):
    keys = ["scene_id", "item_id", "r", "c"]
    df = stack(spark, folder)
    return df.select(*keys, "b08").join(df.select(*keys, "scl"), keys)


@query("j13_pending_inputs", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13(spark, folder):
    return pending(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id")


@query(
    "j14_keys_in_all_layers",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey IN (SELECT s_suppkey FROM supplier)",
)
def j14(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    sup = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return existing(table(spark, folder, "part").select("p_partkey", "p_name"), [lines, sup], "p_partkey")


@query(
    "j15_routed_chips",
    "SELECT doc_id, lang, CASE quality WHEN 1 THEN 'val' WHEN 0 THEN 'test' ELSE 'train' END AS split FROM documents LEFT JOIN labels USING (doc_id)",
)
def j15(spark, folder):
    lists = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "val").otherwise("test").alias("split"))
    return splits.route(table(spark, folder, "documents").select("doc_id", "lang"), lists, "doc_id")


NORMAL = ", ".join(
    f"coalesce(cast(floor(255e0/(1+exp(-0.6e0*((CASE WHEN {b}>0 THEN {b} END)-avg(CASE WHEN clear=1 AND {b}>0 THEN {b} END) OVER w)/"
    f"(CASE WHEN stddev_pop(CASE WHEN clear=1 AND {b}>0 THEN {b} END) OVER w=0 THEN 1 ELSE stddev_pop(CASE WHEN clear=1 AND {b}>0 THEN {b} END) OVER w END)))) AS int),0) AS {b}"
    for b in ("b08", "b04", "b03", "b02")
)


@query("j16_normalised_images", f"SELECT scene_id, item_id, r, c, {NORMAL} FROM stack WINDOW w AS (PARTITION BY scene_id, item_id)", ["stack"])
def j16(spark, folder):
    df = stack(spark, folder).drop("v", "clear")
    return composite.normalise(df, ["scene_id", "item_id"], ("b08", "b04", "b03", "b02")).drop("scl")


@query(
    "j17_cells_in_ring",
    "SELECT scene_id, r, c FROM rasters WHERE abs(c+0.5e0-(4+scene_id%3))+abs(r+0.5e0-4)<2.75e0", ["rasters"],
)
def j17(spark, folder):
    x = (4 + F.col("scene_id") % 3).cast("double")
    y, d = F.lit(4.0), 2.75
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x + d, y), point(x, y + d), point(x - d, y), point(x, y - d), point(x + d, y))
    df = rasters(spark, folder).withColumns({"x": F.col("c") + 0.5, "y": F.col("r") + 0.5, "ring": ring})
    return spatial.cells_in_ring(df, "ring").select("scene_id", "r", "c")


@query(
    "j18_merged_labels",
    "SELECT scene_id, r, c, max(v) AS v FROM (SELECT scene_id, r, c, cls AS v FROM scored UNION ALL SELECT scene_id, r, c, label FROM " + BURNED + ") GROUP BY ALL",
    ["scored", "classed"],
)
def j18(spark, folder):
    burned = j10(spark, folder).withColumnRenamed("label", "v")
    return layers.merge_labels(scored(spark, folder).select("scene_id", "r", "c", F.col("cls").alias("v")), burned)
