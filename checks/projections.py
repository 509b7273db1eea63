"""P: projections and predicates; F: scalar functions."""

from pyspark.sql import functions as F

from checks.base import BANDS, bands, cells, classed, features, items, prints, query, r6, r6s, rasters, relief, stack, table, zones
from terracell.functions import affine, bands as B, classes, geodesy, geometry as G, names
from terracell.operators import augment, catalog, layers

RC = ("scene_id", "r", "c")


@query("p1_bbox_from_name", "SELECT file_name, w-0.05e0 AS w, s-0.05e0 AS s, e+0.05e0 AS e, n+0.05e0 AS n FROM prints", ["prints"])
def p1(spark, folder):
    b = names.bbox_from_name(F.col("file_name"), 0.05)
    return prints(spark, folder).select("file_name", *[b[k].alias(k) for k in "wsen"])


@query(
    "p2_bbox_name",
    "SELECT fid, printf('bbox_%.10f_%.10f_%.10f_%.10f.tif', w, s, e+0.25e0, n+0.25e0) AS file_name, file_name AS raw FROM prints",
    ["prints"],
)
def p2(spark, folder):
    long = [F.col(k).cast("long") for k in "wsen"]
    return prints(spark, folder).select(
        "fid", names.bbox_name(F.col("w"), F.col("s"), F.col("e") + 0.25, F.col("n") + 0.25).alias("file_name"),
        names.bbox_name(*long, decimals=None).alias("raw"),
    )


@query(
    "p3_ignored_types",
    "SELECT fid, description FROM features WHERE NOT contains(description,'Dam/Weir') AND NOT contains(description,'Bridge')", ["features"],
)
def p3(spark, folder):
    return features(spark, folder).filter(classes.is_kept_type(F.col("description"))).select("fid", "description")


@query(
    "p4_stream_lines",
    """SELECT fid, description FROM features WHERE geom_type IN ('LineString','MultiLineString')
    AND (contains(description,'Stream') OR contains(description,'Artificial'))""",
    ["features"],
)
def p4(spark, folder):
    keep = classes.is_stream_line(F.col("geom_type"), F.col("description"))
    return features(spark, folder).filter(keep).select("fid", "description")


@query("p5_feature_class", "SELECT fid, cls FROM classed", ["classed"])
def p5(spark, folder):
    return classed(spark, folder).select("fid", "cls")


@query("p6_clear_mask", "SELECT scene_id, item_id, r, c, clear FROM stack", ["stack"])
def p6(spark, folder):
    return stack(spark, folder).select("scene_id", "item_id", "r", "c", "clear")


@query(
    "p7_catalogue_search",
    """SELECT item_id, tile, dt, cloud FROM items WHERE cloud<20 AND dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", ["items"],
)
def p7(spark, folder):
    bounds = names.interval_bounds(F.lit("2024-01-05/2024-01-20"))
    return catalog.search(items(spark, folder), 20, bounds["start"], bounds["end"]).select("item_id", "tile", "dt", "cloud")


@query("p8_binarise", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount*10>=0.5 THEN 1 ELSE 0 END AS p FROM lineitem")
def p8(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", B.binarise(F.col("l_discount") * 10).alias("p"))


CASES = " ".join(f"WHEN {k} THEN {v}e0" for k, v in classes.CLASS_WEIGHTS.items())


@query("p9_class_weight", f"SELECT fid, CASE cls {CASES} ELSE cast(cls AS double) END AS weight FROM classed", ["classed"])
def p9(spark, folder):
    return classed(spark, folder).select("fid", B.recode(F.col("cls"), classes.CLASS_WEIGHTS).alias("weight"))


@query(
    "p10_label_and_weight",
    """SELECT fid, y, CASE WHEN y=0 THEN 1e0 WHEN y<1 THEN 0e0 ELSE y END AS weight, CASE WHEN y<1 THEN 0 ELSE 1 END AS target
    FROM (SELECT fid, CASE cls """ + CASES + """ ELSE cast(cls AS double) END AS y FROM classed)""",
    ["classed"],
)
def p10(spark, folder):
    y = classed(spark, folder).select("fid", B.recode(F.col("cls"), classes.CLASS_WEIGHTS).alias("y"))
    return y.select("fid", "y", B.loss_weight(F.col("y")).alias("weight"), B.loss_target(F.col("y")).alias("target"))


def relief_chips(spark, folder):
    start = lambda k: (F.floor(F.col(k) / 8) * 8).cast("int")
    return relief(spark, folder).withColumns({"chip_r0": start("r"), "chip_c0": start("c")})


CHIPPED = "(SELECT *, cast(r//8*8 AS int) AS chip_r0, cast(c//8*8 AS int) AS chip_c0 FROM relief)"
CHIP = ["scene_id", "chip_r0", "chip_c0"]


@query(
    "p11_drop_missing_chips",
    f"""WITH k AS {CHIPPED} SELECT * FROM k WHERE (scene_id, chip_r0, chip_c0) NOT IN (SELECT (scene_id, chip_r0, chip_c0) FROM k WHERE v IS NULL)""",
    ["relief"],
)
def p11(spark, folder):
    return layers.drop_missing_chips(relief_chips(spark, folder), CHIP, ["v"])


@query(
    "p12_drop_odd_sized_chips",
    f"""WITH k AS {CHIPPED} SELECT * FROM k WHERE (scene_id, chip_r0, chip_c0) IN (SELECT (scene_id, chip_r0, chip_c0) FROM k
    GROUP BY scene_id, chip_r0, chip_c0 HAVING max(r)-min(r)+1=8 AND max(c)-min(c)+1=8)""",
    ["relief"],
)
def p12(spark, folder):
    return layers.drop_odd_sized_chips(relief_chips(spark, folder), CHIP, 8)


@query("p13_huge_is_missing", "SELECT o_orderkey, CASE WHEN x<1e30 THEN x END AS v FROM (SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1e38 ELSE floor(o_totalprice) END AS x FROM orders)")
def p13(spark, folder):
    x = F.when(F.col("o_orderstatus") == "F", F.lit(1e38)).otherwise(F.floor("o_totalprice").cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", B.null_if_huge(x).alias("v"))


@query("p14_default_nodata", "SELECT scene_id, r, c, CASE WHEN v<>0 THEN v END AS whole, CASE WHEN v<>255 THEN v/255e0 END AS fraction FROM rasters", ["rasters"])
def p14(spark, folder):
    as_float = F.when(F.col("v") == 255, F.lit(float("nan"))).otherwise(F.col("v") / 255.0)
    return rasters(spark, folder).select(*RC, B.default_nodata(F.col("v"), False).alias("whole"), B.default_nodata(as_float, True).alias("fraction"))


@query(
    "p15_elevation_validity",
    "SELECT o_orderkey, CASE WHEN x>-999999 AND x<10000 THEN x END AS v FROM (SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN -999999e0 ELSE floor(o_totalprice/20) END AS x FROM orders)",
)
def p15(spark, folder):
    x = F.when(F.col("o_orderstatus") == "F", F.lit(-999999.0)).otherwise(F.floor(F.col("o_totalprice") / 20).cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", B.valid_elevation(x).alias("v"))


DARK = "(SELECT scene_id, r, c, " + ", ".join(f"greatest({b}-150,0) AS {b}" for b in BANDS) + " FROM bands)"


@query(
    "p16_image_validity",
    "SELECT scene_id, r, c, " + ", ".join(f"CASE WHEN b08+b04+b03+b02>0 THEN {b} END AS {b}" for b in BANDS) + f" FROM {DARK}", ["bands"],
)
def p16(spark, folder):
    dark = bands(spark, folder).withColumns({b: F.greatest(F.col(b) - 150, F.lit(0)) for b in BANDS})
    return layers.mask_image(dark, BANDS)


@query(
    "p17_shrunk_and_grown_boxes",
    """SELECT fid, round(w+2e-7,9) AS w, round(s+2e-7,9) AS s, round(e-2e-7,9) AS e, round(n-2e-7,9) AS n, round(w-0.15e0,9) AS gw, round(n+0.15e0,9) AS gn FROM prints""",
    ["prints"],
)
def p17(spark, folder):
    box = F.struct("w", "s", "e", "n")
    small, big = G.grow(box, -2e-7), G.grow(box, 0.15)
    out = prints(spark, folder).select("fid", *[small[k].alias(k) for k in "wsen"], big["w"].alias("gw"), big["n"].alias("gn"))
    return r6s(out, *"wsen", "gw", "gn", digits=9)


@query("p18_countries", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey=r_regionkey WHERE lower(r_name)='asia'")
def p18(spark, folder):
    from terracell.sources.vectors import countries

    joined = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return countries(joined, "Asia", "r_name").select("n_nationkey", "n_name")


@query("p19_five_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem")
def p19(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


@query("p20_zero_fill", "SELECT scene_id, r, c, coalesce(v,0e0) AS v FROM relief", ["relief"])
def p20(spark, folder):
    return relief(spark, folder).withColumn("v", B.zero_fill(F.col("v")))


# --- F ---

INDEX_SQL = {
    "ndwi": "(b03-b08)/(b03+b08+255e-9)",
    "ndvi": "(b08-b04)/(b08+b04+255e-9)",
}


@query("f1_ndwi", f"SELECT scene_id, r, c, round({INDEX_SQL['ndwi']},6)+0e0 AS ndwi FROM bands", ["bands"])
def f1(spark, folder):
    return bands(spark, folder).select(*RC, r6(B.ndwi(B.fraction(F.col("b03")), B.fraction(F.col("b08")))).alias("ndwi"))


@query("f2_ndvi", f"SELECT scene_id, r, c, round({INDEX_SQL['ndvi']},6)+0e0 AS ndvi FROM bands", ["bands"])
def f2(spark, folder):
    return bands(spark, folder).select(*RC, r6(B.ndvi(B.fraction(F.col("b08")), B.fraction(F.col("b04")))).alias("ndvi"))


@query("f3_unit_scale", "SELECT scene_id, r, c, round(2e0*v/255e0-1e0,6)+0e0 AS v FROM rasters", ["rasters"])
def f3(spark, folder):
    return rasters(spark, folder).select(*RC, r6(B.unit_scale(F.col("v"))).alias("v"))


@query("f4_logistic_stretch", "SELECT l_orderkey, l_linenumber, cast(floor(255e0/(1e0+exp(-0.6e0*(l_quantity-25)/7e0))) AS int) AS v FROM lineitem")
def f4(spark, folder):
    z = (F.col("l_quantity") - 25) / 7.0
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", B.logistic_stretch(z).alias("v"))


@query(
    "f5_z_score",
    """SELECT scene_id, item_id, r, c, round((v-m)/(CASE WHEN s=0 THEN 1 ELSE s END),6)+0e0 AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s
    FROM cells WINDOW w AS (PARTITION BY scene_id,item_id))""",
    ["cells"],
)
def f5(spark, folder):
    from terracell.plans.skew import attach_stats

    stats = [F.avg("v").alias("m"), F.stddev_pop("v").alias("s")]
    out = attach_stats(cells(spark, folder), ["scene_id", "item_id"], stats)
    return out.select("scene_id", "item_id", "r", "c", r6(B.z_score(F.col("v"), F.col("m"), F.col("s"))).alias("z"))


SHAPES = "(SELECT scene_id, r, c, CASE WHEN scene_id%2=0 THEN 8 ELSE 9 END AS h FROM rasters)"


@query(
    "f6_blend_weight",
    f"""WITH d AS (SELECT *, pow(pow(abs(r/((h-1)/2e0)-1),10)+pow(abs(c/3.5e0-1),10),0.1e0) AS d FROM {SHAPES}),
    g AS (SELECT h, max(1/(min_d+1)) AS top FROM (SELECT h, min(pow(pow(abs(y/((h-1)/2e0)-1),10)+pow(abs(x/3.5e0-1),10),0.1e0)) AS min_d
        FROM (SELECT DISTINCT h FROM d), unnest(range(9)) a(y), unnest(range(8)) b(x) WHERE y<h GROUP BY h) GROUP BY h)
    SELECT scene_id, r, c, round(1/(d+1)/top,6)+0e0 AS weight FROM d JOIN g USING (h)""",
    ["rasters"],
)
def f6(spark, folder):
    h = F.when(F.col("scene_id") % 2 == 0, 8).otherwise(9)
    return rasters(spark, folder).select(*RC, r6(B.blend_weight(F.col("r"), F.col("c"), h, F.lit(8))).alias("weight"))


@query(
    "f7_cell_to_world",
    "SELECT scene_id, r, c, scene_id+(c+0.5e0)*0.25e0 AS x, 10-(r+0.5e0)*0.5e0 AS y, r AS back_r, c AS back_c FROM rasters", ["rasters"],
)
def f7(spark, folder):
    w, n, xr, yr = F.col("scene_id").cast("double"), F.lit(10.0), F.lit(0.25), F.lit(0.5)
    p = affine.cell_centre(F.col("r"), F.col("c"), w, n, xr, yr)
    out = rasters(spark, folder).select(*RC, p["x"].alias("x"), p["y"].alias("y"))
    back = affine.world_to_cell(F.col("x"), F.col("y"), w, n, xr, yr)
    return out.withColumns({"back_r": back["r"], "back_c": back["c"]})


NORTH = "degrees(10e0/(6378137e0*(1-e2)/pow(1-e2*sin(radians(lat))*sin(radians(lat)),1.5e0)))"
EAST = "degrees(10e0/(6378137e0/sqrt(1-e2*sin(radians(lat))*sin(radians(lat)))*cos(radians(lat))))"
E2 = "(1/298.257223563e0)*(2-1/298.257223563e0)"


@query(
    "f8_degrees_per_metre",
    f"SELECT region_id, round({NORTH},12) AS north, round({EAST},12) AS east FROM (SELECT region_id, s+1 AS lat, {E2} AS e2 FROM zones)", ["zones"],
)
def f8(spark, folder):
    lat = F.col("s") + 1
    return zones(spark, folder).select(
        "region_id", F.round(geodesy.degrees_north(10, lat), 12).alias("north"), F.round(geodesy.degrees_east(10, lat), 12).alias("east")
    )


@query(
    "f9_tile_latitude",
    "SELECT c_custkey, round(degrees(atan(sinh(pi()*(1-2*(c_custkey%1024)/1024e0)))),6)+0e0 AS lat FROM customer",
)
def f9(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", r6(geodesy.tile_latitude(F.col("c_custkey") % 1024, F.lit(10))).alias("lat"))


@query("f10_interval_one_year_back", "SELECT item_id, cast(dt - INTERVAL 1 YEAR AS date) AS dt, cast(dt + INTERVAL 30 DAY - INTERVAL 1 YEAR AS date) AS till FROM items", ["items"])
def f10(spark, folder):
    text = F.concat_ws("/", F.col("dt").cast("string"), F.date_add("dt", 30).cast("string"))
    b = names.interval_bounds(text)
    return items(spark, folder).select("item_id", names.year_earlier(b["start"]).alias("dt"), names.year_earlier(b["end"]).alias("till"))


@query("f11_padded_key", "SELECT s_suppkey, lpad(cast(s_suppkey AS varchar),4,'0') AS region_key FROM supplier")
def f11(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", names.padded_key(F.col("s_suppkey")).alias("region_key"))


@query("f12_truncating_cast", "SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice/1000) AS int) AS v FROM lineitem")
def f12(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", B.uint8(F.col("l_extendedprice") / 1000).alias("v"))


@query(
    "f13_rescaled_elevation",
    "SELECT scene_id, r, c, round((v-min(v) OVER (PARTITION BY scene_id))/50e0,6)+0e0 AS v FROM relief", ["relief"],
)
def f13(spark, folder):
    return r6s(layers.rebase(relief(spark, folder), ["scene_id"], scale=50.0), "v")


@query(
    "f14_turns",
    """SELECT scene_id, 'rot90' AS how, 7-c AS r, r AS c, v FROM rasters UNION ALL SELECT scene_id, 'flip_lr', r, 7-c, v FROM rasters
    UNION ALL SELECT scene_id, 'flip_ud', 7-r, c, v FROM rasters""",
    ["rasters"],
)
def f14(spark, folder):
    plain = rasters(spark, folder)
    parts = [augment.turn(plain, 8, 8, how).withColumn("how", F.lit(how)) for how in ("rot90", "flip_lr", "flip_ud")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CHOSEN = "(((item_id*1000003%65521*4096+r*73+c)*2654435761+0*40503)%1000003)%100<25"


@query(
    "f15_random_removal",
    f"""SELECT scene_id, item_id, r, c, round(CASE WHEN {CHOSEN} AND item_id<>3 THEN avg(v) OVER (PARTITION BY scene_id,item_id) ELSE v END,6)+0e0 AS v
    FROM (SELECT scene_id, cast(item_id AS bigint) AS item_id, r, c, v FROM cells)""",
    ["cells"],
)
def f15(spark, folder):
    wide = cells(spark, folder).withColumn("item_id", F.col("item_id").cast("long"))
    return r6s(augment.remove_positions(wide, ["scene_id"], "item_id", label_channel=3), "v")


def rings(spark, folder):
    """Diamonds of radius 3 around the zone centres."""
    x, y = F.col("w") + 1, F.col("s") + 1
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x + 3, y), point(x, y + 3), point(x - 3, y), point(x, y - 3), point(x + 3, y))
    return zones(spark, folder).select("region_id", ring.alias("ring"))


@query("f16_ring_bounds", "SELECT region_id, w-2 AS w, s-2 AS s, e+2 AS e, n+2 AS n FROM zones", ["zones"])
def f16(spark, folder):
    b = G.ring_bounds(F.col("ring"))
    return rings(spark, folder).select("region_id", *[b[k].alias(k) for k in "wsen"])


@query(
    "f17_box_meets_ring",
    """SELECT fid, greatest(w-cx, cx-e, 0)+greatest(s-cy, cy-n, 0)<=3 AS meets, w<=cx+3 AND cx-3<=e AND s<=cy+3 AND cy-3<=n AS bounds_meet
    FROM (SELECT *, cast(fid%5-2+w AS double) AS cx, cast(fid%11-5+s AS double) AS cy FROM prints)""",
    ["prints"],
)
def f17(spark, folder):
    x, y = F.col("fid") % 5 - 2 + F.col("w"), F.col("fid") % 11 - 5 + F.col("s")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x + 3, y), point(x, y + 3), point(x - 3, y), point(x, y - 3), point(x + 3, y))
    df = prints(spark, folder).withColumn("ring", ring)
    box = F.struct("w", "s", "e", "n")
    return df.select(
        "fid", G.box_meets_ring(box, F.col("ring")).alias("meets"), G.boxes_intersect(box, G.ring_bounds(F.col("ring"))).alias("bounds_meet")
    )


POINT_SEGMENT = """sqrt(pow({px}-(x0+t*(x1-x0)),2)+pow({py}-(y0+t*(y1-y0)),2))"""
ALONG = """CASE WHEN x0=x1 AND y0=y1 THEN 0e0 ELSE least(1e0,greatest(0e0,(({px}-x0)*(x1-x0)+({py}-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) END"""


@query(
    "f18_point_segment_distance",
    f"SELECT fid, round({POINT_SEGMENT.format(px='px', py='py')},6) AS d FROM (SELECT *, {ALONG.format(px='px', py='py')} AS t FROM (SELECT *, cast(fid%64 AS double) AS px, cast(fid*7%64 AS double) AS py FROM features))",
    ["features"],
)
def f18(spark, folder):
    px, py = (F.col("fid") % 64).cast("double"), (F.col("fid") * 7 % 64).cast("double")
    d = G.point_segment_distance(px, py, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return features(spark, folder).select("fid", r6(d).alias("d"))


@query("f19_line_ends", "SELECT fid, x0 AS hx, y0 AS hy, x1 AS tx, y1 AS ty FROM features", ["features"])
def f19(spark, folder):
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    line = F.array(point("x0", "y0"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), point("x1", "y1"))
    head, tail = G.head_point(line), G.tail_point(line)
    return features(spark, folder).select("fid", head["x"].alias("hx"), head["y"].alias("hy"), tail["x"].alias("tx"), tail["y"].alias("ty"))


CLIPPED = """(SELECT *, greatest(0e0, CASE WHEN x1=x0 THEN CASE WHEN x0<bw OR x0>be THEN 2e0 ELSE 0e0 END ELSE least((bw-x0)/(x1-x0),(be-x0)/(x1-x0)) END,
    CASE WHEN y1=y0 THEN CASE WHEN y0<bs OR y0>bn THEN 2e0 ELSE 0e0 END ELSE least((bs-y0)/(y1-y0),(bn-y0)/(y1-y0)) END) AS t0,
    least(1e0, CASE WHEN x1=x0 THEN CASE WHEN x0<bw OR x0>be THEN -1e0 ELSE 1e0 END ELSE greatest((bw-x0)/(x1-x0),(be-x0)/(x1-x0)) END,
    CASE WHEN y1=y0 THEN CASE WHEN y0<bs OR y0>bn THEN -1e0 ELSE 1e0 END ELSE greatest((bs-y0)/(y1-y0),(bn-y0)/(y1-y0)) END) AS t1 FROM {0})"""
CLIP_OUT = "round(x0+t0*(x1-x0),6)+0e0 AS x0, round(y0+t0*(y1-y0),6)+0e0 AS y0, round(x0+t1*(x1-x0),6)+0e0 AS x1, round(y0+t1*(y1-y0),6)+0e0 AS y1"


@query(
    "f20_clip_segment",
    f"SELECT fid, {CLIP_OUT} FROM {CLIPPED.format('(SELECT *, 16e0 AS bw, 16e0 AS bs, 48e0 AS be, 48e0 AS bn FROM features)')} WHERE t0<=t1", ["features"],
)
def f20(spark, folder):
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", (16.0, 16.0, 48.0, 48.0))])
    clip = G.clip_segment(*[F.col(k) for k in ("x0", "y0", "x1", "y1")], box)
    out = features(spark, folder).withColumn("clip", clip).filter(F.col("clip").isNotNull())
    return r6s(out.select("fid", "clip.x0", "clip.y0", "clip.x1", "clip.y1"), "x0", "y0", "x1", "y1")


@query(
    "f21_bounds_to_degrees",
    """SELECT fid, round(CASE WHEN fid%2=0 THEN w ELSE degrees(w*1e4/6378137e0) END,6)+0e0 AS w, round(CASE WHEN fid%2=0 THEN s ELSE degrees(atan(sinh(s*1e4/6378137e0))) END,6)+0e0 AS s,
    round(CASE WHEN fid%2=0 THEN e ELSE degrees(e*1e4/6378137e0) END,6)+0e0 AS e, round(CASE WHEN fid%2=0 THEN n ELSE degrees(atan(sinh(n*1e4/6378137e0))) END,6)+0e0 AS n FROM prints""",
    ["prints"],
)
def f21(spark, folder):
    plain = F.col("fid") % 2 == 0
    metres = {k: F.when(plain, F.col(k)).otherwise(F.col(k) * 1e4) for k in "wsen"}
    b = geodesy.bounds_to_lonlat(*metres.values(), F.when(plain, 4326).otherwise(3857))
    return r6s(prints(spark, folder).select("fid", *[b[k].alias(k) for k in "wsen"]), *"wsen")


@query("f22_outside_inside", "SELECT scene_id, r, c, CASE WHEN v>127 THEN 0 ELSE 1 END AS outside FROM rasters", ["rasters"])
def f22(spark, folder):
    # 1 outside the mask, 0 inside: what counts as covered from the start
    return rasters(spark, folder).select(*RC, B.outside_inside(F.greatest(F.col("v") - 127, F.lit(0))).alias("outside"))
