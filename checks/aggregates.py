"""A: aggregations; U: set operations."""

from pyspark.sql import functions as F

from checks.base import BANDS, cells, classed, query, r6s, rasters, relief, stack, table
from checks.joins import BURNED, CLASSED_ENDS, CLASSED_LINES, JUNCTIONS, NEAREST, junction_sql, print_boxes, raster_scenes, touched_sql
from checks.projections import CHIP, CHIPPED, CHOSEN, relief_chips, rings
from checks.sources import HYDRO, hydro_layers
from terracell.operators import augment, burn, catalog, composite, layers, logs, neighbourhood, regrid, splits
from terracell.operators.regions import regions_to_footprints
from terracell.plans.skew import attach_stats
from terracell.sources import records, vectors
from terracell.sources.manifests import pending


def composite_sql(n, columns=BANDS):
    """The composite in plain SQL: one window for each step of the reading order."""
    picks = ", ".join(f"cast(coalesce(floor(avg(CASE WHEN w*{b}<>0 THEN w*{b} END)),0) AS int) AS {b}" for b in columns)
    # a scene with one image is passed through
    return f"""WITH nb AS (SELECT *, coalesce(lag(clear) OVER (PARTITION BY scene_id,item_id,r ORDER BY c),0)
        + coalesce(lead(clear) OVER (PARTITION BY scene_id,item_id,r ORDER BY c),0) + coalesce(lag(clear) OVER (PARTITION BY scene_id,item_id,c ORDER BY r),0)
        + coalesce(lead(clear) OVER (PARTITION BY scene_id,item_id,c ORDER BY r),0) AS nb FROM stack),
    ed AS (SELECT *, CASE WHEN clear=0 AND nb>0 THEN 1 ELSE 0 END AS edge FROM nb),
    hx AS (SELECT *, max(edge) OVER (PARTITION BY scene_id,item_id,r ORDER BY c RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS hx FROM ed),
    gr AS (SELECT *, CASE WHEN max(hx) OVER (PARTITION BY scene_id,item_id,c ORDER BY r RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING)=1 THEN 0 ELSE clear END AS dil FROM hx),
    ar AS (SELECT *, sum(dil) OVER (PARTITION BY scene_id,r,c) AS sd, sum(clear) OVER (PARTITION BY scene_id,r,c) AS sc FROM gr),
    wt AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY scene_id,r,c)=1 THEN 1 WHEN sd>0 THEN dil WHEN sc=0 THEN 1 ELSE clear END AS w FROM ar)
    SELECT scene_id, r, c, {picks} FROM wt GROUP BY scene_id, r, c"""


@query("a1_cloud_masked_composite", composite_sql(1), ["stack"])
def a1(spark, folder):
    return composite.composite(stack(spark, folder), BANDS, 1)


USABLE = lambda b: f"CASE WHEN clear=1 AND {b}>0 THEN {b} END"


@query(
    "a2_masked_band_statistics",
    "SELECT scene_id, item_id, " + ", ".join(f"round(avg({USABLE(b)}),6) AS {b}_mean, round(stddev_pop({USABLE(b)}),6)+0e0 AS {b}_std" for b in BANDS) + " FROM stack GROUP BY ALL",
    ["stack"],
)
def a2(spark, folder):
    out = composite.band_statistics(stack(spark, folder), ["scene_id", "item_id"], BANDS)
    return r6s(out, *[f"{b}_{k}" for b in BANDS for k in ("mean", "std")])


@query("a3_first_valid_mosaic", f"{NEAREST} SELECT scene_id, r, c, arg_min(v, src) AS v FROM near GROUP BY scene_id, r, c", ["rasters"])
def a3(spark, folder):
    return regrid.cut_to_targets(rasters(spark, folder), *raster_scenes(spark, folder), 16.0, "nearest")


MERGED_CUBIC = f"""WITH m AS (SELECT x, y, arg_min(v, scene_id) AS v FROM (SELECT scene_id, scene_id*6+c AS x, r AS y, v FROM rasters) GROUP BY x, y),
tgt AS (SELECT g AS scene_id, cast(r AS int) AS r, cast(c AS int) AS c, g*6e0+0.25e0+0.75e0*(c+0.5e0) AS x, 0.25e0+0.75e0*(r+0.5e0) AS y
    FROM (SELECT DISTINCT scene_id AS g FROM rasters), range(9) a(r), range(9) b(c)),
near AS (SELECT scene_id, r, c, t.x AS tx, t.y AS ty, cast(floor(t.x-0.5e0) AS bigint)+i AS sx, cast(floor(t.y-0.5e0) AS bigint)+j AS sy
    FROM tgt t, range(-1,3) a(i), range(-1,3) b(j))
SELECT scene_id, r, c, round(sum(k*v)/sum(k),6)+0e0 AS v FROM (SELECT scene_id, r, c, v,
    (CASE WHEN dx<=1 THEN 1.5e0*dx*dx*dx-2.5e0*dx*dx+1 ELSE -0.5e0*dx*dx*dx+2.5e0*dx*dx-4*dx+2 END)*(CASE WHEN dy<=1 THEN 1.5e0*dy*dy*dy-2.5e0*dy*dy+1 ELSE -0.5e0*dy*dy*dy+2.5e0*dy*dy-4*dy+2 END) AS k
    FROM (SELECT scene_id, r, c, v, abs(tx-0.5e0-sx) AS dx, abs(ty-0.5e0-sy) AS dy FROM near JOIN m ON m.x=sx AND m.y=sy)) GROUP BY scene_id, r, c HAVING abs(sum(k))>1e-12"""


@query("a3_merge_then_cubic", MERGED_CUBIC, ["rasters"])
def a3_cubic(spark, folder):
    sources, targets = raster_scenes(spark, folder)
    return r6s(regrid.cut_merged_to_targets(rasters(spark, folder), sources, targets, 16.0), "v")


@query(
    "a4_weighted_mosaic",
    f"""WITH k AS (SELECT scene_id, r, c, v*(1+sr%3+sc%4) AS vw, 1+sr%3+sc%4 AS w FROM ({NEAREST.replace('src, r, c, v FROM', 'src, r, c, v, sr, sc FROM')} SELECT * FROM near))
    SELECT scene_id, r, c, round(sum(vw)/cast(sum(w) AS double),6)+0e0 AS v FROM k GROUP BY scene_id, r, c""",
    ["rasters"],
)
def a4(spark, folder):
    w = 1 + F.col("r") % 3 + F.col("c") % 4
    packed = rasters(spark, folder).select("scene_id", "r", "c", F.struct((F.col("v") * w).alias("vw"), w.alias("w")).alias("v"))
    near = regrid.nearest(regrid.pair_cells(packed, regrid.raster_pairs(*raster_scenes(spark, folder), 16.0)))
    return r6s(regrid.mosaic_weighted(near.select("scene_id", "r", "c", "v.vw", "v.w")), "v")


@query("a5_highest_class_wins", f"SELECT scene_id, r, c, max(cls) AS label FROM (SELECT scene_id, cast(y0 AS int) AS r, cast(x0 AS int) AS c, cls FROM classed) GROUP BY ALL", ["classed"])
def a5(spark, folder):
    cells_hit = classed(spark, folder).select("scene_id", F.col("y0").cast("int").alias("r"), F.col("x0").cast("int").alias("c"), "cls")
    return burn.burn(cells_hit)


@query(
    "a6_junction_override",
    f"""WITH b AS {BURNED}, j AS (SELECT scene_id, x AS x0, y AS y0, x AS x1, y AS y1 FROM {JUNCTIONS}),
    t AS (SELECT DISTINCT scene_id, cast(r AS int) AS r, cast(c AS int) AS c FROM {touched_sql('j', '1.2e0')})
    SELECT scene_id, r, c, CASE WHEN (scene_id, r, c) IN (SELECT (scene_id, r, c) FROM t) THEN 22 ELSE label END AS label FROM b""",
    ["classed"],
)
def a6(spark, folder):
    from checks.base import canvas

    lines = classed(spark, folder)
    return burn.burn_lines(lines, canvas(lines), 0.3)


@query(
    "a7_zero_report",
    """SELECT scene_id, item_id, max(r)+1 AS num_rows, max(c)+1 AS num_cols, cast((max(r)+1)*(max(c)+1) AS bigint) AS total,
    count(*) FILTER (b08+b04+b03+b02=0) AS num_zero, count(*) FILTER (b08+b04+b03+b02=0)/cast((max(r)+1)*(max(c)+1) AS double) AS zero_percent FROM stack GROUP BY ALL""",
    ["stack"],
)
def a7(spark, folder):
    return composite.zero_report(stack(spark, folder), ["scene_id", "item_id"], BANDS)


@query("a8_missing_share", f"SELECT scene_id, chip_r0, chip_c0, layer, round(avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END),6)+0e0 AS missing_share FROM (SELECT *, 'elevation' AS layer FROM {CHIPPED}) GROUP BY ALL", ["relief"])
def a8(spark, folder):
    chips = relief_chips(spark, folder).withColumn("layer", F.lit("elevation"))
    return r6s(layers.missing_share(chips, [*CHIP, "layer"]), "missing_share")


@query(
    "a8_missing_share_of_area",
    f"SELECT scene_id, chip_r0, chip_c0, round(1-count(CASE WHEN (r%8+c%8)%5<>0 THEN v END)/64e0,6)+0e0 AS missing_share FROM {CHIPPED} WHERE (r%8*3+c%8)%7<>0 GROUP BY ALL",
    ["relief"],
)
def a8_area(spark, folder):
    chips = relief_chips(spark, folder).filter((F.col("r") % 8 * 3 + F.col("c") % 8) % 7 != 0)
    holed = chips.withColumn("v", F.when((F.col("r") % 8 + F.col("c") % 8) % 5 != 0, F.col("v")).otherwise(F.lit(float("nan"))))
    return r6s(layers.missing_share(holed, CHIP, area=64), "missing_share")


@query(
    "a8_tolerated_chips",
    f"SELECT scene_id, chip_r0, chip_c0 FROM {CHIPPED} GROUP BY ALL HAVING avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END)<0.02e0", ["relief"],
)
def a8_chips(spark, folder):
    return layers.tolerated_chips(relief_chips(spark, folder).withColumn("layer", F.lit("elevation")), CHIP, limit=0.02)


@query("a9_lines_per_end_point", f"SELECT * FROM {junction_sql(CLASSED_ENDS, CLASSED_LINES, 2)}", ["classed"])
def a9(spark, folder):
    return burn.line_junctions(classed(spark, folder), 4.0, least=2)


@query("a10_rebased_elevation", "SELECT scene_id, r, c, v-min(v) OVER (PARTITION BY scene_id) AS v FROM relief", ["relief"])
def a10(spark, folder):
    return layers.rebase(relief(spark, folder), ["scene_id"])


LONG = f"(SELECT scene_id, chip_r0, chip_c0, r, c, 0 AS channel, v FROM {CHIPPED} UNION ALL SELECT scene_id, chip_r0, chip_c0, r, c, 1, CASE WHEN v<100000 THEN v END FROM {CHIPPED})"


@query(
    "a11_imputed_chips",
    f"""SELECT scene_id, chip_r0, chip_c0, r, c, channel, round(CASE WHEN v IS NULL AND avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id, chip_r0, chip_c0)<0.5e0
    THEN coalesce(avg(v) OVER (PARTITION BY scene_id, chip_r0, chip_c0, channel),0) ELSE v END,6)+0e0 AS v FROM {LONG}""",
    ["relief"],
)
def a11(spark, folder):
    chips = relief_chips(spark, folder)
    low = chips.withColumn("v", F.when(F.col("v") < 100000, F.col("v"))).withColumn("channel", F.lit(1))
    return r6s(layers.impute(chips.withColumn("channel", F.lit(0)).unionByName(low), CHIP), "v")


@query(
    "a12_max_pool",
    "SELECT scene_id, cast(r//4 AS int) AS r, cast(c//4 AS int) AS c, max(v) AS v FROM rasters GROUP BY scene_id, r//4, c//4", ["rasters"],
)
def a12(spark, folder):
    return neighbourhood.max_pool(rasters(spark, folder), ["scene_id"], 2)


@query("a13_latest_query_wins", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a13(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.col("event_id").alias("query"), "event_id", "event_type")
    return catalog.latest_by_id(rows, "user_id").drop("query")


@query("a14_coverage_share", "SELECT tile, round(avg(clear),6)+0e0 AS coverage FROM (SELECT scene_id AS tile, r, c, max(clear) AS clear FROM stack GROUP BY ALL) GROUP BY tile", ["stack"])
def a14(spark, folder):
    return r6s(catalog.coverage(stack(spark, folder).withColumnRenamed("scene_id", "tile")), "coverage")


@query("a15_channel_means", "SELECT scene_id, item_id, r, c, round(avg(v) OVER (PARTITION BY scene_id, item_id),6) AS mean FROM cells", ["cells"])
def a15(spark, folder):
    out = attach_stats(cells(spark, folder), ["scene_id", "item_id"], [F.avg("v").alias("mean")])
    return r6s(out.drop("v"), "mean")


@query("a16_metric_means", "SELECT event_type, round(avg(CASE WHEN user_id<>7 THEN floor(value) END),6) AS a, round(avg(event_id),6) AS b FROM events GROUP BY event_type")
def a16(spark, folder):
    log = table(spark, folder, "events").select("event_type", F.when(F.col("user_id") != 7, F.floor("value")).alias("a"), F.col("event_id").alias("b"))
    return r6s(logs.metric_means(log, ["a", "b"], ["event_type"]), "a", "b")


@query(
    "a17_newest_checkpoint",
    """SELECT model_name, o.a AS model_number, o.b AS epoch, o.d AS checkpoint FROM (SELECT event_type AS model_name,
    max({a: user_id, b: cast(day(ts) AS int), c: ts, d: event_id}) AS o FROM events GROUP BY event_type)""",
)
def a17(spark, folder):
    registry = table(spark, folder, "events").select(
        F.col("event_type").alias("model_name"), F.col("user_id").alias("model_number"), F.dayofmonth("ts").alias("epoch"),
        F.col("ts").alias("mtime"), F.col("event_id").alias("checkpoint"),
    )
    return logs.newest_checkpoint(registry)


HASH = "({0}*2654435761+{1}*40503)%1000003"


@query(
    "a19_holdout_regions",
    f"SELECT cast(c_custkey//100 AS int) AS region_group, arg_min(c_custkey, ({HASH.format('c_custkey', 3)})*10000000+c_custkey) AS region_id FROM customer GROUP BY c_custkey//100",
)
def a19(spark, folder):
    return splits.holdout_regions(table(spark, folder, "customer").select(F.col("c_custkey").alias("region_id")), seed=3)


ZEROS = "+".join(f"CASE WHEN {b}=0 THEN 1 ELSE 0 END" for b in BANDS)


@query("a20_zero_order", f"SELECT scene_id, item_id, cast(sum({ZEROS}) AS bigint) AS zeros FROM stack GROUP BY ALL", ["stack"])
def a20(spark, folder):
    return composite.zero_order(stack(spark, folder), ["scene_id", "item_id"], BANDS)


# --- U ---


@query("u1_union_of_layers", HYDRO)
def u1(spark, folder):
    return vectors.union_layers(hydro_layers(spark, folder))


@query(
    "u2_augmented_chips",
    f"""WITH k AS (SELECT scene_id, cast(item_id AS bigint) AS item_id, r, c, v FROM cells)
    SELECT scene_id, item_id, r, c, cast(v AS double) AS v, 0 AS copy FROM k UNION ALL SELECT scene_id, item_id, 7-c, r, v, 1 FROM k
    UNION ALL SELECT scene_id, item_id, r, c, round(CASE WHEN {CHOSEN} AND item_id<>3 THEN avg(v) OVER (PARTITION BY scene_id,item_id) ELSE v END,6)+0e0, 2 FROM k""",
    ["cells"],
)
def u2(spark, folder):
    wide = cells(spark, folder).withColumn("item_id", F.col("item_id").cast("long"))
    return r6s(augment.augmented(wide, ["scene_id"], 8, 8, "rot90", "item_id", label_channel=3), "v")


@query("u3_union_distinct_by_id", "SELECT k AS item_id, max_by(name, query) AS name FROM (SELECT c_custkey AS k, c_name AS name, 1 AS query FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier) GROUP BY k")
def u3(spark, folder):
    part = lambda t, k, n, q: table(spark, folder, t).select(F.col(k).alias("item_id"), F.col(n).alias("name"), F.lit(q).alias("query"))
    return catalog.latest_by_id(part("customer", "c_custkey", "c_name", 1).unionByName(part("supplier", "s_suppkey", "s_name", 2))).drop("query")


@query("u4_distinct_tiles", "SELECT DISTINCT file_name FROM prints", ["prints"])
def u4(spark, folder):
    return print_boxes(spark, folder).select("file_name").dropDuplicates(["file_name"])


@query("u5_except_finished", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u5(spark, folder):
    done = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(table(spark, folder, "orders").select("o_orderkey"), done, "o_orderkey")


@query("u6_append_statistics", "SELECT s_suppkey AS img, s_acctbal AS a, NULL AS b FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u6(spark, folder):
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("img"), F.col("s_acctbal").alias("a"))
    new = table(spark, folder, "customer").select(F.col("c_custkey").alias("img"), F.col("c_acctbal").alias("a"), F.col("c_name").alias("b"))
    return records.extended(old, new, "img")


@query(
    "u7_distinct_chips_of_regions",
    """SELECT DISTINCT fid AS chip FROM prints p JOIN zones z ON greatest(p.w-(z.w+1), (z.w+1)-p.e, 0)+greatest(p.s-(z.s+1), (z.s+1)-p.n, 0)<=3""",
    ["prints", "zones"],
)
def u7(spark, folder):
    chips = print_boxes(spark, folder).select(F.col("fid").alias("chip"), "box")
    return regions_to_footprints(rings(spark, folder), chips, 5.0, file="chip").select("chip").distinct()
