"""Registry of queries and the views they share."""

import re

from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(name, sql=None, views=()):
    """Register a query function of (spark, tables folder) under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return fn

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column, digits=6):
    """Rounded double without negative zero."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def r6s(df, *names, digits=6):
    return df.withColumns({n: r6(F.col(n), digits) for n in names})


def r6_fast(column):
    """``r6`` for very many values: the same numbers, and only those next to a tie or very large go through decimals."""
    millionths = column * 1e6
    plain = (F.abs(millionths) < 1e12) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    return F.when(plain, F.floor(millionths + 0.5) / 1e6).otherwise(F.round(column, 6)) + F.lit(0.0)


# --- the same views in DuckDB's SQL ---

VIEWS = {
    "rasters": """SELECT vec_id AS scene_id, cast(pos//8 AS int) AS r, cast(pos%8 AS int) AS c,
        cast(least(255, greatest(0, floor((cast(x AS double)+6e-1)*212e0))) AS int) AS v
        FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)""",
    "cells": """SELECT scene_id//4 AS scene_id, cast(scene_id%4 AS int) AS item_id, r, c, v FROM rasters""",
    "stack": """SELECT *, v AS b08, (v*7)%256 AS b04, (v*13)%256 AS b03, (v*31)%256 AS b02, v%12 AS scl,
        CASE WHEN v%12 IN (2,4,5,6,7,11) THEN 1 ELSE 0 END AS clear FROM cells""",
    "bands": """SELECT scene_id, r, c, max(CASE WHEN item_id=0 THEN v END) AS b08, max(CASE WHEN item_id=1 THEN v END) AS b04,
        max(CASE WHEN item_id=2 THEN v END) AS b03, max(CASE WHEN item_id=3 THEN v END) AS b02 FROM cells GROUP BY ALL""",
    "relief": """SELECT o_orderkey//1024 AS scene_id, cast((o_orderkey%1024)//32 AS int) AS r, cast(o_orderkey%32 AS int) AS c,
        CASE WHEN o_custkey%97=0 THEN NULL ELSE floor(o_totalprice) END AS v FROM orders""",
    "scored": """SELECT scene_id, r, c, (b08+b03)/510e0 AS prob,
        CASE WHEN (b04+b02)%46 < 23 THEN 0 ELSE (b04+b02)%23 END AS cls FROM bands""",
    "marked": """SELECT *, CASE WHEN prob>=0.5 THEN 1 ELSE 0 END AS p, CASE WHEN cls>0 THEN 1 ELSE 0 END AS t FROM scored""",
    "flat": """SELECT l_suppkey AS img, l_discount*10 AS prob, cast(l_quantity AS int)%23 AS cls FROM lineitem""",
    "flat_marked": """SELECT *, CASE WHEN prob>=0.5 THEN 1 ELSE 0 END AS p, CASE WHEN cls>0 THEN 1 ELSE 0 END AS t FROM flat""",
    "prints": """SELECT c_custkey AS fid, cast(w AS double) AS w, cast(s AS double) AS s, cast(w+2 AS double) AS e, cast(s+2 AS double) AS n,
        concat('bbox_', w, '_', s, '_', w+2, '_', s+2, '.tif') AS file_name
        FROM (SELECT c_custkey, (c_custkey*37)%356-180 AS w, (c_custkey*53)%166-84 AS s FROM customer)""",
    "zones": """SELECT s_suppkey AS region_id, cast(w AS double) AS w, cast(s AS double) AS s, cast(w+2 AS double) AS e, cast(s+2 AS double) AS n
        FROM (SELECT s_suppkey, (s_suppkey*37)%356-180 AS w, (s_suppkey*53)%166-84 AS s FROM supplier)""",
    "features": """SELECT p_partkey AS fid, p_partkey%4 AS scene_id, CASE p_partkey%17 WHEN 0 THEN 'Playa' WHEN 1 THEN 'Inundation Area'
        WHEN 2 THEN 'Swamp/Marsh: Hydrographic Category = Intermittent' WHEN 3 THEN 'Swamp/Marsh: Hydrographic Category = Perennial'
        WHEN 4 THEN 'Reservoir' WHEN 5 THEN 'Lake/Pond: Hydrographic Category = Perennial' WHEN 6 THEN 'Spillway' WHEN 7 THEN 'Wash'
        WHEN 8 THEN 'Canal/Ditch: Canal/Ditch Type = Aqueduct' WHEN 9 THEN 'Canal/Ditch' WHEN 10 THEN 'Artificial Path'
        WHEN 11 THEN 'Stream/River: Hydrographic Category = Ephemeral' WHEN 12 THEN 'Stream/River: Hydrographic Category = Perennial'
        WHEN 13 THEN 'Stream/River' WHEN 14 THEN 'Dam/Weir' WHEN 15 THEN 'Bridge' ELSE 'Coastline' END AS description,
        cast((p_partkey*13)%64 AS double) AS x0, cast((p_partkey*29)%64 AS double) AS y0,
        cast((p_partkey*13)%64+p_size%9-4 AS double) AS x1, cast((p_partkey*29)%64+p_partkey%7-3 AS double) AS y1,
        CASE WHEN p_partkey%3=0 THEN 'Polygon' WHEN p_partkey%3=1 THEN 'LineString' ELSE 'MultiLineString' END AS geom_type FROM part""",
    "classed": """SELECT fid, scene_id, x0, y0, x1, y1, CASE WHEN description LIKE 'Playa%' THEN 1 WHEN description LIKE 'Inund%' THEN 2
        WHEN description LIKE 'Swamp%Intermittent' THEN 3 WHEN description LIKE 'Swamp%Perennial' THEN 4 WHEN description='Reservoir' THEN 6
        WHEN description LIKE 'Lake/Pond%Perennial' THEN 8 WHEN description='Spillway' THEN 10 WHEN description='Wash' THEN 12
        WHEN description LIKE '%Aqueduct' THEN 14 WHEN description LIKE 'Canal%' THEN 15 WHEN description='Artificial Path' THEN 16
        WHEN description LIKE 'Stream%Ephemeral' THEN 17 WHEN description LIKE 'Stream%Perennial' THEN 19
        WHEN description LIKE 'Stream%' THEN 20 ELSE 21 END AS cls
        FROM features WHERE NOT contains(description,'Dam/Weir') AND NOT contains(description,'Bridge')""",
    "items": """SELECT event_id AS item_id, concat('g', event_id//2) AS granule_id, user_id%20 AS tile, cast(ts AS date) AS dt,
        2024-cast(event_id%3 AS int) AS yr, cast(floor(value) AS int)%100 AS cloud, cast(event_id%10 AS int) AS nodata FROM events""",
    "history": """SELECT user_id AS model, event_id AS step, floor(value*4) AS m FROM events""",
}


def with_views(names, body):
    """The query text with the views it needs, and the views those need, in front."""
    ordered = []

    def need(name):
        if name in ordered:
            return
        for other in re.findall(r"FROM (\w+)", VIEWS[name]):
            if other in VIEWS:
                need(other)
        ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    head, rest = ("WITH RECURSIVE ", body[len("WITH RECURSIVE "):]) if body.startswith("WITH RECURSIVE ") else ("WITH ", body)
    if rest.startswith("WITH "):
        return f"{head}{text}, {rest[len('WITH '):]}"
    if head == "WITH RECURSIVE ":
        return f"{head}{text}, {rest}"
    return f"{head}{text} {rest}"


# --- and as DataFrames ---


def rasters(spark, folder):
    from terracell.model import blocks_to_cells

    blocks = table(spark, folder, "embeddings").select(F.col("vec_id").alias("scene_id"), F.lit(8).alias("w"), "embedding")
    cells = blocks_to_cells(blocks, ["scene_id"], data="embedding", value="x")
    level = F.floor((F.col("x").cast("double") + 0.6) * 212.0)
    return cells.select("scene_id", "r", "c", F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("int").alias("v"))


def cells(spark, folder):
    return rasters(spark, folder).select(
        F.expr("scene_id div 4").alias("scene_id"), (F.col("scene_id") % 4).cast("int").alias("item_id"), "r", "c", "v"
    )


BANDS = ("b08", "b04", "b03", "b02")


def stack(spark, folder):
    from terracell.functions.bands import clear_mask

    v = F.col("v")
    out = cells(spark, folder).withColumns(
        {"b08": v, "b04": (v * 7) % 256, "b03": (v * 13) % 256, "b02": (v * 31) % 256, "scl": v % 12}
    )
    return out.withColumn("clear", clear_mask(F.col("scl")))


def bands(spark, folder):
    pick = lambda i: F.max(F.when(F.col("item_id") == i, F.col("v")))
    return cells(spark, folder).groupBy("scene_id", "r", "c").agg(*[pick(i).alias(b) for i, b in enumerate(BANDS)])


def relief(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.expr("o_orderkey div 1024").alias("scene_id"), F.floor((key % 1024) / 32).cast("int").alias("r"),
        (key % 32).cast("int").alias("c"),
        F.when(F.col("o_custkey") % 97 != 0, F.floor("o_totalprice").cast("double")).alias("v"),
    )


def scored(spark, folder):
    mixed = F.col("b04") + F.col("b02")
    return bands(spark, folder).select(
        "scene_id", "r", "c", ((F.col("b08") + F.col("b03")) / 510.0).alias("prob"),
        F.when(mixed % 46 < 23, F.lit(0)).otherwise(mixed % 23).alias("cls"),
    )


def mark(df):
    from terracell.functions.bands import binarise

    return df.withColumns({"p": binarise(F.col("prob")), "t": F.when(F.col("cls") > 0, 1).otherwise(0)})


def flat(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("img"), (F.col("l_discount") * 10).alias("prob"), (F.col("l_quantity").cast("int") % 23).alias("cls")
    )


def _boxes(df, key, name):
    w, s = (F.col(key) * 37) % 356 - 180, (F.col(key) * 53) % 166 - 84
    text = F.concat_ws("_", F.lit("bbox"), *[x.cast("string") for x in (w, s, w + 2, s + 2)])
    return df.select(
        F.col(key).alias(name), *[x.cast("double").alias(k) for k, x in zip("wsen", (w, s, w + 2, s + 2))],
        F.concat(text, F.lit(".tif")).alias("file_name"),
    )


def prints(spark, folder):
    return _boxes(table(spark, folder, "customer"), "c_custkey", "fid")


def zones(spark, folder):
    return _boxes(table(spark, folder, "supplier"), "s_suppkey", "region_id").drop("file_name")


# Descriptions given to the feature rows.
DESCRIPTIONS = (
    "Playa", "Inundation Area", "Swamp/Marsh: Hydrographic Category = Intermittent",
    "Swamp/Marsh: Hydrographic Category = Perennial", "Reservoir", "Lake/Pond: Hydrographic Category = Perennial",
    "Spillway", "Wash", "Canal/Ditch: Canal/Ditch Type = Aqueduct", "Canal/Ditch", "Artificial Path",
    "Stream/River: Hydrographic Category = Ephemeral", "Stream/River: Hydrographic Category = Perennial",
    "Stream/River", "Dam/Weir", "Bridge", "Coastline",
)


def features(spark, folder):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(d) for d in DESCRIPTIONS])
    kinds = F.array(F.lit("Polygon"), F.lit("LineString"), F.lit("MultiLineString"))
    x, y = (k * 13) % 64, (k * 29) % 64
    return table(spark, folder, "part").select(
        k.alias("fid"), (k % 4).alias("scene_id"), F.get(names, (k % 17).cast("int")).alias("description"),
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("p_size") % 9 - 4).cast("double").alias("x1"),
        (y + k % 7 - 3).cast("double").alias("y1"), F.get(kinds, (k % 3).cast("int")).alias("geom_type"),
    )


def classed(spark, folder):
    from terracell.functions.classes import feature_class, is_kept_type

    kept = features(spark, folder).filter(is_kept_type(F.col("description")))
    return kept.select("fid", "scene_id", "x0", "y0", "x1", "y1", feature_class(F.col("description")).alias("cls"))


def items(spark, folder):
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("item_id"), F.concat(F.lit("g"), F.expr("event_id div 2").cast("string")).alias("granule_id"),
        (F.col("user_id") % 20).alias("tile"), F.col("ts").cast("date").alias("dt"), (2024 - e % 3).cast("int").alias("yr"),
        (F.floor("value").cast("int") % 100).alias("cloud"), (e % 10).cast("int").alias("nodata"),
    )


def history(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("model"), F.col("event_id").alias("step"), F.floor(F.col("value") * 4).cast("double").alias("m")
    )


def canvas(df, size=64):
    """Raster metadata of the feature canvas for every scene in ``df``."""
    return df.select("scene_id").distinct().select(
        "scene_id", F.lit(0.0).alias("w"), F.lit(float(size)).alias("n"), F.lit(1.0).alias("x_res"), F.lit(1.0).alias("y_res"),
        F.lit(size).alias("height"), F.lit(size).alias("width"),
    )
