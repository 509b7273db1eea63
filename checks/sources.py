"""S: sources and sinks."""

from pyspark.sql import functions as F

from checks.base import cells, prints, query, r6s, rasters, table
from terracell.functions.names import padded_key
from terracell.model import blocks_to_cells, cells_to_blocks
from terracell.operators.grids import to_chips
from terracell.plans.lineage import scratch_path
from terracell.sources import layers, manifests, records, vectors


@query(
    "s1_read_layer_cells",
    """SELECT vec_id, cast(pos//8 AS int) AS r, cast(pos%8 AS int) AS c, cast(x AS double) AS v
    FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)""",
)
def s1(spark, folder):
    blocks = table(spark, folder, "embeddings").select("vec_id", F.lit(8).alias("w"), "embedding")
    return blocks_to_cells(blocks, ["vec_id"], data="embedding").withColumn("v", F.col("v").cast("double"))


@query(
    "s1_cells_to_blocks",
    """SELECT scene_id, cast(r//4 AS int) AS br, cast(c//4 AS int) AS bc, 4 AS h, 4 AS w, string_agg(cast(v AS varchar), ',' ORDER BY r, c) AS data
    FROM rasters GROUP BY scene_id, r//4, c//4""",
    ["rasters"],
)
def s1_blocks(spark, folder):
    blocks = cells_to_blocks(rasters(spark, folder), ["scene_id"], block=4)
    return blocks.withColumn("data", F.array_join(F.transform("data", lambda x: x.cast("string")), ","))


@query("s2_directory_manifest", "SELECT file_name, w, s, e, n FROM prints", ["prints"])
def s2(spark, folder):
    files = prints(spark, folder).select("fid", "file_name")
    with_orders = files.join(table(spark, folder, "orders").select(F.col("o_custkey").alias("fid")), "fid", "left_semi")
    return manifests.refreshed(manifests.footprints(with_orders), files.select("file_name"))


@query("s3_link_list", "SELECT url, string_split(url,'/')[-1] AS file_name FROM pages WHERE url<>''")
def s3(spark, folder):
    return manifests.links(table(spark, folder, "pages"), "url")


@query(
    "s4_id_manifest",
    """SELECT s_suppkey AS basin_id, concat('https://example.org/get?file=',s_suppkey,'-basins-gpkg') AS url,
        concat('basin_',s_suppkey,'.gpkg') AS target FROM supplier
    UNION ALL SELECT c_custkey, concat('https://example.org/get?file=',c_custkey,'-streamnet-gpkg'), concat('basin_',c_custkey,'.gpkg') FROM customer""",
)
def s4(spark, folder):
    part = lambda name, key, kind: manifests.basin_manifest(
        table(spark, folder, name).select(F.col(key).alias("basin_id")), f"https://example.org/get?file=%s-{kind}-gpkg", "basin_%s.gpkg"
    )
    return part("supplier", "s_suppkey", "basins").unionByName(part("customer", "c_custkey", "streamnet"))


def hydro_layers(spark, folder):
    def layer(name, key, text, number):
        k = F.col(key)
        return table(spark, folder, name).select(
            (k % 9).alias("visibilityfilter"), F.lit(number).alias("ftype"), (k % 50 + number).alias("fcode"),
            F.col(text).alias("fcode_description"), k.alias("geometry"), F.col(text).alias("not_kept"),
        )

    return [
        layer("part", "p_partkey", "p_type", 460), layer("supplier", "s_suppkey", "s_name", 390),
        layer("customer", "c_custkey", "c_mktsegment", 403), layer("orders", "o_orderkey", "o_orderpriority", 566),
    ]


HYDRO = " UNION ALL ".join(
    f"SELECT {k}%9 AS visibilityfilter, {n} AS ftype, {k}%50+{n} AS fcode, {t} AS fcode_description, {k} AS geometry FROM {f}"
    for f, k, t, n in (
        ("part", "p_partkey", "p_type", 460), ("supplier", "s_suppkey", "s_name", 390),
        ("customer", "c_custkey", "c_mktsegment", 403), ("orders", "o_orderkey", "o_orderpriority", 566),
    )
)


@query("s5_hydro_layers_by_region", f"SELECT *, lpad(cast(geometry%25 AS varchar),4,'0') AS region_key FROM ({HYDRO})")
def s5(spark, folder):
    path = scratch_path(spark, "features")
    merged = vectors.union_layers(hydro_layers(spark, folder))
    vectors.write_features(merged.withColumn("region_key", padded_key(F.col("geometry") % 25)), path)
    return spark.read.schema(f"{ddl(merged)}, region_key string").parquet(path)


def ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@query(
    "s6_region_hulls",
    """SELECT lpad(cast(c_custkey AS varchar),6,'0') AS region_key, cast(c_custkey AS int) AS region_id, c_name AS hull
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def s6(spark, folder):
    hulls = table(spark, folder, "customer").select(padded_key(F.col("c_custkey"), 6).alias("huc4"), F.col("c_name").alias("hull"))
    data = table(spark, folder, "orders").select(padded_key(F.col("o_custkey"), 6).alias("region_key"))
    return vectors.region_hulls(hulls, data)


@query(
    "s6_written_hulls",
    """SELECT lpad(cast(n_nationkey AS varchar),4,'0') AS region_key, cast(n_nationkey AS int) AS region_id, n_name AS hull, 2::BIGINT AS copies
    FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey%4<>1)""",
)
def s6_written(spark, folder):
    key = lambda name: padded_key(F.col(name), 4)
    hulls = table(spark, folder, "nation").select(key("n_nationkey").alias("huc4"), F.col("n_name").alias("hull"))
    data = table(spark, folder, "customer").filter("c_nationkey % 4 <> 1").select(key("c_nationkey").alias("region_key"))
    found = vectors.region_hulls(hulls, data)
    whole, parts = scratch_path(spark, "hulls"), scratch_path(spark, "hull")
    vectors.write_hulls(found, whole, parts)
    # the same rows from the one table and from the folder of each region
    both = spark.read.parquet(whole).unionByName(spark.read.schema(found.schema).parquet(parts))
    return both.groupBy("region_key", "region_id", "hull").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "s7_region_lookup",
    """SELECT c_custkey AS region_id, lpad(cast(c_custkey AS varchar),4,'0') AS region_key,
    c_custkey IN (SELECT s_suppkey FROM supplier) AS found FROM customer""",
)
def s7(spark, folder):
    indices = table(spark, folder, "customer").select(F.col("c_custkey").alias("region_id"))
    stored = table(spark, folder, "supplier").select(padded_key(F.col("s_suppkey")).alias("region_key"))
    return vectors.look_up(indices, stored)


@query("s8_write_and_read_layer", "SELECT scene_id, r, c, v FROM rasters", ["rasters"])
def s8(spark, folder):
    path = scratch_path(spark, "layer")
    layers.write_layer(cells_to_blocks(rasters(spark, folder), ["scene_id"]), path, "image")
    return layers.read_layer(spark, path, "image")


@query("s8_read_layer_in_bounds", "SELECT scene_id, r, c, v FROM rasters WHERE scene_id BETWEEN 20 AND 30 AND NOT (scene_id=20 AND c<3)", ["rasters"])
def s8_bounds(spark, folder):
    cells = rasters(spark, folder)
    scenes = cells.select("scene_id").distinct().select(
        "scene_id", (F.col("scene_id") * 10.0).alias("w"), F.lit(8.0).alias("n"), F.lit(1.0).alias("x_res"), F.lit(1.0).alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width")
    )
    path = scratch_path(spark, "bounded")
    layers.write_layer(cells, path, "image", scenes=scenes)
    # the bounds begin inside scene 20
    return layers.read_layer(spark, path, "image", (203.5, 0.0, 308.0, 8.0)).drop("layer")


@query(
    "s8_read_layer_along_curve",
    """SELECT scene_id, r, c, v FROM (SELECT *, (scene_id*37)%356-180+c*0.25e0 AS x, (scene_id*53)%166-82-(r+1)*0.25e0 AS y FROM rasters)
    WHERE x<=40.1e0 AND x+0.25e0>=-20.1e0 AND y<=35.1e0 AND y+0.25e0>=-30.1e0""",
    ["rasters"],
)
def s8_curve(spark, folder):
    cells, k = rasters(spark, folder), F.col("scene_id")
    scenes = cells.select("scene_id").distinct().select(
        "scene_id", (k * 37 % 356 - 180).cast("double").alias("w"), (k * 53 % 166 - 82).cast("double").alias("n"),
        F.lit(0.25).alias("x_res"), F.lit(0.25).alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width"),
    )
    path = scratch_path(spark, "curved")
    layers.write_layer_by_place(cells, path, "image", scenes)
    return layers.read_layer(spark, path, "image", (-20.1, -30.1, 40.1, 35.1)).drop("layer")


@query(
    "s8_resized_raster_metadata",
    "SELECT fid, w, s, e, n, round(2e0/416,9) AS x_res, round(2e0/832,9) AS y_res, 832 AS height, 416 AS width FROM prints",
    ["prints"],
)
def s8_meta(spark, folder):
    return r6s(layers.resized_scenes(prints(spark, folder).drop("file_name"), 832, 416), "x_res", "y_res", digits=9)


@query(
    "s9_sources_to_convert",
    """SELECT concat('basin_',doc_id,'.gpkg') AS file_name, concat('basin_',doc_id,'.parquet') AS target FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def s9(spark, folder):
    name = lambda t, end: table(spark, folder, t).select(F.format_string(f"basin_%s{end}", F.col("doc_id").cast("string")).alias("file_name"))
    return manifests.to_convert(name("documents", ".gpkg"), name("labels", ".parquet"))


@query("s9_convert_if_absent", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s9_ignore(spark, folder):
    path = scratch_path(spark, "vector")
    vectors.convert_if_absent(table(spark, folder, "nation"), path)
    vectors.convert_if_absent(table(spark, folder, "nation"), path)
    return spark.read.parquet(path)


@query(
    "s10_split_lists",
    """SELECT concat('bbox_',doc_id) AS file_name, CASE WHEN quality=1 THEN 'val' WHEN quality=0 THEN 'test' END AS split FROM labels""",
)
def s10(spark, folder):
    path = scratch_path(spark, "splits")
    split = F.when(F.col("quality") == 1, "val").when(F.col("quality") == 0, "test")
    listed = table(spark, folder, "labels").select(F.format_string("bbox_%s", F.col("doc_id").cast("string")).alias("file_name"), split.alias("split"))
    records.write_split_lists(listed, path)
    return records.read_split_lists(spark, path)


METRIC_NAMES = ("click", "error", "purchase", "signup", "view")


@query(
    "s11_training_log",
    "SELECT cast(day(ts) AS int) AS epoch, user_id AS data_index, "
    + ", ".join(f"round(avg(CASE WHEN event_type='{m}' THEN floor(value) END),6)+0e0 AS net_{m}" for m in METRIC_NAMES)
    + " FROM events GROUP BY ALL",
)
def s11(spark, folder):
    path = scratch_path(spark, "log")
    rows = table(spark, folder, "events").select(
        F.dayofmonth("ts").alias("epoch"), F.col("user_id").alias("data_index"), "event_type", F.floor("value").alias("value")
    )
    log = records.log_rows(rows, ["epoch", "data_index"], "event_type", "value", "net", METRIC_NAMES)
    records.append_log(log, path)
    schema = "data_index long, " + ", ".join(f"net_{m} double" for m in METRIC_NAMES) + ", epoch int"
    return r6s(records.read_log(spark, path, schema), *[f"net_{m}" for m in METRIC_NAMES])


@query(
    "s12_extended_statistics",
    """WITH stats AS (SELECT l_orderkey AS img, l_linestatus, count(*) AS num_cells, sum(cast(l_quantity AS bigint)) AS total FROM lineitem GROUP BY ALL)
    SELECT img, num_cells, cast(total AS bigint) AS total FROM stats WHERE l_linestatus='F'
    UNION ALL SELECT img, num_cells, cast(total AS bigint) FROM stats WHERE l_linestatus<>'F' AND img NOT IN (SELECT img FROM stats WHERE l_linestatus='F')""",
)
def s12(spark, folder):
    path = scratch_path(spark, "statistics")
    stats = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("img"), "l_linestatus").agg(
        F.count(F.lit(1)).alias("num_cells"), F.sum(F.col("l_quantity").cast("long")).alias("total")
    )
    first, later = stats.filter("l_linestatus = 'F'"), stats.filter("l_linestatus <> 'F'")
    records.append_stats(spark, first.drop("l_linestatus"), path, "img")
    records.append_stats(spark, later.drop("l_linestatus"), path, "img")
    return spark.read.parquet(path)


@query("s13_pruned_list", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s13(spark, folder):
    return records.keep_listed(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), "doc_id")


@query(
    "s14_chip_listing",
    """SELECT scene_id, cast(r//4*4 AS int) AS chip_r0, cast(c//4*4 AS int) AS chip_c0, count(DISTINCT item_id) AS layers FROM cells GROUP BY ALL""",
    ["cells"],
)
def s14(spark, folder):
    path = scratch_path(spark, "chips")
    chips = to_chips(cells(spark, folder), (F.lit(8), F.lit(8)), 4)
    layers.write_chips(chips.withColumn("layer", F.col("item_id").cast("string")), path)
    return layers.list_chips(spark.read.parquet(path))
