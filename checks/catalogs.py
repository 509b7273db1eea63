"""T: ordering, top-k and sampling."""

from pyspark.sql import functions as F

from checks.base import bands, items, prints, query, relief, scored, stack, table
from checks.aggregates import composite_sql
from checks.joins import NORMAL
from terracell.functions.names import padded_key
from terracell.operators import catalog, splits
from terracell.operators.regions import region_edges
from terracell.plans.acquire import choose_items, tile_images
from terracell.plans.training import training_chips

HASH = "({0}*2654435761+{1}*40503)%1000003"


@query("t1_ranked_candidates", "SELECT tile, item_id, cloud+nodata AS score FROM items", ["items"])
def t1(spark, folder):
    return catalog.ranked(items(spark, folder)).select("tile", "item_id", "score")


def catalogue(spark, folder):
    """One item per acquisition of the image stack, four to a tile."""
    v = table(spark, folder, "embeddings").select("vec_id", "label")
    return v.select(
        F.expr("vec_id div 4").alias("tile"), (F.col("vec_id") % 4).cast("int").alias("item_id"), F.col("vec_id").cast("string").alias("granule_id"),
        (2024 - F.col("label") % 3).cast("int").alias("yr"), (F.col("vec_id") * 7 % 60).cast("int").alias("cloud"), (F.col("vec_id") % 10).cast("int").alias("nodata"),
    )


LADDER = dict(first_year=2024, cloud=1, max_cloud=50, step=5, min_year=2022)


# One candidate at a time in the order of the ladder; masks are 64-bit sets held in a wide integer.
COVER = """WITH RECURSIVE cat AS (SELECT vec_id//4 AS tile, cast(vec_id%4 AS int) AS item_id, 2024-label%3 AS yr, cast(vec_id*7%60 AS int) AS cloud, cast(vec_id%10 AS int) AS nodata FROM embeddings),
lad AS (SELECT cast(i AS int) AS tier, least(50,1+5*i) AS cap FROM range(11) a(i)),
tie AS (SELECT tile, item_id, cloud+nodata AS score, min(tier) AS tier FROM (SELECT tile, item_id, cloud, nodata, tier FROM cat, lad WHERE yr=2024 AND cloud<cap
    UNION ALL SELECT tile, item_id, cloud, nodata, 10+2024-yr FROM cat WHERE yr<2024 AND yr>=2022 AND cloud<50) GROUP BY ALL),
msk AS (SELECT scene_id AS tile, item_id, cast(sum(CASE WHEN clear=1 THEN cast(1 AS hugeint)<<(r*8+c) ELSE 0 END) AS hugeint) AS mask FROM stack GROUP BY ALL),
cand AS (SELECT tile, item_id, tier, mask, row_number() OVER (PARTITION BY tile ORDER BY tier, score, item_id) AS k FROM tie JOIN msk USING (tile, item_id)),
walk AS (SELECT tile, cast(0 AS bigint) AS k, tier, cast(0 AS hugeint) AS mask, cast([] AS integer[]) AS chosen FROM cand WHERE k=1
    UNION ALL SELECT tile, k, CASE WHEN take THEN ctier ELSE tier END, CASE WHEN take THEN mask|cmask ELSE mask END, CASE WHEN take THEN list_append(chosen, item_id) ELSE chosen END
    FROM (SELECT w.tile, c.k, w.tier, c.tier AS ctier, w.mask, c.mask AS cmask, chosen, item_id,
        len(chosen)<4 AND 1-bit_count(w.mask)/64e0>=1e-4 AND (c.tier=w.tier OR 1-bit_count(w.mask)/64e0>=0.5e0/5)
        AND (bit_count(w.mask|c.mask)-bit_count(w.mask))/64e0>=0.1e0*(1-bit_count(w.mask)/64e0) AS take FROM walk w JOIN cand c ON c.tile=w.tile AND c.k=w.k+1)),
fin AS (SELECT tile, arg_max(mask, k) AS mask, arg_max(chosen, k) AS chosen FROM walk GROUP BY tile),
sel AS (SELECT tile, unnest(chosen) AS item_id, unnest(range(len(chosen))) AS place, bit_count(mask)/64e0 AS found FROM fin WHERE 1-bit_count(mask)/64e0<0.5e0)"""


@query("t2_greedy_cover", f"{COVER} SELECT tile, cast(place AS int) AS place, item_id, found FROM sel", ["stack"])
def t2(spark, folder):
    images = stack(spark, folder).withColumnRenamed("scene_id", "tile")
    tiles = images.groupBy("tile").agg(F.count_distinct("r", "c").alias("total"))
    return choose_items(catalogue(spark, folder), images, tiles, 8, LADDER, min_share=0.1, max_items=4, max_remaining=0.5)


@query(
    "t3_tier_ladder",
    """WITH l AS (SELECT cast(i AS int) AS tier, least(50,1+5*i) AS cap FROM range(11) a(i))
    SELECT item_id, tile, min(tier) AS tier FROM (SELECT item_id, tile, tier FROM items, l WHERE yr=2024 AND cloud<cap
    UNION ALL SELECT item_id, tile, 10+2024-yr FROM items WHERE yr<2024 AND yr>=2022 AND cloud<50) GROUP BY item_id, tile""",
    ["items"],
)
def t3(spark, folder):
    return catalog.tiered(items(spark, folder), **LADDER).select("item_id", "tile", "tier")


# half years and intervals over the turn of a year, one per tile; the items are moved back by up to 39 months
SEARCHES = """old AS (SELECT * REPLACE (dt-cast(item_id%40*30 AS int) AS dt) FROM items), sea AS (SELECT tile, CASE WHEN tile%2=0 THEN DATE '2024-01-01' ELSE DATE '2024-11-15' END AS s, CASE WHEN tile%2=0 THEN DATE '2024-06-30' ELSE DATE '2025-02-28' END AS e
    FROM (SELECT DISTINCT tile FROM items)),
lad AS (SELECT tile, cast(i AS int) AS tier, s, e, least(50,1+5*i) AS below FROM sea, range(11) a(i)
    UNION ALL SELECT tile, cast(10+y AS int), cast(s-to_months(cast(12*y AS int)) AS date), cast(e-to_months(cast(12*y AS int)) AS date), 50 FROM sea, range(1,4) b(y))"""


def searches(df):
    day = lambda even, odd: F.when(F.col("tile") % 2 == 0, even).otherwise(odd).cast("date")
    tiles = df.select("tile").distinct()
    return tiles.select("tile", day("2024-01-01", "2024-11-15").alias("start"), day("2024-06-30", "2025-02-28").alias("end"))


@query(
    "t3_interval_ladder",
    f"WITH {SEARCHES} SELECT item_id, i.tile, dt, min(tier) AS tier FROM old i JOIN lad l ON i.tile=l.tile AND dt BETWEEN s AND e AND cloud<below GROUP BY ALL",
    ["items"],
)
def t3_interval(spark, folder):
    listed = items(spark, folder).withColumn("dt", F.date_sub("dt", (F.col("item_id") % 40 * 30).cast("int")))
    ladder = catalog.search_ladder(searches(listed), cloud=1, max_cloud=50, step=5, min_year=2021)
    return catalog.tiered_by_interval(listed, ladder).select("item_id", "tile", "dt", "tier")


@query(
    "t4_top_per_tile",
    "SELECT tile, item_id, score, cast(rank AS int) AS rank FROM (SELECT tile, item_id, cloud+nodata AS score, row_number() OVER (PARTITION BY tile ORDER BY cloud+nodata, item_id) AS rank FROM items) WHERE rank<=4",
    ["items"],
)
def t4(spark, folder):
    return catalog.top_per_tile(items(spark, folder), 4).select("tile", "item_id", "score", "rank")


@query("t5_seeded_shuffle", f"SELECT o_orderkey, {HASH.format('o_orderkey', 11)} AS h FROM orders")
def t5(spark, folder):
    return splits.shuffled(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 11)


@query(
    "t6_validation_sample",
    f"SELECT doc_id, {HASH.format('doc_id', 2)} AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=0) ORDER BY h, doc_id LIMIT 500",
)
def t6(spark, folder):
    test = table(spark, folder, "labels").filter("quality = 0")
    return splits.sample_first(table(spark, folder, "documents").select("doc_id"), "doc_id", 500, 2, exclude=test)


@query("t7_first_of_validation", f"SELECT doc_id, {HASH.format('doc_id', 4)} AS h FROM labels WHERE quality=1 ORDER BY h, doc_id LIMIT 100")
def t7(spark, folder):
    return splits.sample_first(table(spark, folder, "labels").filter("quality = 1").select("doc_id"), "doc_id", 100, 4)


@query("t9_sorted_regions_and_files", "SELECT lpad(cast(fid AS varchar),6,'0') AS region_key, file_name FROM prints", ["prints"])
def t9(spark, folder):
    return prints(spark, folder).orderBy("fid", "file_name").select(padded_key(F.col("fid"), 6).alias("region_key"), "file_name")


@query("t10_kept_batches", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {HASH.format('l_orderkey', 9)}<10000")
def t10(spark, folder):
    return splits.keep_sample(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 10000 / 1000003, 9)


# a diamond in each tile, granules shared by two items, and items whose box misses the polygon
IN_POLYGON = (
    COVER.replace("vec_id//4 AS tile, cast", "vec_id//4 AS tile, vec_id//2 AS gran, vec_id%5<>0 AS meets, cast")
    .replace("lad AS (", "ivl AS (SELECT vec_id, make_date(2024-label%3, 1+cast(vec_id%12 AS int), 15) AS dt FROM embeddings), lad AS (")
    .replace("SELECT tile, item_id, cloud+nodata AS score, min(tier) AS tier FROM (SELECT tile, item_id, cloud,", "SELECT tile, item_id, gran, meets, cloud+nodata AS score, min(tier) AS tier FROM (SELECT tile, item_id, gran, meets, cloud,")
    .replace("UNION ALL SELECT tile, item_id, cloud, nodata, 10+2024-yr", "UNION ALL SELECT tile, item_id, gran, meets, cloud, nodata, 10+2024-yr")
    .replace("FROM cat, lad WHERE yr=2024 AND", "FROM cat JOIN ivl ON vec_id=tile*4+item_id, lad WHERE month(dt)<=6 AND yr=2024 AND")
    .replace("FROM cat WHERE yr<2024", "FROM cat JOIN ivl ON vec_id=tile*4+item_id WHERE month(dt)<=6 AND yr<2024")
    .replace("cand AS (SELECT", """out AS (SELECT t AS tile, cast(sum(cast(1 AS hugeint)<<(r*8+c)) AS hugeint) AS mask FROM (SELECT DISTINCT tile AS t FROM cat), range(8) a(r), range(8) b(c)
    WHERE abs(c+0.5e0-(4+t%3))+abs(r+0.5e0-4)>3.75e0 GROUP BY t), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile, gran ORDER BY tier, score, item_id) AS nth FROM tie) WHERE nth=1 AND meets),
    cand AS (SELECT""")
    .replace("FROM tie JOIN msk", "FROM once JOIN msk")
    .replace("tier, cast(0 AS hugeint) AS mask, cast([] AS integer[]) AS chosen FROM cand WHERE k=1", "tier, out.mask, cast([] AS integer[]) AS chosen FROM cand JOIN out USING (tile) WHERE k=1")
)


@query("t2_cover_of_polygons", f"{IN_POLYGON} SELECT tile, cast(place AS int) AS place, item_id, found FROM sel", ["stack"])
def t2_polygons(spark, folder):
    images = stack(spark, folder).withColumnRenamed("scene_id", "tile")
    listed = catalogue(spark, folder)
    day = F.make_date(F.col("yr"), ((F.col("tile") * 4 + F.col("item_id")) % 12 + 1).cast("int"), F.lit(15))
    vec = F.col("tile") * 4 + F.col("item_id")
    listed = listed.withColumns({"dt": day, "granule_id": F.expr("(tile * 4 + item_id) div 2").cast("string"), "meets": vec % 5 != 0})
    one = F.lit(1.0)
    frames = images.select("tile").distinct().select(
        "tile", F.lit(0.0).alias("w"), F.lit(8.0).alias("n"), one.alias("x_res"), one.alias("y_res"), F.lit(8).alias("height"), F.lit(8).alias("width")
    )
    mid = (4 + F.col("tile") % 3).cast("double")
    point = lambda dx, dy: F.struct((mid + dx).alias("x"), F.lit(4.0 + dy).alias("y"))
    ring = F.array(point(3.75, 0.0), point(0.0, 3.75), point(-3.75, 0.0), point(0.0, -3.75))
    edges = region_edges(frames.select("tile", ring.alias("ring")), keys=("tile",))
    tiles = images.groupBy("tile").agg(F.count_distinct("r", "c").alias("total"))
    spans = tiles.select("tile", F.lit("2024-01-01").cast("date").alias("start"), F.lit("2024-06-30").cast("date").alias("end"))
    ladder = catalog.search_ladder(spans, cloud=1, max_cloud=50, step=5, min_year=2022)
    outside = catalog.outside_words(frames, edges, 8.0, 8)
    return choose_items(listed, images, tiles, 8, ladder, min_share=0.1, max_items=4, max_remaining=0.5, outside=outside)


IMAGES = f"{COVER}, pick AS (SELECT s.* FROM stack s JOIN sel ON s.scene_id=sel.tile AND s.item_id=sel.item_id), norm AS (SELECT scene_id, item_id, r, c, clear, {NORMAL} FROM pick WINDOW w AS (PARTITION BY scene_id, item_id)), " + composite_sql(1)[
    len("WITH "):
].replace("FROM stack", "FROM norm")


@query("e4_acquired_images", IMAGES, ["stack"])
def e4(spark, folder):
    images = stack(spark, folder).withColumnRenamed("scene_id", "tile")
    tiles = images.groupBy("tile").agg(F.count_distinct("r", "c").alias("total"))
    chosen = choose_items(catalogue(spark, folder), images, tiles, 8, LADDER, min_share=0.1, max_items=4, max_remaining=0.5)
    return tile_images(images.drop("clear", "v"), chosen, ("b08", "b04", "b03", "b02"), 1)


@query(
    "e1_training_chips",
    """WITH l AS (SELECT scene_id, r, c, b08, e.v AS elevation, cls FROM bands JOIN relief e USING (scene_id, r, c) JOIN scored USING (scene_id, r, c)),
    k AS (SELECT scene_id, cast(y*2 AS int) AS chip_r0, cast(x*2 AS int) AS chip_c0, cast(r-y*2 AS int) AS r, cast(c-x*2 AS int) AS c, b08, elevation, cls
        FROM l, range(3) a(y), range(3) b(x) WHERE r BETWEEN y*2 AND y*2+3 AND c BETWEEN x*2 AND x*2+3)
    SELECT k.*, CASE WHEN scene_id IN (SELECT r_regionkey FROM region) THEN 'test' ELSE 'train' END AS split FROM k
    WHERE (scene_id, chip_r0, chip_c0) IN (SELECT (scene_id, chip_r0, chip_c0) FROM k GROUP BY scene_id, chip_r0, chip_c0 HAVING avg(CASE WHEN elevation IS NULL THEN 1 ELSE 0 END)<0.1e0)""",
    ["bands", "relief", "scored"],
)
def e1(spark, folder):
    stacked = [
        bands(spark, folder).select("scene_id", "r", "c", "b08"), relief(spark, folder).withColumnRenamed("v", "elevation"),
        scored(spark, folder).drop("prob"),
    ]
    lists = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("scene_id"), F.lit("test").alias("split"))
    return training_chips(stacked, ["b08", "elevation", "cls"], 4, 2, 2, lists=lists, shape=(8, 8))
