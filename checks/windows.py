"""N: neighbourhood and history windows."""

from pyspark.sql import functions as F

from checks.base import history, mark, query, r6s, relief, scored, stack, table
from checks.aggregates import composite_sql
from terracell.operators import blocks, catalog, composite, logs, neighbourhood as N, splits

SLOPES = """WITH x AS (SELECT *, lag(v) OVER a AS wv, lead(v) OVER a AS ev, lag(c) OVER a AS wc, lead(c) OVER a AS ec,
    lag(v) OVER b AS nv, lead(v) OVER b AS sv, lag(r) OVER b AS nr, lead(r) OVER b AS sr FROM relief
    WINDOW a AS (PARTITION BY scene_id, r ORDER BY c), b AS (PARTITION BY scene_id, c ORDER BY r)),
s AS (SELECT scene_id, r, c, CASE WHEN v IS NULL THEN NULL WHEN wc IS NULL AND ec IS NULL THEN 0e0 WHEN wc IS NULL THEN ev-v WHEN ec IS NULL THEN v-wv ELSE (ev-wv)/2e0 END AS x_slope,
    CASE WHEN v IS NULL THEN NULL WHEN nr IS NULL AND sr IS NULL THEN 0e0 WHEN nr IS NULL THEN v-sv WHEN sr IS NULL THEN nv-v ELSE (nv-sv)/2e0 END AS y_slope FROM x)"""


@query("n1_slopes", f"{SLOPES} SELECT scene_id, r, c, round(x_slope,6)+0e0 AS x_slope, round(y_slope,6)+0e0 AS y_slope FROM s", ["relief"])
def n1(spark, folder):
    return r6s(N.slopes(relief(spark, folder), ["scene_id"]).drop("v", "gradient"), "x_slope", "y_slope")


@query("n1_slopes_on_blocks", f"{SLOPES} SELECT scene_id, r, c, round(x_slope,6)+0e0 AS x_slope, round(y_slope,6)+0e0 AS y_slope FROM s", ["relief"])
def n1_blocks(spark, folder):
    of_relief = blocks.to_blocks(relief(spark, folder), ["scene_id"], ["v"], block=12)
    out = blocks.slopes(of_relief, ["scene_id"], block=12)
    return r6s(blocks.to_cells(out, ["scene_id"], ["x_slope", "y_slope"], block=12), "x_slope", "y_slope")


@query("n2_gradient", f"{SLOPES} SELECT scene_id, r, c, round(sqrt(x_slope*x_slope+y_slope*y_slope),6)+0e0 AS gradient FROM s", ["relief"])
def n2(spark, folder):
    return r6s(N.slopes(relief(spark, folder), ["scene_id"]).drop("v", "x_slope", "y_slope"), "gradient")


def mask_sql(n, tail):
    return composite_sql(n).split("SELECT scene_id, r, c, cast(")[0] + tail


KEYS = ["scene_id", "item_id"]


@query("n3_cloud_edges", mask_sql(1, "SELECT scene_id, item_id, r, c, edge FROM ed"), ["stack"])
def n3(spark, folder):
    return N.cloud_edges(stack(spark, folder), KEYS).select(*KEYS, "r", "c", "edge")


@query("n4_grown_clouds", mask_sql(2, "SELECT scene_id, item_id, r, c, dil AS clear_grown FROM gr"), ["stack"])
def n4(spark, folder):
    return N.grown_cloud_mask(stack(spark, folder), KEYS, 2).select(*KEYS, "r", "c", "clear_grown")


WIDE_EDGE = """WITH k AS (SELECT o_orderkey//1024 AS scene_id, cast((o_orderkey%1024)//32 AS int) AS r, cast(o_orderkey%32 AS int) AS c, CASE WHEN o_custkey%211=0 THEN 1 ELSE 0 END AS flag FROM orders),
    h AS (SELECT *, max(flag) OVER (PARTITION BY scene_id, r ORDER BY c RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS hx FROM k)
    SELECT scene_id, r, c, max(hx) OVER (PARTITION BY scene_id, c ORDER BY r RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near FROM h"""


@query("n4_wide_dilation", WIDE_EDGE)
def n4_wide(spark, folder):
    key = F.col("o_orderkey")
    df = table(spark, folder, "orders").select(
        F.expr("o_orderkey div 1024").alias("scene_id"), F.floor((key % 1024) / 32).cast("int").alias("r"), (key % 32).cast("int").alias("c"),
        F.when(F.col("o_custkey") % 211 == 0, 1).otherwise(0).alias("flag"),
    )
    return N.without_halo(N.dilate_flag(N.with_halo(df, ["scene_id"], 20), ["scene_id"], "flag", 20, "near"), 20).drop("flag")


@query("n5_arbitrated_weights", mask_sql(1, "SELECT scene_id, item_id, r, c, w AS weight FROM wt"), ["stack"])
def n5(spark, folder):
    grown = N.grown_cloud_mask(stack(spark, folder), KEYS, 1)
    return composite.arbitrated_weights(grown).select(*KEYS, "r", "c", "weight")


@query(
    "n6_square_any",
    """WITH h AS (SELECT *, max(t) OVER (PARTITION BY scene_id, r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hx FROM marked)
    SELECT scene_id, r, c, max(hx) OVER (PARTITION BY scene_id, c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h""",
    ["marked"],
)
def n6(spark, folder):
    return N.box_extreme(mark(scored(spark, folder)), ["scene_id"], "t", 1, "near").select("scene_id", "r", "c", "near")


@query(
    "n7_trailing_summary",
    """WITH n AS (SELECT *, row_number() OVER w AS rn, max(m) OVER w AS best, avg(m) OVER (PARTITION BY model ORDER BY step ROWS 4 PRECEDING) AS p5,
        avg(m) OVER (PARTITION BY model ORDER BY step ROWS 9 PRECEDING) AS p10 FROM history WINDOW w AS (PARTITION BY model ORDER BY step))
    SELECT model, step, rn, m AS p1, round(CASE WHEN rn>=5 THEN p5 END,6) AS p5, round(CASE WHEN rn>=11 THEN p10 END,6) AS p10, best FROM n""",
    ["history"],
)
def n7(spark, folder):
    return r6s(logs.trailing_summary(history(spark, folder), ["model"], "step", "m"), "p5", "p10")


@query("n8_new_best", "SELECT model, step, m, max(m) OVER w AS best, m=max(m) OVER w AS is_best FROM history WINDOW w AS (PARTITION BY model ORDER BY step)", ["history"])
def n8(spark, folder):
    return logs.new_best(history(spark, folder), ["model"], "step", "m")


@query(
    "n9_bad_streak",
    """WITH b AS (SELECT *, row_number() OVER w AS rn, m=max(m) OVER w AS is_best FROM history WINDOW w AS (PARTITION BY model ORDER BY step)),
    l AS (SELECT *, rn-max(CASE WHEN is_best THEN rn END) OVER (PARTITION BY model ORDER BY rn) AS streak FROM b)
    SELECT model, step, streak, streak%16 AS bad_epochs, streak//16 AS plateaus FROM l""",
    ["history"],
)
def n9(spark, folder):
    out = logs.bad_streak(history(spark, folder), ["model"], "step", "m", 15)
    return out.select("model", "step", "streak", "bad_epochs", "plateaus")


@query(
    "n9_metric_history",
    """WITH b AS (SELECT *, row_number() OVER w AS rn, min(m) OVER w AS best, avg(m) OVER (PARTITION BY model ORDER BY step ROWS 4 PRECEDING) AS p5,
        avg(m) OVER (PARTITION BY model ORDER BY step ROWS 9 PRECEDING) AS p10 FROM history WINDOW w AS (PARTITION BY model ORDER BY step)),
    l AS (SELECT *, rn-max(CASE WHEN m=best THEN rn END) OVER (PARTITION BY model ORDER BY rn) AS streak FROM b)
    SELECT model, step, m, rn, round(CASE WHEN rn>=5 THEN p5 END,6) AS p5, round(CASE WHEN rn>=11 THEN p10 END,6) AS p10, best, m=best AS is_best,
        streak, streak%4 AS bad_epochs, streak//4 AS plateaus FROM l""",
    ["history"],
)
def n9_history(spark, folder):
    # segments of a few entries, so that the summaries carry what the views need
    return r6s(logs.metric_history(history(spark, folder), ["model"], "step", "m", mode="min", patience=3, segment=500), "p5", "p10")


@query(
    "n10_epoch_paging",
    """WITH e AS (SELECT cast(epoch AS int) AS epoch, c_custkey, ((c_custkey*2654435761+5*40503)%1000003*(epoch*2+1))%1000003 AS h FROM customer, range(3) a(epoch)),
    p AS (SELECT epoch, c_custkey, epoch*count(*) OVER (PARTITION BY epoch)+row_number() OVER (PARTITION BY epoch ORDER BY h, c_custkey)-1 AS position FROM e)
    SELECT epoch, c_custkey, position, position//500 AS load FROM p""",
)
def n10(spark, folder):
    return splits.paged(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 3, 500, seed=5)


@query(
    "n11_coverage_gain",
    """WITH k AS (SELECT *, max(clear) OVER (PARTITION BY scene_id, r, c ORDER BY item_id) AS seen FROM stack),
    g AS (SELECT scene_id AS tile, item_id, sum(seen) AS n, count(*) AS total FROM k GROUP BY ALL)
    SELECT tile, item_id, cast(n-coalesce(lag(n) OVER (PARTITION BY tile ORDER BY item_id),0) AS bigint) AS new_cells,
    round((n-coalesce(lag(n) OVER (PARTITION BY tile ORDER BY item_id),0))/cast(total AS double),6) AS gain FROM g""",
    ["stack"],
)
def n11(spark, folder):
    df = stack(spark, folder).select(F.col("scene_id").alias("tile"), "item_id", F.col("item_id").alias("place"), "r", "c", "clear")
    return r6s(catalog.coverage_gain(df, "place").drop("place"), "gain")
