"""X: incremental processing."""

from pyspark.sql import functions as F

from checks.base import query, table
from terracell.operators.metrics import confusion_columns
from terracell.plans.lineage import scratch_path
from terracell.streaming import incremental


def stream(spark, folder, name):
    """The table as a stream of files; the trailing pattern makes the single file a file source."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}*.parquet")


@query(
    "x1_new_scenes_once",
    "SELECT vec_id//5 AS scene_id, vec_id AS row_id, label, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))),6)+0e0 AS total FROM embeddings",
)
def x1(spark, folder):
    # rows of one scene come in several files, some of them twice, in one batch or in two
    rows = table(spark, folder, "embeddings")
    path = scratch_path(spark, "arrivals")
    for k in (0, 0, 1, 2, 1):
        rows.filter((F.col("vec_id") % 3 == k) | (F.col("vec_id") % 7 == 0)).coalesce(1).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = incremental.process_new(
        arriving,
        lambda df: df.select(F.expr("vec_id div 5").alias("scene_id"), F.col("vec_id").alias("row_id"), "label", (F.round(total, 6) + 0.0).alias("total")),
        scratch_path(spark, "scenes"), scratch_path(spark, "scenes-progress"), "scene_id",
    )
    return out


@query(
    "x3_running_totals",
    """SELECT l_suppkey AS img, count(*) FILTER (p=t) AS num_correct, count(*) FILTER (p=1) AS num_model_one, count(*) FILTER (t=1) AS num_target_one,
    count(*) FILTER (p=1 AND t=1) AS num_one_correct, count(*) FILTER (p<>t) AS num_wrong
    FROM (SELECT l_suppkey, CASE WHEN l_discount*10>=0.5 THEN 1 ELSE 0 END AS p, CASE WHEN cast(l_quantity AS int)%23>0 THEN 1 ELSE 0 END AS t FROM lineitem) GROUP BY l_suppkey""",
)
def x3(spark, folder):
    rows = stream(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("img"), F.when(F.col("l_discount") * 10 >= 0.5, 1).otherwise(0).alias("p"),
        F.when(F.col("l_quantity").cast("int") % 23 > 0, 1).otherwise(0).alias("t"),
    )
    return incremental.running_totals(rows, ["img"], confusion_columns(), scratch_path(spark, "totals"), scratch_path(spark, "totals-progress"))


@query("x4_first_acquisitions", "SELECT DISTINCT concat(user_id, '-', event_type) AS granule_id FROM events")
def x4(spark, folder):
    rows = stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("granule_id")
    )
    first = incremental.first_acquisitions(rows, "ts", "60 days", "granule_id")
    return incremental.append_available(first.select("granule_id"), scratch_path(spark, "granules"), scratch_path(spark, "granules-progress"))
