"""Summaries of metric histories and of the model registry."""

from pyspark.sql import Window
from pyspark.sql import functions as F

SEGMENT = 1_000_000


def metric_history(history, keys, step, value, mode="max", patience=0, segment=SEGMENT):
    """Everything the log views say about an entry, from one pass over the history.

    Adds ``rn`` (place of the entry), ``p5`` and ``p10`` (means of the last 5, from 5 entries on, and 10, from 11 on),
    ``best`` so far, ``is_best`` (at least as good as all before), ``streak`` (entries since the last best), ``bad_epochs``
    and ``plateaus`` (how often the patience ran out in that stretch).

    A key's steps are cut into segments. What a segment tells those after it is small and can be merged in order: its
    count, its best value with the last place that has it, and its last nine entries. Only these summaries meet per key.
    A missing value is never best and is left out of the means; entries without a key or a step are left out.
    """
    keys = list(keys)
    sign = 1 if mode == "max" else -1
    seg = [*keys, "_seg"]
    cut = history.withColumn("_seg", F.floor(F.col(step) / F.lit(segment)).cast("long"))
    line = Window.partitionBy(*seg).orderBy(step, value)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    # the last place of the best value is the greatest pair of value and place
    ranked = F.when(F.col(value).isNotNull(), F.struct((F.col(value) * sign).alias("x"), F.col("_local").alias("at")))
    cut = cut.withColumn("_local", F.row_number().over(line).cast("long"))
    last_ten = F.collect_list(F.struct(F.col(value).alias("x"))).over(line.rowsBetween(-9, 0))
    inside = {f"_p{k}": F.avg(value).over(line.rowsBetween(1 - k, 0)) for k in (5, 10)}
    cut = cut.withColumns({"_run": F.max(ranked).over(so_far), "_ten": last_ten, **inside})

    sums = cut.groupBy(*seg).agg(F.max("_local").alias("_n"), F.max("_run").alias("_top"), F.max_by("_ten", "_local").alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = F.when(F.col("_top").isNotNull(), F.struct(F.col("_top.x"), (F.col("_top.at") + F.col("_offset")).alias("at")))
    # nine segments hold at least nine entries
    tail = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-9, -1)))
    sums = sums.select(*seg, "_offset", F.max(placed).over(before).alias("_before"), F.slice(tail, F.greatest(F.size(tail) - 8, F.lit(1)), F.lit(9)).alias("_tail"))

    out = cut.join(sums, seg).withColumn("rn", F.col("_offset") + F.col("_local"))
    run = F.when(F.col("_run").isNotNull(), F.struct(F.col("_run.x"), (F.col("_run.at") + F.col("_offset")).alias("at")))
    out = out.withColumn("_best", F.greatest(run, "_before"))

    def mean(k):
        # only the first entries of a segment look back into the ones before
        near = F.concat("_tail", "_ten")
        known = F.filter(F.transform(F.slice(near, F.greatest(F.size(near) - (k - 1), F.lit(1)), F.lit(k)), lambda e: e["x"]), lambda x: x.isNotNull())
        across = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
        return F.when(F.col("_local") >= k, F.col(f"_p{k}")).otherwise(across)

    streak = F.col("rn") - F.col("_best.at")
    return out.withColumns(
        {
            "p5": F.when(F.col("rn") >= 5, mean(5)), "p10": F.when(F.col("rn") >= 11, mean(10)), "best": F.col("_best.x") * sign,
            "is_best": F.col(value) * sign == F.col("_best.x"), "streak": streak, "bad_epochs": streak % (patience + 1),
            "plateaus": F.floor(streak / (patience + 1)).cast("long"),
        }
    ).drop("_seg", "_local", "_run", "_ten", "_offset", "_before", "_tail", "_best", "_p5", "_p10")


def trailing_summary(history, keys, step, value, mode="max", segment=SEGMENT):
    """Last value, means of the last 5 (from 5 entries on) and 10 (from 11 on) and the best so far."""
    rows = metric_history(history, keys, step, value, mode, segment=segment)
    return rows.select(*keys, step, "rn", F.col(value).alias("p1"), "p5", "p10", "best")


def new_best(history, keys, step, value, mode="max", segment=SEGMENT):
    """Flag entries at least as good as all before them."""
    rows = metric_history(history, keys, step, value, mode, segment=segment)
    return rows.select(*history.columns, "best", "is_best")


def bad_streak(history, keys, step, value, patience, mode="max", segment=SEGMENT):
    """Entries since the last best and how many times the patience ran out in that stretch."""
    rows = metric_history(history, keys, step, value, mode, patience, segment)
    return rows.drop("p5", "p10")


def metric_means(log, metrics, by=()):
    """Mean of every metric, missing values left out."""
    return log.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def newest_checkpoint(registry, keys=("model_name",)):
    """Checkpoint with the latest time in the highest epoch of the highest model number."""
    order = F.struct("model_number", "epoch", "mtime", "checkpoint")
    return registry.groupBy(*keys).agg(F.max(order).alias("_o")).select(
        *keys, F.col("_o.model_number"), F.col("_o.epoch"), F.col("_o.checkpoint")
    )
