"""Colour normalisation and cloud-free composites of acquisition stacks."""

from pyspark.sql import functions as F

from terracell.functions import bands as B
from terracell.operators.neighbourhood import grown_cloud_mask
from terracell.plans.skew import attach_stats


def band_statistics(images, keys, bands, scl="scl"):
    """Masked mean and population deviation per image and band; zeros and unclear cells are left out."""
    usable = lambda b: F.when((B.clear_mask(F.col(scl)) == 1) & (F.col(b) > 0), F.col(b).cast("double"))
    return images.groupBy(*keys).agg(
        *[F.avg(usable(b)).alias(f"{b}_mean") for b in bands],
        *[F.stddev_pop(usable(b)).alias(f"{b}_std") for b in bands],
    )


def normalise(images, keys, bands, scl="scl"):
    """Centre each image's bands on their clear-sky mean and stretch them to 0..255."""
    usable = lambda b: F.when((B.clear_mask(F.col(scl)) == 1) & (F.col(b) > 0), F.col(b).cast("double"))
    aggregates = [f(usable(b)).alias(f"_{b}_{n}") for b in bands for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = attach_stats(images, keys, aggregates)
    stretched = {
        b: B.logistic_stretch(
            B.z_score(F.when(F.col(b) > 0, F.col(b).cast("double")), F.col(f"_{b}_m"), F.col(f"_{b}_s"))
        )
        for b in bands
    }
    return out.withColumns(stretched).drop(*[f"_{b}_{n}" for b in bands for n in "ms"])


def mask_tier(clear="clear", grown="clear_grown"):
    """2 where clear after growing the clouds, 1 where only the plain mask is clear, 0 elsewhere."""
    return F.col(clear) + F.col(grown)


def arbitrated_weights(masked, keys=("scene_id",)):
    """Weight of each acquisition at each cell: 1 for those of the best tier met there, else 0.

    So the grown mask counts where any acquisition passes it, else the plain mask, else every acquisition.
    """
    cell = [*keys, "r", "c"]
    best = masked.groupBy(*cell).agg(F.max(mask_tier()).alias("_best"))
    return masked.join(best, cell).withColumn("weight", (mask_tier() == F.col("_best")).cast("int")).drop("_best")


def composite(images, bands, n, keys=("scene_id",), time="item_id", scl="scl"):
    """Cloud-masked temporal mean of every band, truncated to whole numbers.

    Acquisitions of one cell are averaged per tier of the mask and the best tier is kept, so no window
    over time is needed and both aggregations combine before their exchange. A scene with one acquisition
    has only one tier and is passed through.
    """
    keys = list(keys)
    kept = images.select(*keys, time, "r", "c", *bands, B.clear_mask(F.col(scl)).alias("clear"))
    masked = grown_cloud_mask(kept, [*keys, time], n)
    seen = lambda b: F.when(F.col(b) != 0, F.col(b))
    per_tier = masked.groupBy(*keys, "r", "c", mask_tier().alias("_tier")).agg(
        *[f(seen(b)).alias(f"_{b}_{name}") for b in bands for name, f in (("s", F.sum), ("n", F.count))]
    )
    mean = lambda b: F.coalesce(F.try_divide(F.col(f"_{b}_s").cast("double"), F.col(f"_{b}_n")), F.lit(0.0))
    means = per_tier.select(*keys, "r", "c", "_tier", *[B.uint8(mean(b)).alias(b) for b in bands])
    return means.groupBy(*keys, "r", "c").agg(*[F.max_by(b, "_tier").alias(b) for b in bands])


def zero_report(images, keys, bands):
    """Rows, columns, cells, all-zero cells and their share per image."""
    total = sum((F.coalesce(F.col(b), F.lit(0)) for b in bands), F.lit(0))
    grouped = images.groupBy(*keys).agg(
        (F.max("r") + 1).alias("num_rows"), (F.max("c") + 1).alias("num_cols"),
        F.count_if(total == 0).alias("num_zero"),
    )
    return grouped.withColumn(
        "total", F.col("num_rows").cast("long") * F.col("num_cols")
    ).withColumn("zero_percent", F.col("num_zero") / F.col("total"))


def zero_order(images, keys, bands):
    """Rough image score: number of zero values over all bands, best first."""
    zeros = sum((F.when(F.col(b) == 0, 1).otherwise(0) for b in bands), F.lit(0))
    return images.groupBy(*keys).agg(F.sum(zeros).alias("zeros")).orderBy("zeros", *keys)
