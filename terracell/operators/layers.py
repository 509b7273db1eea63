"""Joining, cleaning and filling the layers of a chip."""

from pyspark.sql import functions as F

from terracell.functions import bands as B
from terracell.plans.skew import attach_stats, join_patches, patch_extent

CELL = ("scene_id", "r", "c")


def training_layers(layers, on=CELL):
    """Inner join of all layers on the cell; a scene lacking a layer disappears."""
    first, *rest = layers
    for layer in rest:
        first = first.join(layer, list(on))
    return first


def deployment_layers(image, elevation, on=CELL):
    """Outer join on the cell; what one layer lacks is missing rather than dropped."""
    return image.join(elevation, list(on), "full")


def mask_image(df, bands):
    """All bands missing where the image has no data."""
    valid = B.has_image(*[F.col(b) for b in bands])
    return df.withColumns({b: F.when(valid, F.col(b)) for b in bands})


def rebase(df, keys, value="v", scale=1.0):
    """Subtract the least valid value of each raster; optionally divide by ``scale``."""
    out = attach_stats(df, keys, [F.min(value).alias("_least")])
    return out.withColumn(value, (F.col(value) - F.col("_least")) / F.lit(float(scale))).drop("_least")


def is_value(value):
    """Neither missing nor NaN nor infinite."""
    x = F.col(value).cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def missing_share(cells, keys, value="v", area=None):
    """Share of missing cells per chip and layer.

    ``area`` is the number of cells that a chip has; a cell without a row is then missing like one without
    a value. Without it the chip's rows are taken as its area.
    """
    area = F.count(F.lit(1)) if area is None else F.lit(area)
    return cells.groupBy(*keys).agg((1 - F.count_if(is_value(value)) / area).alias("missing_share"))


def tolerated_chips(cells, chip_keys, layer="layer", value="v", limit=0.1, area=None):
    """Chips none of whose layers lacks ``limit`` or more of its cells."""
    shares = missing_share(cells, [*chip_keys, layer], value, area)
    return shares.groupBy(*chip_keys).agg(F.bool_and(F.col("missing_share") < limit).alias("ok")).filter("ok").drop("ok")


def drop_missing_chips(cells, chip_keys, values):
    """Remove whole chips that hold a missing or infinite value."""
    bad = F.lit(False)
    for v in values:
        x = F.col(v).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    bad_chips = cells.groupBy(*chip_keys).agg(F.bool_or(bad).alias("_bad"), *patch_extent()).filter("_bad").drop("_bad")
    return join_patches(cells, bad_chips, chip_keys, "left_anti")


def drop_odd_sized_chips(cells, chip_keys, side):
    """Remove whole chips that are not ``side`` x ``side``, or that lack a cell."""
    size = cells.groupBy(*chip_keys).agg(
        (F.max("r") - F.min("r") + 1).alias("_h"), (F.max("c") - F.min("c") + 1).alias("_w"), F.count_distinct("r", "c").alias("_n"), *patch_extent()
    )
    whole = size.filter((F.col("_h") == side) & (F.col("_w") == side) & (F.col("_n") == side * side)).drop("_h", "_w", "_n")
    return join_patches(cells, whole, chip_keys, "left_semi")


def impute(cells, chip_keys, channel="channel", value="v", limit=0.5):
    """Fill missing values by their channel's mean (0 if the channel is empty).

    Only chips with less than ``limit`` of all their values missing are filled.
    """
    channels = cells.groupBy(*chip_keys, channel).agg(
        F.avg(value).alias("_mean"), F.count(value).alias("_have"), F.count(F.lit(1)).alias("_all"),
        *patch_extent(),
    )
    chips = channels.groupBy(*chip_keys).agg((1 - F.sum("_have") / F.sum("_all")).alias("_gone"))
    fill = channels.join(chips, list(chip_keys)).select(
        *chip_keys, channel, F.when(F.col("_gone") < limit, F.coalesce("_mean", F.lit(0.0))).alias("_fill"),
        "_r0", "_r1", "_c0", "_c1",
    )
    out = join_patches(cells, fill, [*chip_keys, channel])
    return out.withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def merge_labels(*rasters, on=CELL, value="v"):
    """Larger class of any raster holding the cell."""
    first, *rest = rasters
    for raster in rest:
        first = first.unionByName(raster)
    return first.groupBy(*on).agg(F.max(value).alias(value))
