"""Turned copies and random removal for training chips."""

from pyspark.sql import functions as F

from terracell.functions.affine import turned
from terracell.functions.hashing import sample_hash
from terracell.plans.skew import attach_stats


def turn(cells, height, width, how):
    """Whole-raster quarter turn or flip as an index map."""
    new = turned(F.col("r"), F.col("c"), height, width, how)
    return cells.withColumns({"r": new["r"], "c": new["c"]})


def position_hash(channel, r, c, seed):
    """Integer hash of a position; the same for every image."""
    return sample_hash(channel * 1000003 % 65521 * 4096 + r * 73 + c, seed)


def remove_positions(cells, image_keys, channel="channel", value="v", label_channel=None, percent=25, seed=0):
    """Replace a fixed share of (channel, r, c) positions by their channel mean, labels excepted."""
    out = attach_stats(cells, [*image_keys, channel], [F.avg(value).alias("_mean")])
    chosen = position_hash(F.col(channel), F.col("r"), F.col("c"), seed) % 100 < percent
    if label_channel is not None:
        chosen = chosen & (F.col(channel) != label_channel)
    return out.withColumn(value, F.when(chosen, F.col("_mean")).otherwise(F.col(value).cast("double"))).drop("_mean")


def augmented(cells, image_keys, height, width, how, channel="channel", value="v", label_channel=None, seed=0):
    """The originals, one turned copy and one copy with removed positions, told apart by ``copy``."""
    plain = cells.withColumn(value, F.col(value).cast("double"))
    removed = remove_positions(cells, image_keys, channel, value, label_channel, seed=seed)
    return (
        plain.withColumn("copy", F.lit(0))
        .unionByName(turn(plain, height, width, how).withColumn("copy", F.lit(1)))
        .unionByName(removed.withColumn("copy", F.lit(2)))
    )
