"""Hold-out regions, sampled lists and paging of shuffled lists."""

from pyspark.sql import functions as F

from terracell.functions.hashing import MODULUS, sample_hash
from terracell.plans.skew import numbered


def holdout_regions(regions, seed=0, region="region_id", per=100):
    """One region of each hundred, by least hash (ties by id)."""
    r = F.col(region)
    return (
        regions.groupBy(F.floor(r / per).cast("int").alias("region_group"))
        .agg(F.min(F.struct(sample_hash(r, seed).alias("h"), r.alias("id"))).alias("_pick"))
        .select("region_group", F.col("_pick.id").alias(region))
    )


def chips_of_regions(pairs, regions, region="region_id", file="file_name"):
    """Distinct chips that meet any of the regions."""
    return pairs.join(regions.select(region), region, "left_semi").select(file).distinct()


def route(chips, lists, on="file_name"):
    """Chips with the split of their grid; those on no list are training chips."""
    return chips.join(lists, on, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def shuffled(df, key, seed=0):
    """Deterministic shuffle: a global sort by hash, then key."""
    return df.withColumn("h", sample_hash(F.col(key), seed)).orderBy("h", key)


def sample_first(df, key, k, seed=0, exclude=None):
    """The first ``k`` of the shuffled rows not in ``exclude``."""
    rest = df if exclude is None else df.join(exclude.select(key), key, "left_anti")
    return shuffled(rest, key, seed).limit(k)


def keep_sample(df, key, share, seed=0):
    """A fixed share of rows kept for inspection."""
    return df.filter(sample_hash(F.col(key), seed) < int(share * MODULUS))


def paged(df, key, epochs, per_load, seed=0):
    """Shuffled list per epoch, cut into loads of ``per_load`` that run on across epochs.

    Positions come from the two-level numbering over hash ranges, not from one global sort task; an
    epoch has about ten thousand ranges.
    """
    spread_out = df.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), key)
    # the epoch takes part in the hash, so each epoch has its own order
    spread_out = spread_out.withColumn("h", (sample_hash(F.col(key), seed) * (F.col("epoch") * 2 + 1)) % MODULUS)
    placed = numbered(spread_out, ["epoch"], "h", MODULUS // 10_000, tie=(key,))
    sizes = spread_out.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    position = F.col("epoch") * F.col("_n") + F.col("rn") - 1
    return placed.join(sizes, "epoch").select(
        "epoch", key, position.alias("position"), F.floor(position / per_load).cast("long").alias("load")
    )
