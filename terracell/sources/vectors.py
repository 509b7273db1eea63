"""Hydrography features and region hulls."""

from functools import reduce

from pyspark.sql import functions as F

from terracell.functions.names import padded_key

ATTRIBUTES = ("visibilityfilter", "ftype", "fcode", "fcode_description")


def union_layers(layers, extra=("geometry",)):
    """Layers of one region as one table, five columns kept."""
    columns = [*ATTRIBUTES, *extra]
    return reduce(lambda a, b: a.unionByName(b), [layer.select(*columns) for layer in layers])


def write_features(features, path, mode="append"):
    """One directory per region key; a large region is spread over several tasks by a hash of its rows."""
    dealt = features.withColumn("_h", F.xxhash64(*features.columns)).repartitionByRange("region_key", "_h").drop("_h")
    dealt.write.mode(mode).partitionBy("region_key").parquet(path)


def region_hulls(hulls, regions_with_data, code="huc4"):
    """Hulls of regions that have features, with the integer index next to the code, in index order."""
    indexed = hulls.withColumn("region_id", F.col(code).cast("int")).withColumnRenamed(code, "region_key")
    return indexed.join(regions_with_data.select("region_key"), "region_key", "left_semi").orderBy("region_id")


def write_hulls(hulls, whole_path, parts_path, mode="overwrite"):
    hulls.write.mode(mode).parquet(whole_path)
    hulls.repartitionByRange("region_id").sortWithinPartitions("region_id").write.mode(mode).partitionBy("region_key").parquet(parts_path)


def region(table, index):
    """Rows of one region; the key is the partition column, so only its directory is read."""
    return table.filter(F.col("region_key") == F.lit(f"{int(index):04d}"))


def has_region(table, index):
    return not region(table, index).isEmpty()


def look_up(indices, table, index="region_id"):
    """Many point lookups at once: every index with its padded key and whether the table has it."""
    present = table.select("region_key").distinct().withColumn("found", F.lit(True))
    keyed = indices.withColumn("region_key", padded_key(F.col(index)))
    return keyed.join(present, "region_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def convert_if_absent(df, path):
    """Store a vector table as Parquet unless it is there already."""
    df.write.mode("ignore").parquet(path)


def countries(boundaries, continent, column="continent"):
    return boundaries.filter(F.lower(column) == continent.lower())
