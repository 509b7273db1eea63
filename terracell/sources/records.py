"""Split lists, training logs and evaluation tables."""

from pyspark.sql import functions as F


def write_split_lists(chips, directory, mode="overwrite"):
    """One folder of text files per split."""
    chips.select("split", F.col("file_name").alias("value")).write.mode(mode).partitionBy("split").text(directory)


def read_split_lists(spark, directory):
    lines = spark.read.text(directory).filter(F.col("value") != "")
    return lines.select(F.col("value").alias("file_name"), "split")


def keep_listed(chips, pruned, on="file_name"):
    """Chips named by a saved list."""
    return chips.join(pruned.select(on), on, "left_semi")


def log_rows(losses, keys, metric, value, model, metrics):
    """Long metric entries to one row per save with ``{model}_{metric}`` columns."""
    picked = [F.avg(F.when(F.col(metric) == m, F.col(value))).alias(f"{model}_{m}") for m in metrics]
    return losses.groupBy(*keys).agg(*picked)


def append_log(rows, path):
    rows.write.mode("append").partitionBy("epoch").option("header", "true").csv(path)


def read_log(spark, path, schema):
    return spark.read.schema(schema).option("header", "true").csv(path)


def _one_per_key(rows, on):
    """The largest row of each key."""
    others = [c for c in rows.columns if c != on]
    best = rows.groupBy(on).agg(F.max(F.struct(*others)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) if c != on else F.col(on) for c in rows.columns])


def _exists(spark, path):
    """Whether ``path`` is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def extended(old, new, on="file_name"):
    """Stored rows plus one new row for each key that is not stored yet; columns may differ."""
    fresh = _one_per_key(new, on).join(old.select(on).distinct(), on, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def append_stats(spark, new, path, on="file_name"):
    """Extend an evaluation table on disk; a restart adds only images not scored yet, each once."""
    new = _one_per_key(new, on)
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(on).distinct(), on, "left_anti")
    new.write.mode("append").parquet(path)
