"""Long jobs as named stages, each a table in the job's folder that a later run reads instead of building it again."""

from terracell.plans.lineage import saved


def finished(spark, path):
    """Whether a stage's table was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stage(spark, folder, name, build):
    """The table of a stage under ``folder``; ``build`` is called, and its result written, only if it is not finished.

    A stage that was cut off has no end mark, so its remains are overwritten. Without a ``folder`` a stage is a table that goes
    with the driver: later stages read it several times, and their plans would otherwise repeat the whole job so far.
    """
    if folder is None:
        return saved(build(), name)
    path = f"{folder.rstrip('/')}/{name}"
    if not finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
