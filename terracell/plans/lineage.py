"""Cutting lineage and finding the shared folder for intermediate tables."""

import re
import tempfile
import uuid


def shared_dir(spark):
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="terracell-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark, name):
    """A fresh path under the shared folder; what is written there goes when the driver ends."""
    home = f"{shared_dir(spark).rstrip('/')}/terracell-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        store.mkdirs(place)
        store.deleteOnExit(place)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def saved(df, name):
    """``df`` written once to the shared folder and read back; the files that its exchanges left go with the job.

    A lost executor replays nothing, and Parquet takes a small part of a checkpoint. Else the files of an exchange stay until the
    driver happens to collect its garbage.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df):
    """Checkpoint ``df`` reliably, so a lost executor never replays the rounds before it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
