"""New scenes, running totals and duplicate acquisitions with Structured Streaming."""

from pyspark.sql import functions as F

from terracell.plans.stages import finished


def process_new(source, transform, sink, checkpoint, key, part=None, time=None, delay=None):
    """Transform arriving rows and append those that nothing before has brought.

    A scene (``key``) may arrive in pieces: ``part`` names the columns of the result that tell its pieces apart (file,
    block, cell), by default all of them. A piece that came before is left out, whether in the same micro-batch or an
    earlier one; a further piece of a known scene is not. Known pieces are keyed state (``key`` and a 64-bit hash of the
    piece) of a second stream over the transformed rows, so a batch costs what it brings and never reads the sink. With
    ``time`` and ``delay`` a piece is forgotten once the watermark has passed it; else state grows with the pieces.

    ``transform`` sees one micro-batch and may aggregate. Each micro-batch overwrites its own folder, so a replayed batch
    after a lost executor or driver leaves one copy. Runs over what is available and stops.
    """
    spark = source.sparkSession
    arrived = f"{checkpoint}/arrived"

    def pieces(batch):
        out = transform(batch)
        return out.withColumn("_piece", F.xxhash64(*(out.columns if part is None else part)))

    def into(folder):
        return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    def run(stream, write, name):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()

    schema = pieces(spark.createDataFrame([], source.schema)).schema
    # a first empty folder: the second stream needs one to look into
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{arrived}/batch=none")
    run(source, lambda batch, batch_id: into(arrived)(pieces(batch), batch_id), "arriving")
    rows = spark.readStream.schema(schema).option("cleanSource", "delete").parquet(f"{arrived}/*")
    if time is None:
        rows = rows.dropDuplicates([key, "_piece"])
    else:
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, "_piece"])
    run(rows, into(sink), "known")
    return spark.read.schema(schema).parquet(sink).drop("batch", "_piece")


def running_totals(source, keys, aggregates, sink, checkpoint):
    """Stateful totals per key while files arrive; the latest row of each key is the result.

    Each micro-batch writes the keys it changed. At the end of a run these rows and the newest snapshot are merged into a
    snapshot of their own, so reading costs one row per key, however many batches there were.
    """
    totals = source.groupBy(*keys).agg(*aggregates)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/updates/batch={batch_id}")

    query = (
        totals.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return compact(source.sparkSession, sink, list(keys), totals.schema)


def _numbered(spark, folder, name, whole=True):
    """Numbers k of the folders ``name=k``, in order; only those written to their end unless ``whole`` is False."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    found = [f for f in (x.getPath().getName() for x in store.listStatus(place)) if f.startswith(f"{name}=")]
    return sorted(int(f.split("=")[1]) for f in found if not whole or finished(spark, f"{folder}/{f}"))


def _drop(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def compact(spark, sink, keys, schema):
    """Merge the updates after the newest snapshot into a new one, and return it.

    A snapshot holds the state up to a batch and counts from the moment its end mark is there, so whoever reads sees the
    one before or the new one, whole. Updates and snapshots go only after a newer snapshot is whole; the last but one
    stays for those who still read it. A run cut off at any point is made good by the next.
    """
    updates, snapshots = f"{sink}/updates", f"{sink}/snapshots"
    whole, batches = _numbered(spark, snapshots, "upto"), _numbered(spark, updates, "batch")
    newest = whole[-1] if whole else -1
    fresh = [k for k in batches if k > newest]
    if fresh:
        at = lambda path, k: spark.read.schema(schema).parquet(path).withColumn("_batch", F.lit(k).cast("long"))
        # one read of all new updates; their folder names give the order
        rows = spark.read.schema(schema).option("basePath", updates).parquet(*[f"{updates}/batch={k}" for k in fresh])
        rows = rows.withColumn("_batch", F.col("batch").cast("long")).drop("batch")
        if whole:
            rows = rows.unionByName(at(f"{snapshots}/upto={newest}", newest))
        values = [c for c in schema.names if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        last = last.select(*keys, *[F.col("_row")[v].alias(v) for v in values])
        last.write.mode("overwrite").parquet(f"{snapshots}/upto={fresh[-1]}")
        whole.append(fresh[-1])
        newest = fresh[-1]
    for k in _numbered(spark, snapshots, "upto", whole=False):
        if k < newest and k not in whole[-2:]:
            _drop(spark, f"{snapshots}/upto={k}")
    for k in batches:
        if k <= newest:
            _drop(spark, f"{updates}/batch={k}")
    if newest < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{snapshots}/upto={newest}")


def first_acquisitions(source, time, delay, key):
    """Drop repeats of a granule that arrive within the watermark."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_available(stream, sink, checkpoint):
    """Write a stream's available rows to a Parquet folder with the exactly-once file sink."""
    query = (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)
