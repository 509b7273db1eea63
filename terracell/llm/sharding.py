"""Contiguous shards of near equal byte size, from global prefix sums over per-partition totals.

Rows are put in a total order that keeps equal texts together (hash of the text, then id; ties of both are rows that
cannot be told apart). The bytes before a row are those of the partitions before plus those before it in its own
partition, and its shard is the target that its first byte falls into. Rows are whole, so a shard's size differs from
the target by less than one row at either end. One rule holds for all groups of equal texts: they are cut like any rows,
so a hot group cannot unbalance the shards.

Null text counts as empty: its size is the overhead alone. Null ids sort first, repeated rows are rows of their own. An
empty table gives no rows; with fewer rows than shards some shards are empty.
"""

from pyspark.sql import functions as F

from terracell.llm.common import free_name, numbered_by, parallelism, written

OVERHEAD = 16


def shard_by_bytes(docs, shards, id="doc_id", text="text", overhead=OVERHEAD, carry=()):
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null).

    Columns named in ``carry`` are handed on behind these.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("_id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_h"), *[F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)],
    )
    placed = written(numbered_by(rows, ["_h", "size", "text_crc32", "_id"], totals={"_before": "size"}), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    at = F.expr(f"cast(cast(_before as decimal(20,0)) * {shards} div {total} as int)")
    moved = placed.withColumn("shard", F.least(at, F.lit(shards - 1)))
    # shards are runs of the global order, so a row's slot is its rank minus the rank of the shard's first row
    first = moved.groupBy("shard").agg(F.min("_rank").alias("_first"))
    out = moved.join(F.broadcast(first), "shard")  # one row per shard
    return out.select(
        F.col("_id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(docs, shards, path, id="doc_id", text="text", **options):
    """Write the documents as one folder per shard (``_shard``), rows in ``_slot`` order inside each file.

    The documents are written once with a number of their own, by which each finds its shard, so null and repeated ids
    and repeated rows all arrive. Returns the assignment, and the names of the two added columns if those are taken.
    """
    spark = docs.sparkSession
    number, shard, slot = (free_name(docs, c) for c in ("_number", "_shard", "_slot"))
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    assigned = written(shard_by_bytes(numbered, shards, id, text, carry=[number], **options), "assigned")
    own = assigned.select(F.col(number), F.col("shard").alias(shard), F.col("slot").alias(slot))
    span = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(F.col("shard").alias("_of"), "n")
    placed = own.join(F.broadcast(span), F.col(shard) == F.col("_of"))  # one row per shard
    placed = placed.select(number, shard, slot, F.expr(f"`{slot}` * 4 div n").alias("_piece_of_four"))
    both = numbered.join(placed, number).drop(number)
    both = both.repartition(parallelism(spark), shard, "_piece_of_four").sortWithinPartitions(shard, slot).drop("_piece_of_four")
    both.write.partitionBy(shard).parquet(path)
    return assigned.drop(number), shard, slot
