"""Joins and running totals that stay even when one key holds much of the data."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

SALTS = 16
PATCH = 512
PAIRS = 4_000_000


def _salt(columns, salts):
    # derived from the row, not from its position: a replayed task gives the same salt
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(big, small, keys, how="inner", salts=SALTS, salt_on=None):
    """Join ``big`` to ``small`` on coarse ``keys`` whose rows in ``big`` may be very uneven.

    ``small`` is repeated once per salt, so a hot key is spread over ``salts`` tasks, which adaptive
    execution splits further when they stay too large. No side is forced to broadcast; Spark may still
    choose to when the measured size allows it. ``how`` may be ``inner``, ``left``, ``left_semi`` or
    ``left_anti``. For cells use :func:`join_patches`.
    """
    keys = list(keys)
    salt_on = list(salt_on or [c for c in big.columns if c not in keys] or keys)
    left = big.withColumn("_salt", _salt(salt_on, salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def patch_range(low, high, axis):
    """Columns ``_r0``, ``_r1`` (or ``_c0``, ``_c1``): first and last patch between two cell indices."""
    index = lambda x: F.floor(x / PATCH).cast("int")
    return index(low).alias(f"_{axis}0"), index(high).alias(f"_{axis}1")


def patch_extent():
    """Aggregates giving the patches a group of cells covers."""
    return [*patch_range(F.min("r"), F.max("r"), "r"), *patch_range(F.min("c"), F.max("c"), "c")]


def join_patches(cells, rows, keys, how="inner"):
    """Join cells to one or more rows per raster without gathering a raster in one task.

    A patch of ``PATCH`` x ``PATCH`` cells becomes part of the join key. ``rows`` carries the patch ranges
    ``_r0``, ``_r1``, ``_c0``, ``_c1`` and is repeated once per patch, so a join key never has more cells
    than a patch, however large the raster, and small rasters are not repeated at all.
    """
    spread = rows.withColumn("_pr", F.explode(F.sequence("_r0", "_r1"))).withColumn("_pc", F.explode(F.sequence("_c0", "_c1")))
    spread = spread.drop("_r0", "_r1", "_c0", "_c1")
    index = lambda axis: F.floor(F.col(axis) / PATCH).cast("int")
    placed = cells.withColumns({"_pr": index("r"), "_pc": index("c")})
    return placed.join(spread, [*keys, "_pr", "_pc"], how).drop("_pr", "_pc")


def join_scenes(cells, scenes, keys=("scene_id",)):
    """Cells joined to raster metadata that has ``height`` and ``width``."""
    ranges = [*patch_range(F.lit(0), F.col("height") - 1, "r"), *patch_range(F.lit(0), F.col("width") - 1, "c")]
    return join_patches(cells, scenes.select("*", *ranges), keys)


def attach_stats(df, keys, aggregates):
    """Add per-group aggregates to every row without sorting a whole group in one task.

    The aggregation combines on the map side first; the one-row-per-group result is joined back patch by
    patch for cells, and with :func:`salted_join` for other rows. This replaces
    ``agg(...) over (partition by keys)`` for coarse keys.
    """
    keys = list(keys)
    if "r" in df.columns and "c" in df.columns:
        return join_patches(df, df.groupBy(*keys).agg(*aggregates, *patch_extent()), keys)
    return salted_join(df, df.groupBy(*keys).agg(*aggregates), keys)


def split_hot(left, right, keys, target, left_on, right_on):
    """Prepare both sides of an equi join so that a hot key becomes several join keys.

    A key with many rows on the left is cut into ``pl`` parts there and its right rows are repeated for
    each; many rows on the right are cut into ``pr`` parts likewise. Together they form a grid of parts,
    and every pair of rows still meets exactly once. Cold keys keep one part and are not repeated.
    Returns both frames with ``_pl`` and ``_pr`` to be added to the join keys.
    """
    count = lambda df, side: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(side))
    hot = (
        count(left, "_nl").filter(F.col("_nl") > target)
        .join(count(right, "_nr").filter(F.col("_nr") > target), keys, "full")
        .select(*keys, *[F.coalesce(F.ceil(F.col(n) / target), F.lit(1)).cast("int").alias(k) for n, k in (("_nl", "_kl"), ("_nr", "_kr"))])
    )

    def deal(df, own, own_parts, other, other_parts, on):
        parts = F.coalesce(own_parts, F.lit(1))
        df = df.join(hot, keys, "left").withColumn(own, F.pmod(F.xxhash64(*on), parts).cast("int"))
        everywhere = F.sequence(F.lit(0), F.coalesce(F.col(other_parts), F.lit(1)) - 1)
        return df.withColumn(other, F.explode(everywhere)).drop("_kl", "_kr")

    return (
        deal(left, "_pl", F.col("_kl"), "_pr", "_kr", left_on),
        deal(right, "_pr", F.col("_kr"), "_pl", "_kl", right_on),
    )


def tasks_for(work, per_task):
    """Number of tasks for an amount of work; rows say little about it where each of them meets or makes many others."""
    return max(1, min(math.ceil((work or 0) / per_task), 100_000))


def dealt_to_tasks(df, on, per_task=100_000):
    """Rows dealt to tasks by ``on`` if they are more than ``per_task``; before steps that make many rows of each."""
    n = tasks_for(df.count(), per_task)
    return df if n == 1 else df.repartition(n, on)


def join_by_work(left, right, keys, left_on, right_on=None, pairs=PAIRS):
    """Inner join on coarse ``keys`` where many rows meet many, with about ``pairs`` pairs to a task at any size.

    The pairs of every key are counted first, one row per key. The total sets the number of tasks: adaptive execution goes by
    bytes and would leave small tables, whose pairs are many, to one task. A key with more pairs than ``pairs`` is cut into
    ``_pl`` parts of its left rows (by a hash of ``left_on``) and ``_pr`` of its right ones (``right_on``), a grid in which each
    pair still meets once; without ``right_on`` only the left side is cut, so a left row meets all of its right rows in one
    task. The result has ``_pl`` and ``_pr`` and is partitioned by them and ``keys``. Neither side is broadcast: Spark would
    judge that by the size of the files, before rows are dealt to keys.
    """
    keys = list(keys)
    count = lambda df, side: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(side))
    work = count(left, "_nl").join(count(right, "_nr"), keys).withColumn("_work", F.col("_nl") * F.col("_nr"))
    total, rows, most = work.agg(F.sum("_work"), F.sum(F.col("_nl") + F.col("_nr")), F.max("_work")).first()
    n = tasks_for((total or 0) + 4 * (rows or 0), pairs)
    if not most or most <= pairs:
        # no literal takes part in the keys: Spark would exchange the rows once more
        met = left.repartition(n, *keys).hint("merge").join(right.repartition(n, *keys), keys)
        return met.withColumns({"_pl": F.lit(0), "_pr": F.lit(0)})
    side = math.sqrt(pairs)
    parts = lambda own, other: F.when(F.col(other) <= side, F.ceil(F.col("_work") / pairs)).otherwise(F.ceil(F.col(own) / side))
    kl, kr = (parts("_nl", "_nr"), parts("_nr", "_nl")) if right_on else (F.ceil(F.col("_work") / pairs), F.lit(1))
    hot = work.filter(F.col("_work") > pairs).select(
        *keys, F.least(kl, F.col("_nl")).cast("int").alias("_kl"), F.least(kr, F.col("_nr")).cast("int").alias("_kr")
    )
    own = lambda parts, on: F.pmod(F.xxhash64(*on), F.coalesce(F.col(parts), F.lit(1))).cast("int")
    everywhere = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    left = left.join(hot, keys, "left").withColumn("_pl", own("_kl", left_on))
    right = right.join(hot, keys, "left").withColumn("_pl", everywhere("_kl"))
    on = [*keys, "_pl"]
    if right_on:
        left, right = left.withColumn("_pr", everywhere("_kr")), right.withColumn("_pr", own("_kr", right_on))
        on = [*on, "_pr"]
    left, right = left.drop("_kl", "_kr"), right.drop("_kl", "_kr")
    met = left.repartition(n, *on).hint("merge").join(right.repartition(n, *on), on)
    return met if right_on else met.withColumn("_pr", F.lit(0))


def numbered(df, keys, order, segment, tie=(), name="rn"):
    """Row number per ``keys`` along the integer column ``order`` in two levels.

    The key's range is cut into segments of ``segment`` units; each segment is numbered on its own
    and shifted by the count of the segments before it. Only the per-segment counts, never the rows,
    are gathered per key.
    """
    keys = list(keys)
    cut = df.withColumn("_seg", F.floor(F.col(order) / F.lit(segment)).cast("long"))
    counts = cut.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_seg").orderBy(order, *tie)
    return (
        cut.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + ["_seg"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", "_seg")
    )


def running(df, keys, order, segment, columns, tie=()):
    """Running aggregates (rows up to and including this one) in the two-level form of ``numbered``.

    ``columns`` maps an output name to ``(function, expression, combine)``, where ``function`` is an
    aggregate such as ``F.max`` and ``combine`` merges the value before the segment with the running
    value inside it.
    """
    keys = list(keys)
    cut = df.withColumn("_seg", F.floor(F.col(order) / F.lit(segment)).cast("long"))
    totals = cut.groupBy(*keys, "_seg").agg(
        *[fn(expr).alias(f"_t_{name}") for name, (fn, expr, _) in columns.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_seg", *[fn(f"_t_{name}").over(before).alias(f"_b_{name}") for name, (fn, _, _) in columns.items()]
    )
    inside = Window.partitionBy(*keys, "_seg").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"_r_{name}": fn(expr).over(inside) for name, (fn, expr, _) in columns.items()})
    out = out.join(offsets, keys + ["_seg"])
    out = out.withColumns(
        {name: combine(F.col(f"_b_{name}"), F.col(f"_r_{name}")) for name, (_, _, combine) in columns.items()}
    )
    return out.drop("_seg", *[f"_{p}_{name}" for name in columns for p in "br"])
