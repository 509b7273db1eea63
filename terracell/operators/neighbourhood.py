"""Neighbour, dilation and pooling operators on cells.

Every operator of this module first deals the cells to square blocks with a border of copied cells
(``with_halo``). One exchange on the block key then serves all row-wise and column-wise windows that
follow, and no window partition is longer than a block side plus its border, however large a raster is.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK = 256
SLIDING_LIMIT = 16


def block_side(halo, block=BLOCK):
    """Block side that keeps the copied border a small share of the block."""
    return max(block, 8 * halo)


def with_halo(df, keys, halo, block=None):
    side = block or block_side(halo)

    def span(axis):
        low = F.floor(F.greatest(F.col(axis) - halo, F.lit(0)) / side)
        return F.sequence(low.cast("int"), F.floor((F.col(axis) + halo) / side).cast("int"))

    return (
        df.withColumn("_br", F.explode(span("r")))
        .withColumn("_bc", F.explode(span("c")))
        .repartition(*keys, "_br", "_bc")
    )


def without_halo(df, halo, block=None):
    side = block or block_side(halo)
    own = (F.floor(F.col("r") / side) == F.col("_br")) & (F.floor(F.col("c") / side) == F.col("_bc"))
    return df.filter(own).drop("_br", "_bc")


def along(keys, axis):
    """Window over one line of a block: ``axis='c'`` walks a row, ``axis='r'`` a column."""
    other = "r" if axis == "c" else "c"
    return Window.partitionBy(*keys, "_br", "_bc", other).orderBy(axis)


def neighbour(value, keys, axis, step):
    """Struct ``found``, ``v`` of the cell exactly ``step`` along ``axis`` (gaps are not jumped)."""
    w = along(keys, axis)
    shift = F.lead if step > 0 else F.lag
    found = shift(axis, 1).over(w) == F.col(axis) + step
    return F.struct(F.coalesce(found, F.lit(False)).alias("found"), F.when(found, shift(value, 1).over(w)).alias("v"))


def spread(df, keys, columns, n):
    """Square-window extremes inside an existing halo; ``columns`` maps output to (input, largest).

    All outputs share each of the two windows, so the lines are sorted once per direction.
    """
    for axis in ("r", "c"):
        w = along(keys, axis).rangeBetween(-n, n)
        df = df.withColumns(
            {
                out: (F.max if largest else F.min)(source if axis == "r" else out).over(w)
                for out, (source, largest) in columns.items()
            }
        )
    return df


def _near_flag(df, keys, flag, n, out):
    # distance to the nearest flagged cell, one running pass each way: cost does not grow with n
    for axis in ("r", "c"):
        source = flag if axis == "r" else out
        other = "r" if axis == "c" else "c"
        part = Window.partitionBy(*keys, "_br", "_bc", other)
        at = F.when(F.col(source) == 1, F.col(axis))
        before = F.last(at, ignorenulls=True).over(part.orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
        after = F.last(at, ignorenulls=True).over(
            part.orderBy(F.col(axis).desc()).rowsBetween(Window.unboundedPreceding, 0)
        )
        hit = (F.col(axis) - before <= n) | (after - F.col(axis) <= n)
        df = df.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))
    return df


def dilate_flag(df, keys, flag, n, out):
    """Square dilation of a 0/1 column by ``n`` cells inside an existing halo of at least ``n``."""
    if n == 0:
        return df.withColumn(out, F.col(flag))
    if n <= SLIDING_LIMIT:
        return spread(df, keys, {out: (flag, True)}, n)
    return _near_flag(df, keys, flag, n, out)


def box_extreme(cells, keys, column, n, out, largest=True):
    """Maximum (or minimum) of ``column`` in the (2n+1)² square around each cell, cut at the edges."""
    df = with_halo(cells, keys, n)
    return without_halo(spread(df, keys, {out: (column, largest)}, n), n)


def slopes(cells, keys, value="v"):
    """``x_slope`` to the east, ``y_slope`` to the north and their length ``gradient``.

    Central difference inside, one-sided at the edges, 0 on a side of length one; a missing value in
    any cell used gives a missing slope.
    """
    df = with_halo(cells, keys, 1)
    df = df.withColumns({"_cp": neighbour(value, keys, "c", -1), "_cn": neighbour(value, keys, "c", 1)})
    df = df.withColumns({"_rp": neighbour(value, keys, "r", -1), "_rn": neighbour(value, keys, "r", 1)})

    def central(before, after):
        b, a, v = F.col(before), F.col(after), F.col(value)
        inner = F.when(b["found"] & a["found"], ((v - b["v"]) + (a["v"] - v)) / 2.0)
        return (
            inner.when(b["found"] & ~a["found"], (v - b["v"]).cast("double"))
            .when(a["found"] & ~b["found"], (a["v"] - v).cast("double"))
            .when(~a["found"] & ~b["found"] & v.isNotNull(), F.lit(0.0))
        )

    df = without_halo(df.withColumns({"x_slope": central("_cp", "_cn"), "y_slope": -central("_rp", "_rn")}), 1)
    df = df.withColumn("y_slope", F.col("y_slope") + 0.0)  # no negative zero
    return add_gradient(df).drop("_cp", "_cn", "_rp", "_rn")


def add_gradient(df):
    return df.withColumn(
        "gradient", F.sqrt(F.col("x_slope") * F.col("x_slope") + F.col("y_slope") * F.col("y_slope"))
    )


def add_cloud_edge(haloed, keys, clear="clear", out="edge"):
    """1 where a cell is not clear but one of its four neighbours is (outside counts as not clear)."""
    df = haloed.withColumns({f"_{out}{s}": neighbour(clear, keys, "c", d)["v"] for s, d in (("w", -1), ("e", 1))})
    df = df.withColumns({f"_{out}{s}": neighbour(clear, keys, "r", d)["v"] for s, d in (("n", -1), ("s", 1))})
    around = sum((F.coalesce(F.col(f"_{out}{s}"), F.lit(0)) for s in "wens"), F.lit(0))
    return df.withColumn(out, F.when((F.col(clear) == 0) & (around > 0), F.lit(1)).otherwise(F.lit(0))).drop(
        *[f"_{out}{s}" for s in "wens"]
    )


def cloud_edges(cells, keys, clear="clear", out="edge"):
    return without_halo(add_cloud_edge(with_halo(cells, keys, 1), keys, clear, out), 1)


def grown_cloud_mask(cells, keys, n, clear="clear", out="clear_grown"):
    """Clear mask with every cell within ``n`` of a cloud edge set to 0."""
    halo = n + 1
    df = add_cloud_edge(with_halo(cells, keys, halo), keys, clear, "_edge")
    df = dilate_flag(df, keys, "_edge", n, "_near")
    df = df.withColumn(out, F.when(F.col("_near") == 1, F.lit(0)).otherwise(F.col(clear)))
    return without_halo(df, halo).drop("_edge", "_near")


def max_pool(cells, keys, steps, values=("v",)):
    """2x2 maximum applied ``steps`` times; an odd last row or column is dropped at each step."""
    size = 2**steps
    pooled = cells.groupBy(
        *keys, F.floor(F.col("r") / size).cast("int").alias("r"), F.floor(F.col("c") / size).cast("int").alias("c")
    )
    # a block is whole when it reaches its far corner: nested floors equal one floor by 2^steps
    return (
        pooled.agg(
            *[F.max(v).alias(v) for v in values],
            F.max(F.col("r") % size).alias("_lr"), F.max(F.col("c") % size).alias("_lc"),
        )
        .filter((F.col("_lr") == size - 1) & (F.col("_lc") == size - 1))
        .drop("_lr", "_lc")
    )
