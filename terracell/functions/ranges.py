"""Whole-number ranges as arrays."""

from pyspark.sql import functions as F


def clipped_range(first, last):
    """Array of the whole numbers from column ``first`` to column ``last``, empty if there is none.

    Both are column names, so that long expressions for the ends are computed once below. A filter on
    the ends would be moved below that projection and repeat them.
    """
    whole = F.sequence(F.col(first), F.greatest(F.col(last) + 1, F.col(first)))
    return F.slice(whole, F.lit(1), F.greatest(F.col(last) - F.col(first) + 1, F.lit(0)))


def explode_range(df, out, low, high, size):
    """One row per whole number from ``low`` to ``high`` that lies in 0..size-1."""
    df = df.withColumns({"_first": F.greatest(low, F.lit(0)).cast("int"), "_last": F.least(high, size - 1).cast("int")})
    return df.withColumn(out, F.explode(clipped_range("_first", "_last"))).drop("_first", "_last")
