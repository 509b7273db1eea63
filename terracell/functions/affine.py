"""Cell and world coordinates of north-up rasters, and index maps of whole-raster turns."""

from pyspark.sql import functions as F


def resolution(w, s, e, n, height, width):
    return F.struct(((e - w) / width).alias("x_res"), ((n - s) / height).alias("y_res"))


def cell_centre(r, c, w, n, x_res, y_res):
    return F.struct((w + (c + 0.5) * x_res).alias("x"), (n - (r + 0.5) * y_res).alias("y"))


def world_to_cell(x, y, w, n, x_res, y_res):
    return F.struct(
        F.floor((n - y) / y_res).cast("int").alias("r"), F.floor((x - w) / x_res).cast("int").alias("c")
    )


def window_bounds(r0, c0, h, w, west, north, x_res, y_res):
    """Bounds of the window whose upper left cell is (r0, c0)."""
    return F.struct(
        (west + c0 * x_res).alias("w"), (north - (r0 + h) * y_res).alias("s"),
        (west + (c0 + w) * x_res).alias("e"), (north - r0 * y_res).alias("n"),
    )


def turned(r, c, height, width, how):
    """New (r, c) of a cell after a quarter turn or a flip of its raster."""
    if how == "rot90":
        new = (width - 1 - c, r)
    elif how == "flip_lr":
        new = (r, width - 1 - c)
    elif how == "flip_ud":
        new = (height - 1 - r, c)
    else:
        raise ValueError(f"unknown turn {how!r}")
    return F.struct(new[0].alias("r"), new[1].alias("c"))
