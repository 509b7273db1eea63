"""Raster tables on disk."""

from pyspark.sql import functions as F

from terracell.functions.affine import window_bounds
from terracell.model import BLOCK, blocks_to_cells
from terracell.plans.skew import join_scenes, salted_join


def read_layer(spark, path, layer, bounds=None):
    """Cells of one layer; ``bounds`` (w, s, e, n) keeps the stored rows (cells or whole blocks) that meet them.

    Bounds need the corners that :func:`write_layer` stores when it is given ``scenes``.
    """
    blocks = spark.read.parquet(path).filter(F.col("layer") == layer)
    if bounds is not None:
        if "bw" not in blocks.columns:
            raise ValueError(f"{path} was written without scenes: it holds no corners to compare with bounds")
        w, s, e, n = bounds
        blocks = blocks.filter((F.col("bw") <= e) & (F.col("be") >= w) & (F.col("bs") <= n) & (F.col("bn") >= s))
    return blocks_to_cells(blocks, ["scene_id"]) if "data" in blocks.columns else blocks.drop("bw", "bs", "be", "bn")


def with_corners(df, scenes):
    """Cells or blocks with the bounds ``bw, bs, be, bn`` of each row, from the scenes' metadata."""
    blocks = "data" in df.columns
    meta = scenes.select("scene_id", *[F.col(c).alias(f"_s_{c}") for c in ("w", "n", "x_res", "y_res", "height", "width")])
    row, col, high, wide = (F.col("br") * BLOCK, F.col("bc") * BLOCK, F.col("h"), F.col("w")) if blocks else (F.col("r"), F.col("c"), F.lit(1), F.lit(1))
    if blocks:
        joined = salted_join(df, meta, ["scene_id"], salt_on=["br", "bc"])
    else:
        joined = join_scenes(df, meta.withColumns({"height": F.col("_s_height"), "width": F.col("_s_width")})).drop("height", "width")
    west, north = F.col("_s_w") + col * F.col("_s_x_res"), F.col("_s_n") - row * F.col("_s_y_res")
    corners = {"bw": west, "be": west + wide * F.col("_s_x_res"), "bn": north, "bs": north - high * F.col("_s_y_res")}
    return joined.withColumns(corners).drop(*[c for c in joined.columns if c.startswith("_s_")])


def _spread_bits(x):
    """The low 24 bits of a whole number with a zero between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve_place(x, y, extent=(-180.0, -90.0, 180.0, 90.0)):
    """Place of a point on a Z-shaped curve through ``extent`` (w, s, e, n): near points mostly have near places."""
    w, s, e, n = extent
    share = lambda v, low, high: F.least(F.greatest((v - low) / F.lit(high - low), F.lit(0.0)), F.lit(1.0))
    whole = lambda v, low, high: F.floor(share(v, low, high) * F.lit(2**24 - 1)).cast("long")
    return _spread_bits(whole(x, w, e)).bitwiseOR(F.shiftleft(_spread_bits(whole(y, s, n)), 1))


def write_layer_by_place(df, path, layer, scenes, files=None, mode="append", extent=(-180.0, -90.0, 180.0, 90.0)):
    """Write cells or blocks with their bounds, ranged along a curve through the plane.

    A file then holds one compact area, so the least and greatest bounds kept in its footer let a query by bounds
    (:func:`read_layer`) skip all files and row groups that lie elsewhere, whatever scene they belong to.
    """
    middle = curve_place((F.col("bw") + F.col("be")) / 2, (F.col("bs") + F.col("bn")) / 2, extent)
    placed = with_corners(df, scenes).withColumns({"_place": middle, "layer": F.lit(layer)})
    order = ["_place", "scene_id", *[c for c in ("br", "bc", "r", "c") if c in df.columns]]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_place").write.mode(mode).partitionBy("layer").parquet(path)


def write_layer(df, path, layer, mode="append", scenes=None):
    """Write cells or blocks under ``layer=...``, ranged by scene so that row groups hold few scenes.

    With ``scenes`` every row also stores its bounds, by which :func:`read_layer` can select.

    One directory per layer, not per scene: with millions of scenes the directories would outnumber the
    data, while min/max statistics on ``scene_id`` prune as well.
    """
    # the position within the scene takes part, so that one large scene is written by several tasks
    df = df if scenes is None else with_corners(df, scenes)
    order = ["scene_id", *[c for c in ("br", "bc", "r", "c") if c in df.columns]]
    ordered = df.withColumn("layer", F.lit(layer)).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode(mode).partitionBy("layer").parquet(path)


def window_scenes(scenes, windows, size):
    """Metadata of rasters cut from ``scenes`` at ``chip_r0``, ``chip_c0``: new bounds, shape, resolution."""
    b = window_bounds(F.col("chip_r0"), F.col("chip_c0"), size, size, F.col("w"), F.col("n"), F.col("x_res"), F.col("y_res"))
    joined = windows.join(scenes, "scene_id").withColumn("_b", b)
    return joined.select(
        "scene_id", "chip_r0", "chip_c0", *[F.col("_b")[k].alias(k) for k in "wsen"], "x_res", "y_res",
        F.lit(size).alias("height"), F.lit(size).alias("width"),
    )


def resized_scenes(scenes, height, width):
    """Metadata of a raster of another shape over the same bounds."""
    return scenes.withColumns(
        {
            "x_res": (F.col("e") - F.col("w")) / F.lit(width), "y_res": (F.col("n") - F.col("s")) / F.lit(height),
            "height": F.lit(height), "width": F.lit(width),
        }
    )


def write_chips(chips, path, mode="append"):
    """Chip cells by layer and split, ranged by scene and chip."""
    ordered = chips.repartitionByRange("scene_id", "chip_r0", "chip_c0").sortWithinPartitions("scene_id", "chip_r0", "chip_c0")
    partitions = [c for c in ("split", "layer") if c in chips.columns]
    ordered.write.mode(mode).partitionBy(*partitions).parquet(path)


def list_chips(chips):
    """Two-level listing: every chip of every scene with the layers it has."""
    return chips.groupBy("scene_id", "chip_r0", "chip_c0").agg(F.count_distinct("layer").alias("layers"))
