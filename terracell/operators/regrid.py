"""Resampling onto other grids and mosaicking.

Instead of looking up source cells for every target cell, each source cell is sent to the target cells
it touches: their rows and columns are a closed form of the two affine transforms. There is no join
between the two rasters, only one with the small table of overlapping raster pairs, and the mosaic
aggregation that is needed anyway collects the contributions with map-side combining.
"""

from pyspark.sql import functions as F

from terracell.functions.bands import has_image
from terracell.functions.ranges import explode_range
from terracell.operators.onto import onto_targets
from terracell.operators.spatial import box_join
from terracell.plans.skew import PATCH, join_patches, join_scenes, patch_range

EXTRA_PIXELS = 20


def scene_boxes(scenes, prefix):
    """Rename scene metadata (w, n, x_res, y_res, height, width) with a prefix and add its box."""
    renamed = scenes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in scenes.columns])
    p = lambda c: F.col(f"{prefix}_{c}")
    return renamed.withColumn(
        f"{prefix}_box",
        F.struct(
            p("w").alias("w"), (p("n") - p("height") * p("y_res")).alias("s"),
            (p("w") + p("width") * p("x_res")).alias("e"), p("n").alias("n"),
        ),
    )


def raster_pairs(sources, targets, bucket):
    """Overlapping source and target rasters: columns ``src_*`` and ``dst_*``."""
    s, t = scene_boxes(sources, "src"), scene_boxes(targets, "dst")
    return box_join(s, t, "src_box", "dst_box", bucket, "src_scene_id", "dst_scene_id").drop("src_box", "dst_box")


def pair_cells(cells, pairs, margin=EXTRA_PIXELS):
    """Source cells next to each target they may serve, cropped to its bounds plus ``margin`` cells."""
    renamed = cells.withColumnRenamed("scene_id", "src_scene_id")
    # only the patches of the source that lie under the target take part
    def span(start, res, low, high, size, axis):
        first, last = F.floor((low - start) / res) - margin - 1, F.floor((high - start) / res) + margin + 1
        clip = lambda v: F.least(F.greatest(v, F.lit(0)), size - 1)
        return patch_range(clip(first), clip(last), axis)

    p = F.col
    ranges = [
        *span(-p("src_n"), p("src_y_res"), -p("dst_n"), p("dst_height") * p("dst_y_res") - p("dst_n"), p("src_height"), "r"),
        *span(p("src_w"), p("src_x_res"), p("dst_w"), p("dst_w") + p("dst_width") * p("dst_x_res"), p("src_width"), "c"),
    ]
    joined = join_patches(renamed, _with_affine(pairs).select("*", *ranges), ["src_scene_id"])
    x = F.col("src_w") + (F.col("c") + 0.5) * F.col("src_x_res")
    y = F.col("src_n") - (F.col("r") + 0.5) * F.col("src_y_res")
    mx, my = F.col("src_x_res") * margin, F.col("src_y_res") * margin
    inside = (
        (x >= F.col("dst_w") - mx) & (x <= F.col("dst_w") + F.col("dst_width") * F.col("dst_x_res") + mx)
        & (y <= F.col("dst_n") + my) & (y >= F.col("dst_n") - F.col("dst_height") * F.col("dst_y_res") - my)
    )
    return joined.filter(inside).select(*PAIRED)


def crop_to_targets(cells, sources, targets, bucket, margin=EXTRA_PIXELS):
    """Source cells inside each overlapping target's bounds plus ``margin`` source cells."""
    out = pair_cells(cells, raster_pairs(sources, targets, bucket), margin)
    return out.select(F.col("dst_scene_id").alias("target_id"), F.col("src_scene_id").alias("scene_id"), "r", "c", "v")


def _with_affine(pairs):
    """Target-to-source affine of each pair: source index + 0.5 = a + b * (target index + 0.5), per axis."""
    return pairs.withColumns(
        {
            "_ra": (F.col("src_n") - F.col("dst_n")) / F.col("src_y_res"), "_rb": F.col("dst_y_res") / F.col("src_y_res"),
            "_ca": (F.col("dst_w") - F.col("src_w")) / F.col("src_x_res"), "_cb": F.col("dst_x_res") / F.col("src_x_res"),
        }
    )


PAIRED = ("dst_scene_id", "src_scene_id", "r", "c", "v", "_ra", "_rb", "_ca", "_cb", "dst_height", "dst_width")


def _axis(name):
    return F.col(f"_{name}a"), F.col(f"_{name}b"), F.col("dst_width" if name == "c" else "dst_height")


def _explode_nearest(df, axis, out):
    # centres with i <= a + b*(t + 0.5) < i + 1; one more on each side, then an exact test of few candidates
    a, b, size = _axis(axis)
    i = F.col(axis)
    df = explode_range(df, out, F.floor((i - a) / b - 0.5), F.ceil((i + 1 - a) / b - 0.5), size)
    return df.filter(F.floor(a + b * (F.col(out) + 0.5)) == i)


def nearest(paired):
    """Every (target cell, source) with the value of the source cell under its centre."""
    out = _explode_nearest(_explode_nearest(paired, "r", "_tr"), "c", "_tc")
    return out.select(
        F.col("dst_scene_id").alias("scene_id"), "src_scene_id", F.col("_tr").alias("r"), F.col("_tc").alias("c"), "v"
    )


def cubic_weight(t, a=-0.5):
    """Keys convolution kernel."""
    d = F.abs(t)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def _explode_cubic(df, axis, out):
    # targets whose kernel support of two source cells reaches this cell
    a, b, size = _axis(axis)
    i = F.col(axis)
    df = explode_range(df, out, F.ceil((i - 1.5 - a) / b - 0.5), F.floor((i + 2.5 - a) / b - 0.5), size)
    return df.withColumn("_k", cubic_weight(a + b * (F.col(out) + 0.5) - 0.5 - i))


def cubic(paired):
    """Cubic convolution of every source onto its targets, missing cells left out of the weight sum.

    The kernel is a product, so columns are done first and rows second; partial sums of value*weight
    and of weight are carried through, which equals the full 4x4 sum.
    """
    target, source = "dst_scene_id", "src_scene_id"
    paired = paired.filter(F.col("v").isNotNull())
    row_terms = ["_ra", "_rb", "dst_height"]
    spread = _explode_cubic(paired, "c", "_tc")
    # the affine terms are constant within a pair, so they ride along as first values
    by_row = spread.groupBy(target, source, "r", "_tc").agg(
        F.sum(F.col("_k") * F.col("v")).alias("_vw"), F.sum("_k").alias("_w"), *[F.first(t).alias(t) for t in row_terms]
    )
    spread = _explode_cubic(by_row, "r", "_tr")
    summed = spread.groupBy(target, source, "_tr", "_tc").agg(
        F.sum(F.col("_k") * F.col("_vw")).alias("_vw"), F.sum(F.col("_k") * F.col("_w")).alias("_w")
    )
    value = F.when(F.abs(F.col("_w")) > 1e-12, F.col("_vw") / F.col("_w"))
    return summed.select(
        F.col(target).alias("scene_id"), source, F.col("_tr").alias("r"), F.col("_tc").alias("c"), value.alias("v")
    )


def mosaic_first(resampled, keys=("scene_id", "r", "c"), order="src_scene_id", value="v"):
    """First valid value in file order."""
    return resampled.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def mosaic_weighted(resampled, keys=("scene_id", "r", "c"), weighted="vw", weight="w", value="v"):
    """Sum of weighted values over sum of weights; missing where the weights sum to nothing."""
    both = F.col(weighted).isNotNull() & F.col(weight).isNotNull()
    return resampled.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(both, F.col(weighted))), F.sum(F.when(both, F.col(weight)))).alias(value)
    )


def on_common_lattice(cells, sources):
    """First-valid mosaic of sources that share one lattice and resolution, as a single raster.

    Merging before resampling lets a kernel reach across the seam between two files. Cell indices are
    counted from the lattice origin and may be negative.
    """
    meta = sources.select("scene_id", "w", "n", "x_res", "y_res", "height", "width")
    placed = join_scenes(cells, meta)
    placed = placed.withColumns(
        {
            "c": (F.col("c") + F.round(F.col("w") / F.col("x_res"))).cast("int"),
            "r": (F.col("r") - F.round(F.col("n") / F.col("y_res"))).cast("int"),
        }
    )
    return mosaic_first(placed, ("r", "c", "x_res", "y_res"), "scene_id")


def cut_to_targets(cells, sources, targets, bucket, method="nearest"):
    """Resample every overlapping source onto each target, then keep the first valid value.

    Sources without a cell are left out before they are paired: pairs grow with sources times targets.
    """
    held = sources.join(cells.select("scene_id").distinct(), "scene_id", "left_semi")
    paired = pair_cells(cells, raster_pairs(held, targets, bucket))
    return mosaic_first({"nearest": nearest, "cubic": cubic}[method](paired))


def cut_bands_to_targets(cells, bands, sources, targets, bucket):
    """Image cells (``scene_id``, r, c and ``bands``) on each target: nearest, first source with data in all bands at once.

    Pairs of targets and sources are taken where they meet (:func:`onto_targets`); no row is made of them.
    """
    value = F.when(has_image(*[F.col(b) for b in bands]), F.struct(*bands))
    out = onto_targets(cells.select("scene_id", "r", "c", value.alias("v")), sources, targets, bucket)
    return out.select("scene_id", "r", "c", "v.*")


def pair_merged(merged, sources, targets, bucket):
    """Cells of a mosaic from ``on_common_lattice`` next to every target they may serve.

    Only targets overlapping a source count; ``bucket`` is the bucket side of that join. Cells and grown target boxes
    meet by patches of the lattice and are then tested exactly; a cell lies in one patch, so no pair appears
    twice and no key holds more cells than a patch.
    """
    t = scene_boxes(targets, "dst")
    pairs = box_join(t, scene_boxes(sources, "src"), "dst_box", "src_box", bucket, "dst_scene_id", "src_scene_id")
    columns = [c for c in t.columns if c != "dst_box"]
    used = pairs.groupBy(*columns).agg(F.max("src_x_res").alias("src_x_res"), F.max("src_y_res").alias("src_y_res"))
    used = used.withColumns({"src_w": F.lit(0.0), "src_n": F.lit(0.0), "src_scene_id": F.lit(0).cast("long")})
    patch = lambda i: F.floor(i / F.lit(PATCH)).cast("int")
    grow_x, grow_y = F.col("src_x_res") * 2.5, F.col("src_y_res") * 2.5
    left, right = F.col("dst_w") - grow_x, F.col("dst_w") + F.col("dst_width") * F.col("dst_x_res") + grow_x
    top, bottom = F.col("dst_n") + grow_y, F.col("dst_n") - F.col("dst_height") * F.col("dst_y_res") - grow_y
    column, row = lambda x: x / F.col("src_x_res"), lambda y: -y / F.col("src_y_res")
    used = used.withColumns({"_c0": F.floor(column(left)) - 1, "_c1": F.ceil(column(right)), "_r0": F.floor(row(top)) - 1, "_r1": F.ceil(row(bottom))})
    used = used.withColumn("_pc", F.explode(F.sequence(patch(F.col("_c0")), patch(F.col("_c1")))))
    used = used.withColumn("_pr", F.explode(F.sequence(patch(F.col("_r0")), patch(F.col("_r1")))))
    placed = merged.select("r", "c", "v", patch(F.col("c")).alias("_pc"), patch(F.col("r")).alias("_pr"))
    paired = placed.join(_with_affine(used), ["_pc", "_pr"])
    return paired.filter(F.col("c").between(F.col("_c0"), F.col("_c1")) & F.col("r").between(F.col("_r0"), F.col("_r1"))).select(*PAIRED)


def cut_merged_to_targets(cells, sources, targets, bucket, method="cubic"):
    """Merge sources of one lattice first, then resample the mosaic onto each target."""
    paired = pair_merged(on_common_lattice(cells, sources), sources, targets, bucket)
    return mosaic_first({"nearest": nearest, "cubic": cubic}[method](paired))
