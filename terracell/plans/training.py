"""From raw layers and features to routed training chips."""

from pyspark.sql import functions as F

from terracell.operators import layers as L
from terracell.operators.burn import RADIUS, burn_features
from terracell.operators.grids import grid_scenes, reference_grids, to_chips
from terracell.operators.splits import route
from terracell.plans.deploy import layers_on_grids
from terracell.plans.stages import stage


def training_chips(layers, values, size, row_step=None, col_step=None, lists=None, shape=(832, 832), limit=0.1):
    """Join layers, cut lattice chips, drop those with too much missing, attach their split.

    ``values`` names the value column of each layer after the join. The layers are joined from all sides, and
    a chip's area is its side squared, so a cell that a layer does not hold counts as missing there.
    """
    cells, *rest = layers
    for layer in rest:
        cells = cells.join(layer, list(L.CELL), "full")
    height, width = (F.lit(s) if isinstance(s, int) else s for s in shape)
    chips = to_chips(cells, (height, width), size, row_step, col_step)
    keys = ["scene_id", "chip_r0", "chip_c0"]
    shares = chips.groupBy(*keys).agg(*[(1 - F.count_if(L.is_value(v)) / F.lit(size * size)).alias(v) for v in values])
    kept = shares.filter(F.greatest(*values) < limit if len(values) > 1 else F.col(values[0]) < limit).select(*keys)
    # the split goes to the list of chips first; a chip's key then holds no more cells than the chip has
    if lists is None:
        return chips.join(kept, keys, "left_semi")
    return chips.join(route(kept, lists, "scene_id"), keys)


def training_data(
    edges, image, image_scenes, elevation, elevation_scenes, lines, polygons, bands, bucket, size, grid_width=832, grid_res=10,
    row_step=None, col_step=None, lists=None, limit=0.1, radius=RADIUS, relief="cubic", folder=None,
):
    """From region polygons, raw layers and classified features to routed chips with bands, elevation and label.

    Reference grids cover the regions (``edges``) without overlap; image and elevation are cut to them, ``lines`` and
    ``polygons`` (segments fid, x0, y0, x1, y1, cls) are burned with ``radius``, and the grids are cut to chips of ``size``
    cells. A cell that no feature touches has label 0. Chips with ``limit`` or more of an image band or of the elevation
    missing are left out. ``folder`` keeps the stages ``scenes``, ``layers`` and ``labels`` like :func:`plans.deploy.deploy`.
    """
    keep = lambda name, build: stage(edges.sparkSession, folder, name, build)
    scenes = keep("scenes", lambda: grid_scenes(reference_grids(edges, grid_width, grid_width, grid_res), grid_width))
    layers = keep("layers", lambda: layers_on_grids(image, image_scenes, elevation, elevation_scenes, scenes, bands, bucket, relief))
    labels = keep("labels", lambda: burn_features(lines, polygons, scenes, bucket, radius))
    cells = layers.join(labels, list(L.CELL), "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return training_chips([cells], [*bands, "elevation"], size, row_step, col_step, lists, (grid_width, grid_width), limit)
