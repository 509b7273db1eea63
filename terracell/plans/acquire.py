"""From a catalogue to one cloud-free image per tile."""

from pyspark.sql import functions as F

from terracell.functions.bands import clear_mask
from terracell.operators import catalog
from terracell.operators.composite import composite, normalise
from terracell.plans.skew import salted_join


def choose_items(items, cells, tiles, width, ladder, min_share, max_items, max_remaining, outside=None):
    """Search ladder and greedy cover; ``cells`` has tile, item_id, r, c, scl.

    ``ladder`` holds the arguments of ``catalog.tiered``, for whole years, or is a table of ``catalog.search_ladder``, for
    intervals of dates. ``outside`` (tile, word, mask) marks the cells outside the tile's polygon, which need no image.
    """
    flagged = cells.withColumn("clear", clear_mask(F.col("scl")))
    masks = catalog.pack_masks(flagged, width)
    found = catalog.tiered(items, **ladder) if isinstance(ladder, dict) else catalog.tiered_by_interval(items, ladder)
    candidates = found.withColumn("score", catalog.score())
    return catalog.greedy_cover(candidates, masks, tiles, min_share, max_items, max_remaining, outside)


def tile_images(cells, chosen, bands, dilation):
    """Normalised, cloud-masked mean of the chosen items of every tile."""
    images = salted_join(cells, chosen.select("tile", "item_id"), ["tile", "item_id"], "left_semi")
    images = normalise(images.withColumnRenamed("tile", "scene_id"), ["scene_id", "item_id"], bands)
    return composite(images, bands, dilation)
