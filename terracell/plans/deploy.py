"""Scoring polygons: grids, layers, features, scores, blended mosaic."""

from functools import reduce

from pyspark.sql import functions as F

from terracell.functions.bands import blend_weight, zero_fill
from terracell.operators import regrid
from terracell.operators.grids import grid_cells, grid_scenes, reference_grids
from terracell.operators.layers import drop_missing_chips
from terracell.operators.onto import onto_targets
from terracell.operators.scoring import chip_tensors, features, score_chips, scores_to_cells
from terracell.plans.lineage import saved
from terracell.plans.skew import attach_stats, join_scenes, tasks_for
from terracell.plans.stages import stage

ROUND_CELLS = 1 << 24


def impute_wide(df, chip_keys, channels, limit=0.5):
    """Fill missing channels by their chip mean where less than ``limit`` of the whole chip is missing."""
    means = [F.avg(ch).alias(f"_{ch}") for ch in channels]
    gone = (sum(F.sum(F.isnull(ch).cast("int")) for ch in channels) / (len(channels) * F.count(F.lit(1)))).alias("_gone")
    out = attach_stats(df, chip_keys, [*means, gone])
    fill = lambda ch: F.coalesce(ch, F.when(F.col("_gone") < limit, F.coalesce(f"_{ch}", F.lit(0.0))))
    return out.withColumns({ch: fill(ch) for ch in channels}).drop("_gone", *[f"_{ch}" for ch in channels])


def score_grids(image, elevation, grids, channels, predict, per_call=32, keys=("scene_id",)):
    """Lay both layers on every cell of the grids, fill what may be filled, drop the rest, score.

    ``grids`` (keys, ``height``, ``width``) defines the cells, so a grid that lacks a layer or part of it
    is still complete, with missing values.
    """
    keys = list(keys)
    cells = grid_cells(grids, keys).drop("v")
    df = cells.join(image, [*keys, "r", "c"], "left").join(elevation, [*keys, "r", "c"], "left")
    df = drop_missing_chips(impute_wide(df, keys, channels), keys, channels)
    scores = score_chips(chip_tensors(df, keys, channels), keys, channels, predict, per_call)
    return scores_to_cells(scores, keys)


def blended_mosaic(scores, scenes, targets, bucket, blend="weighted"):
    """Scores of overlapping grids on the target grids: weighted mean, or first valid in grid order."""
    if blend == "first":
        out = onto_targets(scores.withColumnRenamed("score", "v"), scenes, targets, bucket)
    else:
        sized = join_scenes(scores, scenes.select("scene_id", "height", "width"))
        weight = blend_weight(F.col("r"), F.col("c"), F.col("height"), F.col("width"))
        packed = sized.select("scene_id", "r", "c", F.struct((F.col("score") * weight).alias("vw"), weight.alias("w")).alias("v"))
        out = onto_targets(packed, scenes, targets, bucket, "weighted")
    return out.withColumn("v", zero_fill(F.col("v")))


def layers_on_grids(image, image_scenes, elevation, elevation_scenes, scenes, bands, bucket, relief="cubic"):
    """Image bands (nearest) and elevation (``relief``) on every cell of the grids; what a layer lacks is missing."""
    on_cell = ["scene_id", "r", "c"]
    bands_cut = regrid.cut_bands_to_targets(image, bands, image_scenes, scenes, bucket)
    if relief == "nearest":
        relief_cut = onto_targets(elevation, elevation_scenes, scenes, bucket).withColumnRenamed("v", "elevation")
    else:
        relief_cut = regrid.cut_to_targets(elevation, elevation_scenes, scenes, bucket, relief).withColumnRenamed("v", "elevation")
    cells = grid_cells(scenes).drop("v")
    return cells.join(bands_cut, on_cell, "left").join(relief_cut, on_cell, "left")


def score_layers(layers, spec, predict, per_call=32, keys=("scene_id",)):
    """Channels of ``spec`` from the layers of every grid, filled where little is missing, scored; other grids are dropped."""
    keys = list(keys)
    channels = list(spec.channels())
    wide = drop_missing_chips(impute_wide(features(layers, spec, keys), keys, channels), keys, channels)
    return scores_to_cells(score_chips(chip_tensors(wide, keys, channels), keys, channels, predict, per_call), keys)


def score_in_rounds(layers, spec, predict, per_call=32, keys=("scene_id",), cells=ROUND_CELLS):
    """``score_layers`` of so many grids at a time that they have about ``cells`` cells; what a round exchanged goes with it."""
    rounds = tasks_for(layers.count(), cells)
    if rounds == 1:
        return score_layers(layers, spec, predict, per_call, keys)
    of = lambda k: layers.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k)
    return reduce(lambda a, b: a.unionByName(b), [saved(score_layers(of(k), spec, predict, per_call, keys), "scores") for k in range(rounds)])


def deploy(
    edges, image, image_scenes, elevation, elevation_scenes, spec, predict, bucket, grid_width=832, step=None, grid_res=10,
    out_width=None, out_res=None, blend="weighted", relief="cubic", per_call=32, folder=None,
):
    """From polygons (edge rows of ``region_id``) and raw layers to blended scores.

    Reference grids of ``grid_width`` cells are laid over the polygons, the layers are cut to them, channels computed as
    the model wants them (``spec``, usually ``mode="deploy"``) and scored. With ``out_res`` the scores go to a second,
    coarser set of grids, else back to the first. ``blend`` is ``weighted`` (mean weighted by the distance to a grid's
    edge) or ``first`` (the first grid with a score). A grid outside the image, or with half of it missing, has no scores.

    ``folder`` keeps the stages ``scenes``, ``layers``, ``scores``, ``targets`` and ``mosaic``; a run that was cut off goes
    on after its last whole stage. One folder belongs to one set of arguments. The result is the mosaic; ``scenes`` and
    ``targets`` hold the metadata of scores and mosaic.
    """
    spark = edges.sparkSession
    keep = lambda name, build: stage(spark, folder, name, build)
    scenes = keep("scenes", lambda: grid_scenes(reference_grids(edges, grid_width, step or grid_width, grid_res), grid_width))
    layers = keep("layers", lambda: layers_on_grids(image, image_scenes, elevation, elevation_scenes, scenes, spec.bands, bucket, relief))
    scores = keep("scores", lambda: score_in_rounds(layers, spec, predict, per_call))
    targets = scenes
    if out_res is not None:
        wide = out_width or grid_width
        targets = keep("targets", lambda: grid_scenes(reference_grids(edges, wide, wide, out_res), wide))
    mosaic = lambda: blended_mosaic(scores, scenes, targets, bucket, blend)
    return mosaic() if folder is None else keep("mosaic", mosaic)
