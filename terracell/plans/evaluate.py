"""Scoring labelled chips and extending the evaluation table."""

from terracell.operators import blocks as K
from terracell.operators.layers import drop_missing_chips
from terracell.operators.metrics import evaluation_table, plain_ratios, score_against_labels, tolerant_ratios
from terracell.operators.scoring import chip_tensors, score_chips, scores_to_cells
from terracell.sources.manifests import pending


def evaluate_chips(cells, labels, chip_keys, channels, predict, finished=None, pool_steps=0, per_call=32, shape=None):
    """One statistics row per chip that is not in ``finished`` yet; chips with missing data, or not of ``shape``, are left out."""
    chip_keys = list(chip_keys)
    if finished is not None:
        cells = pending(cells, finished, chip_keys)
    good = drop_missing_chips(cells, chip_keys, channels)
    scores = scores_to_cells(score_chips(chip_tensors(good, chip_keys, channels, shape), chip_keys, channels, predict, per_call), chip_keys)
    return evaluation_table(score_against_labels(scores, labels, chip_keys, pool_steps), chip_keys, "score")


def evaluate_scenes(blocks, keys, channels, predict, context=0, n=1, classes=range(23), cls="cls", per_call=32, block=K.BLOCK):
    """One statistics row per scene of any size, from blocks (``operators.blocks``) that hold the channels and the labels.

    The model sees each block with ``context`` cells around it. Scenes that lack a value in a channel are left out. Blocks
    and their rims are all that is exchanged; no task holds a scene.
    """
    whole = K.whole_rasters(blocks, keys, channels)
    scores = K.score(whole, keys, channels, predict, context, per_call, keep=[cls], block=block)
    counts = K.evaluation(scores, keys, n, classes, cls=cls, block=block)
    return counts.withColumns({**plain_ratios(), **tolerant_ratios()})
