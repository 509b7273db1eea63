"""Feature tables and batch scoring of chips."""

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell.functions import bands as B
from terracell.model import blocks_to_cells
from terracell.operators.layers import rebase
from terracell.operators.neighbourhood import slopes


@dataclass
class FeatureSpec:
    """Which channels a model sees and how they are scaled.

    ``mode='train'`` appends the indices unscaled; ``mode='deploy'`` rescales them like the bands.
    """

    bands: tuple = ("b08", "b04", "b03", "b02")
    indices: tuple = ("ndwi", "ndvi")
    elevation: bool = True
    derivatives: bool = True
    elevation_scale: float = 1.0
    weights: dict = field(default_factory=dict)
    mode: str = "train"

    def channels(self):
        relief = ("elevation",) if self.elevation else ()
        slope = ("x_slope", "y_slope", "gradient") if self.elevation and self.derivatives else ()
        return (*self.bands, *self.indices, *relief, *slope)

    def to_json(self):
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text):
        raw = json.loads(text)
        raw["bands"], raw["indices"] = tuple(raw["bands"]), tuple(raw["indices"])
        raw["weights"] = {int(k): v for k, v in raw["weights"].items()}
        return cls(**raw)


def features(cells, spec, keys=("scene_id",), label=None):
    """Wide cells (bands, ``elevation``, label) to the channels of ``spec``, label last."""
    keys = list(keys)
    out = B.compute_indices(cells, spec.indices, spec.bands)
    if spec.mode == "deploy":
        out = out.withColumns({i: 2 * F.col(i) - 1 for i in spec.indices})
    out = out.withColumns({b: B.unit_scale(F.col(b)) for b in spec.bands})
    if spec.elevation:
        out = rebase(out, keys, "elevation", spec.elevation_scale)
        if spec.derivatives:
            out = slopes(out, keys, "elevation")
    columns = [F.col(c) for c in spec.channels()]
    if label is not None:
        columns.append(B.recode(F.col(label), spec.weights).alias("label"))
    return out.select(*keys, "r", "c", *columns)


def chip_tensors(cells, chip_keys, channels, shape=None):
    """One row per chip: ``h``, ``w`` and a row-major array per channel.

    A chip that lacks a cell inside its bounds (a ragged chip) cannot be scored and is left out. The bounds are ``shape``
    (height, width), so that a chip without its last line is ragged too; where chips differ in shape and none is given,
    they are those of the chip's cells. Rows are one per cell; a chip is bounded by its size.
    """
    listed = F.array_sort(F.collect_list(F.struct("r", "c", *channels)))
    grouped = cells.groupBy(*chip_keys).agg(
        (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), listed.alias("_cells")
    )
    of_channel = lambda ch: F.transform("_cells", lambda x: x[ch].cast("double"))
    arrays = [of_channel(ch).alias(ch) for ch in channels]
    grouped = grouped.filter(F.size("_cells") == F.col("h") * F.col("w"))
    if shape is not None:
        grouped = grouped.filter((F.col("h") == shape[0]) & (F.col("w") == shape[1]))
    return grouped.select(*chip_keys, "h", "w", *arrays)


def score_chips(tensors, chip_keys, channels, predict, per_call=32):
    """Run ``predict`` (array (k, channel, h, w) to (k, h', w')) over chips in Arrow batches.

    ``predict`` is supplied by the user and is shipped with the task. Chips of one batch may differ in
    shape; equal shapes are scored together, at most ``per_call`` per call.
    """
    scored = T.StructType.fromDDL("h int, w int, data array<double>")
    schema = T.StructType([*tensors.select(*chip_keys).schema.fields, *scored.fields])
    chip_keys, channels = list(chip_keys), list(channels)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for (h, w), group in pdf.groupby(["h", "w"], sort=False):
                for at in range(0, len(group), per_call):
                    part = group.iloc[at : at + per_call]
                    stack = np.stack([np.stack(part[ch].to_numpy()) for ch in channels], axis=1)
                    scores = np.asarray(predict(stack.reshape(len(part), len(channels), h, w)), dtype="float64")
                    out = part[chip_keys].copy()
                    out["h"], out["w"] = scores.shape[1], scores.shape[2]
                    out["data"] = [s.ravel() for s in scores]
                    yield out

    return tensors.mapInPandas(run, schema)


def scores_to_cells(scores, chip_keys):
    return blocks_to_cells(scores.select(*chip_keys, "w", "data"), chip_keys, value="score")


def custom_metric(cells, keys, fn, name, columns=("prob", "t")):
    """A user's metric as a grouped aggregate: an expression builder over columns, kept in the JVM."""
    return cells.groupBy(*keys).agg(fn(*[F.col(c) for c in columns]).alias(name))
