"""Cutting chips while stepping around missing data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.operators.layers import is_value


def value_runs(cells, value="v", layer="layer"):
    """Runs of columns that hold a value, as one sorted array of (start, end) per raster line.

    What no run covers is missing: cells that are NULL, NaN or infinite, and cells and lines that have no row. A line
    without a value has an empty array if it has rows. Copies of a cell share their rank and count once.
    """
    line = Window.partitionBy("scene_id", layer, "r").orderBy("c")
    held = cells.filter(is_value(value)).select("scene_id", layer, "r", "c", (F.col("c") - F.dense_rank().over(line)).alias("_run"))
    runs = held.groupBy("scene_id", layer, "r", "_run").agg(F.min("c").alias("start"), (F.max("c") + 1).alias("end"))
    runs = runs.groupBy("scene_id", layer, "r").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    # a layer that has rows but no value at all still counts as a layer
    named = cells.groupBy("scene_id", layer).agg(F.min("r").alias("r"))
    return named.join(runs, ["scene_id", layer, "r"], "full").withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))


def walk_chips(cells, scenes, size, row_step=None, col_step=None, missing_step=25, limit=0.1, start=(0, 0)):
    """Chips found by a walk that steps past missing data, per scene.

    A chip with ``limit`` or more of a layer missing (NULL, NaN, infinite, or no row at all) is passed over: the
    walk moves right and down by 25, then 50, ... cells until a chip is good, and by the column step after a good
    chip. Each step depends on the one before, so a scene is one group; what reaches it is one row per raster
    line, with the runs of columns that hold a value. A scene without rows in any layer has no chips.
    """
    row_step, col_step = row_step or size, col_step or size

    def walk(pdf):
        import numpy as np
        import pandas as pd

        height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        layers = []
        for _, lines in pdf[pdf["r"].notna()].groupby("layer"):
            by_row = {}
            for r, runs in zip(lines["r"].astype(int), lines["runs"]):
                ends = np.array([[run["start"], run["end"]] for run in runs], dtype=np.int64).reshape(-1, 2)
                by_row[r] = (ends[:, 0], ends[:, 1], np.concatenate([[0], np.cumsum(ends[:, 1] - ends[:, 0])]))
            layers.append(by_row)

        def before(line, x):
            starts, ends, total = line
            i = np.searchsorted(starts, x)
            return total[i] - max(0, ends[i - 1] - x) if i else 0

        def too_empty(r, c):
            for by_row in layers:
                lines = (by_row[i] for i in range(r, r + size) if i in by_row)
                if size * size - sum(before(line, c + size) - before(line, c) for line in lines) >= limit * size * size:
                    return True
            return not layers

        found = []
        r, c = start
        tries = 1
        while r + size <= height and c + size <= width:
            if too_empty(r, c):
                down = right = missing_step * tries
                tries += 1
            else:
                found.append((r, c))
                down, right, tries = 0, col_step, 1
            r, c = r + down, c + right
            if c + size > width:
                r, c = r + row_step, start[1]
        out = pd.DataFrame(found, columns=["chip_r0", "chip_c0"], dtype="int32")
        out.insert(0, "scene_id", pdf["scene_id"].iloc[0])
        return out

    lines = scenes.select("scene_id", "height", "width").join(value_runs(cells), "scene_id", "left")
    return lines.groupBy("scene_id").applyInPandas(walk, "scene_id long, chip_r0 int, chip_c0 int")
