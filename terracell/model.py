"""The two raster forms: one row per cell, or one row per block of cells."""

from pyspark.sql import functions as F

BLOCK = 256


def blocks_to_cells(blocks, keys, data="data", value="v", block=BLOCK):
    """Rows of ``h`` x ``w`` row-major arrays to cells; ``br``/``bc`` place the block if present."""
    base = lambda name: F.col(name) * block if name in blocks.columns else F.lit(0)
    exploded = blocks.select(
        *keys, "w", base("br").alias("_r0"), base("bc").alias("_c0"), F.posexplode(data).alias("_pos", value)
    )
    return exploded.select(
        *keys,
        (F.col("_r0") + F.floor(F.col("_pos") / F.col("w"))).cast("int").alias("r"),
        (F.col("_c0") + F.col("_pos") % F.col("w")).cast("int").alias("c"),
        value,
    )


def cells_to_blocks(cells, keys, value="v", block=BLOCK):
    """Cells to dense row-major blocks; an absent cell becomes NULL. A block holds at most block² cells.

    Of a cell that occurs twice the greater value stays. The cells of a block are sorted once, and the gap before each is
    filled as it is written, so the cost is that of the sort.
    """
    at = ((F.col("r") % block) * block + F.col("c") % block).cast("int")
    placed = cells.select(
        *keys, F.floor(F.col("r") / block).cast("int").alias("br"), F.floor(F.col("c") / block).cast("int").alias("bc"),
        F.struct(at.alias("at"), F.col(value).alias("v")).alias("_cell"),
    )
    grouped = placed.groupBy(*keys, "br", "bc").agg(
        F.floor(F.max(F.col("_cell.at") / block) + 1).cast("int").alias("h"),
        (F.max(F.col("_cell.at") % block) + 1).alias("w"), F.array_sort(F.collect_list("_cell")).alias("_sorted"),
    )
    last_of_its_place = lambda x, i: F.coalesce(F.get("_sorted", i + 1)["at"] != x["at"], F.lit(True))
    grouped = grouped.withColumn("_cells", F.filter("_sorted", last_of_its_place))
    place = lambda x: F.floor(x["at"] / block).cast("int") * F.col("w") + x["at"] % block
    gap = lambda x, i: place(x) - F.coalesce(place(F.get("_cells", i - 1)), F.lit(-1)) - 1
    nothing = F.lit(None).cast(cells.schema[value].dataType)
    filled = F.flatten(F.transform("_cells", lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i)), F.array(x["v"]))))
    after = F.col("h") * F.col("w") - 1 - place(F.element_at("_cells", -1))
    return grouped.select(*keys, "br", "bc", "h", "w", F.concat(filled, F.array_repeat(nothing, after)).alias("data"))
