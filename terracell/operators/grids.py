"""Reference grids, tile tables and chip lattices."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.functions import geodesy
from terracell.functions.geometry import segment_near_box
from terracell.functions.names import bbox_name
from terracell.plans.skew import tasks_for

# Grids stay inside this longitude.
EDGE = 179.999
PER_TASK = 200_000


def _lattice(edges, grid_width, step_size, grid_res, region_id):
    """Per region: bounds, resolution and number of rows and columns of its lattice of grids."""
    half = grid_width / 2
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    df = edges.groupBy(region_id).agg(low("x0", "x1").alias("_w"), low("y0", "y1").alias("_s"), high("x0", "x1").alias("_e"), high("y0", "y1").alias("_n"))
    df = df.withColumn("_yres", geodesy.degrees_north(grid_res, (F.col("_s") + F.col("_n")) / 2))
    df = df.withColumns({"_s": F.col("_s") - F.col("_yres") * half, "_n": F.col("_n") + F.col("_yres") * half})
    df = df.withColumn("_xres", geodesy.degrees_east(grid_res, (F.col("_s") + F.col("_n")) / 2))
    margin = F.col("_xres") * half
    df = df.withColumns({"_w": F.col("_w") - margin, "_e": F.col("_e") + margin})
    west, east = F.col("_w") < -EDGE, F.col("_e") > EDGE
    df = df.withColumns(
        {
            "_w": F.when(west, F.lit(-EDGE)).when(east, F.col("_w") - margin).otherwise(F.col("_w")),
            "_e": F.when(west, F.col("_e") + margin).when(east, F.lit(EDGE)).otherwise(F.col("_e")),
        }
    )
    steps = lambda low, high, res: F.floor(F.ceil((F.col(high) - F.col(low)) / F.col(res)) / step_size).cast("int")
    return df.withColumns({"_rows": steps("_s", "_n", "_yres"), "_cols": steps("_w", "_e", "_xres")})


def _grid_box(grid_width, step_size):
    """The box of the grid at ``grid_row``, ``grid_col``; the columns count from the east where that is the edge."""
    width = F.col("_xres") * grid_width
    from_east = F.col("_e") == EDGE
    forward = F.col("_w") + F.col("grid_col") * step_size * F.col("_xres")
    backward = F.col("_e") - F.col("grid_col") * step_size * F.col("_xres")
    south = F.col("_s") + F.col("grid_row") * step_size * F.col("_yres")
    return {
        "w": F.when(from_east, backward - width).otherwise(forward),
        "e": F.when(from_east, backward).otherwise(F.least(forward + width, F.lit(EDGE))),
        "s": south, "n": south + F.col("_yres") * grid_width,
    }


def _run(low, high, last):
    """Places ``low`` to ``high`` of a lattice whose last place is ``last``, with one more on either side for rounding."""
    first, end = F.greatest(F.floor(low) - 1, F.lit(0)).cast("int"), F.least(F.ceil(high) + 1, last).cast("int")
    return F.when(first <= end, F.sequence(first, F.greatest(first, end)))


def _columns(xa, xb, grid_width, step_size):
    """The columns whose boxes may meet the x range ``xa`` to ``xb``."""
    step, width = F.col("_xres") * step_size, F.col("_xres") * grid_width
    from_east = F.col("_e") == EDGE
    first = F.when(from_east, (F.col("_e") - width - xb) / step).otherwise((xa - width - F.col("_w")) / step)
    end = F.when(from_east, (F.col("_e") - xa) / step).otherwise((xb - F.col("_w")) / step)
    return _run(first, end, F.col("_cols"))


def reference_grids(edges, grid_width=2560, step_size=1280, grid_res=10, region_id="region_id"):
    """Overlapping square grids of ``grid_width`` cells covering each region, by scan lines over its edges.

    ``edges`` has one row per edge (``region_id``, ``x0, y0, x1, y1``); a region may have any shape, several parts, and
    holes (inside is even-odd). The metre resolution becomes degrees at the middle latitude, first to the north, then to
    the east; the bounds get half a grid of margin and are held inside the antimeridian.

    A grid meets a region if an edge touches it or its lower left corner lies inside. Each edge gives one run of columns
    for every row of grids it passes, and the crossings of a row's lower line, in order, bound runs of corners that lie
    inside. Only these runs are generated: the work follows edges and result, not the bounds of a region. A row of a region's
    grids is made in one task, of which there are as many as the lattices have places for: edges are few and small, and what
    they make is not.
    """
    frame = _lattice(edges, grid_width, step_size, grid_res, region_id)
    places = frame.agg(F.sum((F.col("_rows") + 1).cast("double") * (F.col("_cols") + 1))).first()[0]
    step, height = F.col("_yres") * step_size, F.col("_yres") * grid_width
    south = F.col("_s") + F.col("grid_row") * step_size * F.col("_yres")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    held = edges.select(region_id, "x0", "y0", "x1", "y1").hint("merge").join(frame, region_id)
    rows = _run((F.least(y0, y1) - height - F.col("_s")) / step, (F.greatest(y0, y1) - F.col("_s")) / step, F.col("_rows"))
    held = held.withColumn("grid_row", F.explode(rows)).repartition(tasks_for(places, PER_TASK), region_id, "grid_row")

    # crossings of the row's lower line come first and in order; every odd one begins a run that the next one ends
    crossing = F.when((y0 > south) != (y1 > south), x0 + (south - y0) * (x1 - x0) / (y1 - y0))
    line = Window.partitionBy(region_id, "grid_row").orderBy(F.col("_x").asc_nulls_last())
    held = held.withColumn("_x", crossing).withColumns({"_to": F.lead("_x").over(line), "_k": F.row_number().over(line)})

    # the part of an edge inside its row's band; a flat edge is in whole
    at = lambda y: F.when(y0 == y1, x0).otherwise(x0 + (F.least(F.greatest(y, F.least(y0, y1)), F.greatest(y0, y1)) - y0) * F.try_divide(x1 - x0, y1 - y0))
    ends = [at(south), F.when(y0 == y1, x1).otherwise(at(south + height))]
    touched = _columns(F.least(*ends), F.greatest(*ends), grid_width, step_size)
    inside = F.when(F.col("_x").isNotNull() & F.col("_to").isNotNull() & (F.col("_k") % 2 == 1), _columns(F.col("_x"), F.col("_to"), grid_width, step_size))
    tagged = lambda columns, flag: F.coalesce(F.transform(columns, lambda c: F.struct(F.lit(flag).alias("_in"), c.alias("grid_col"))), F.array())
    found = held.select("*", F.inline(F.concat(tagged(touched, False), tagged(inside, True))))
    # inline makes each box once: a filter on plain columns would be moved below them and repeat them
    box = F.struct(*[c.alias(k) for k, c in _grid_box(grid_width, step_size).items()])
    found = found.select(region_id, "grid_row", "grid_col", "x0", "y0", "x1", "y1", "_x", "_to", "_in", F.inline(F.array(box)))
    found = found.filter(F.when(F.col("_in"), (F.col("w") > F.col("_x")) & (F.col("w") < F.col("_to"))).otherwise(segment_near_box(x0, y0, x1, y1, F.struct("w", "s", "e", "n"))))

    found = found.select(region_id, "grid_row", "grid_col", "w", "s", "e", "n").dropDuplicates([region_id, "grid_row", "grid_col"])
    return found.withColumn("file_name", bbox_name(F.col("w"), F.col("s"), F.col("e"), F.col("n")))


def grid_scenes(grids, grid_width, region_id="region_id"):
    """Raster metadata of reference grids, with a number ``scene_id`` made of region, row and column.

    A grid cut off at the antimeridian has fewer columns. Region ids are whole numbers below 2**23.
    """
    widest = grids.groupBy(region_id).agg((F.max(F.col("e") - F.col("w")) / F.lit(grid_width)).alias("x_res"))
    number = F.col(region_id).cast("long") * 2**40 + F.col("grid_row").cast("long") * 2**20 + F.col("grid_col")
    sized = grids.join(widest, region_id)
    width = F.round((F.col("e") - F.col("w")) / F.col("x_res")).cast("int")
    return sized.select(
        number.alias("scene_id"), "w", "n", "x_res", ((F.col("n") - F.col("s")) / F.lit(grid_width)).alias("y_res"),
        F.lit(grid_width).alias("height"), width.alias("width"),
    ).filter("width > 0")


def tile_table(spark, zoom):
    """All XYZ tiles of a zoom level, bounds rounded to 9 decimals."""
    side = 2**zoom
    tiles = spark.range(side * side).select(
        F.floor(F.col("id") / side).cast("int").alias("x_index"), (F.col("id") % side).cast("int").alias("y_index")
    )
    return with_tile_bounds(tiles, F.lit(zoom))


def with_tile_bounds(tiles, zoom, decimals=9):
    b = geodesy.tile_bounds(F.col("x_index"), F.col("y_index"), zoom)
    return tiles.select("*", *[F.round(b[k], decimals).alias(k) for k in "wsen"])


def grid_cells(scenes, keys=("scene_id",), value=1):
    """A raster of ones for each scene row (``height``, ``width``)."""
    rows = scenes.select(*keys, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"))
    return rows.select(*keys, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"), F.lit(value).alias("v"))


def to_chips(cells, scenes_shape, size, row_step=None, col_step=None):
    """Copy each cell to every lattice chip that holds it.

    ``scenes_shape`` gives (height, width) as columns or numbers; only whole chips are made. Chips are
    named by their upper left cell ``chip_r0``, ``chip_c0``; ``r`` and ``c`` become chip coordinates.
    """
    row_step, col_step = row_step or size, col_step or size
    height, width = scenes_shape

    def starts(axis, step, side):
        first = F.greatest(F.ceil((F.col(axis) - size + 1) / step), F.lit(0)).cast("int")
        last = F.least(F.floor(F.col(axis) / step), F.floor((side - size) / step)).cast("int")
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: i * step))

    out = cells.withColumn("chip_r0", F.explode(starts("r", row_step, height)))
    out = out.withColumn("chip_c0", F.explode(starts("c", col_step, width)))
    return out.withColumns({"r": F.col("r") - F.col("chip_r0"), "c": F.col("c") - F.col("chip_c0")})


def single_parts(features, parts="parts", ring="ring"):
    """One row per part of a multi-part geometry."""
    others = [c for c in features.columns if c != parts]
    return features.select(*others, F.posexplode(parts).alias("part", ring))
