"""Choosing scenes from a catalogue of items.

Items have ``tile``, ``item_id``, ``granule_id``, ``yr`` or ``dt``, ``cloud`` and ``nodata``; masks are
packed 64 cells to a word: ``tile``, ``item_id``, ``word``, ``mask``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell.functions.bands import outside_inside
from terracell.operators.burn import burn, edges_in_grids, filled_cells
from terracell.operators.grids import grid_cells
from terracell.plans.lineage import cut
from terracell.plans.skew import salted_join

FULL = 1e-4


def search(items, cloud_below, start, end, tile=None):
    """Catalogue predicate; all parts reach the Parquet scan."""
    found = items.filter((F.col("cloud") < cloud_below) & F.col("dt").between(F.lit(start), F.lit(end)))
    return found if tile is None else found.filter(F.col("tile") == tile)


def score():
    return F.col("cloud") + F.col("nodata")


def ranked(items):
    """Candidates of every tile, best (least cloud plus missing) first."""
    return items.withColumn("score", score()).orderBy("tile", "score", "item_id")


def top_per_tile(items, k):
    """The ``k`` best items of each tile; Spark cuts to ``k`` before the shuffle."""
    w = Window.partitionBy("tile").orderBy("score", "item_id")
    return items.withColumn("score", score()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tiered(items, first_year, cloud, max_cloud, step, min_year):
    """Place of each item in the search ladder.

    In the first year the cloud limit rises from ``cloud`` by ``step`` to ``max_cloud``; earlier years
    follow one by one at ``max_cloud``. Items that no tier admits are left out.
    """
    rungs = -(-(max_cloud - cloud) // step) if max_cloud > cloud else 0
    rung = F.least(F.greatest(F.floor((F.col("cloud") - cloud) / F.lit(step)) + 1, F.lit(0)), F.lit(rungs)).cast("int")
    tier = F.when(F.col("yr") == first_year, rung).when(
        (F.col("yr") < first_year) & (F.col("yr") >= min_year), F.lit(rungs) + (F.lit(first_year) - F.col("yr"))
    )
    admitted = F.col("cloud") < max(cloud, max_cloud)
    return items.withColumn("tier", F.when(admitted, tier).cast("int")).filter(F.col("tier").isNotNull())


def search_ladder(searches, cloud, max_cloud, step, min_year):
    """The searches of every tile in order: ``tile``, ``tier``, ``start``, ``end``, ``cloud_below``.

    ``searches`` has one interval of dates per tile (``tile``, ``start``, ``end``). It is searched at cloud limits from
    ``cloud`` by ``step`` to ``max_cloud``; then the same days of each earlier year, down to the one whose interval begins in
    ``min_year``, at the last limit only. The 29th of February becomes the 28th. An interval may pass the turn of a year.
    """
    limits = [*range(cloud, max_cloud, step), max_cloud] if max_cloud > cloud else [cloud]
    years = F.greatest(F.year("start") - F.lit(min_year), F.lit(0))
    rung = lambda tier, back, below: F.struct(tier.cast("int").alias("tier"), back.cast("int").alias("_back"), below.cast("int").alias("cloud_below"))
    first = F.array(*[rung(F.lit(k), F.lit(0), F.lit(limit)) for k, limit in enumerate(limits)])
    back = F.slice(F.sequence(F.lit(0), years), F.lit(2), F.greatest(years, F.lit(0)))
    earlier = F.transform(back, lambda y: rung(F.lit(len(limits) - 1) + y, y, F.lit(limits[-1])))
    rungs = searches.select("tile", "start", "end", F.inline(F.concat(first, earlier)))
    shifted = lambda day: F.add_months(day, F.col("_back") * -12).alias(day)
    return rungs.select("tile", "tier", shifted("start"), shifted("end"), "cloud_below")


def tiered_by_interval(items, ladder):
    """Items (``tile``, ``dt``, ``cloud``) with the first tier of ``ladder`` that admits them; the others are left out.

    The intervals are dealt to the months they touch, one row per tile and month with its few searches in order. An item
    meets the one row of its month, so the join neither repeats items nor needs an aggregation behind it.
    """
    month = lambda day: F.year(day) * 12 + F.month(day)
    dealt = ladder.filter(F.col("start") <= F.col("end")).withColumn("_month", F.explode(F.sequence(month(F.col("start")), month(F.col("end")))))
    lists = dealt.groupBy("tile", "_month").agg(F.array_sort(F.collect_list(F.struct("tier", "start", "end", "cloud_below"))).alias("_rungs"))
    met = items.withColumn("_month", month(F.col("dt"))).join(lists, ["tile", "_month"])
    admits = lambda x: F.col("dt").between(x["start"], x["end"]) & (F.col("cloud") < x["cloud_below"])
    met = met.withColumn("tier", F.get(F.filter("_rungs", admits), F.lit(0))["tier"])
    return met.filter(F.col("tier").isNotNull()).drop("_month", "_rungs")


def outside_words(tiles, edges, cell, width, tile="tile"):
    """Words of the cells that lie outside each tile's polygon, for ``greedy_cover``.

    ``tiles`` are rasters (``tile``, w, n, x_res, y_res, height, width); ``edges`` the polygon edges of each tile
    (``tile``, x0, y0, x1, y1). A cell is inside if its centre is.
    """
    frames = tiles.withColumnRenamed(tile, "scene_id")
    own = edges.select(F.col(tile).alias("fid"), "x0", "y0", "x1", "y1", F.lit(1).alias("cls"))
    placed = edges_in_grids(own, frames, cell).filter(F.col("fid") == F.col("scene_id"))
    inside = burn(filled_cells(placed))
    cells = grid_cells(frames).drop("v").join(inside, ["scene_id", "r", "c"], "left")
    flagged = cells.select(F.col("scene_id").alias(tile), "r", "c", outside_inside(F.col("label")).alias("outside"))
    return pack_masks(flagged, width, (tile,), "outside")


def latest_by_id(items, key="item_id", order="query"):
    """One row per item, the last query wins; among equal queries the largest row does."""
    others = [c for c in items.columns if c != key]
    best = items.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in others])


def pack_masks(cells, width, keys=("tile", "item_id"), flag="clear"):
    """0/1 cells to words of 64 bits."""
    place = F.col("r").cast("long") * width + F.col("c")
    packed = cells.filter(F.col(flag) == 1).select(
        *keys, F.floor(place / 64).cast("long").alias("word"), (place % 64).cast("int").alias("_bit"), F.lit(1).cast("long").alias("_one")
    )
    return packed.groupBy(*keys, "word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("mask"))


def coverage(cells, keys=("tile",), flag="clear"):
    """Share of cells that any item shows clear."""
    per_cell = cells.groupBy(*keys, "r", "c").agg(F.max(flag).alias("_clear"))
    return per_cell.groupBy(*keys).agg(F.avg("_clear").alias("coverage"))


def coverage_gain(cells, order, keys=("tile",), item="item_id", flag="clear"):
    """Cells each candidate adds to those before it in ``order``, and their share of the tile.

    A cell belongs to the first candidate that shows it clear, so one minimum per cell replaces the
    running union over candidates.
    """
    first = cells.groupBy(*keys, "r", "c").agg(F.min(F.when(F.col(flag) == 1, F.col(order))).alias(order))
    added = first.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    totals = added.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    added = added.filter(F.col(order).isNotNull())
    listed = cells.select(*keys, item, order).distinct()
    out = listed.join(totals, list(keys)).join(added, [*keys, order], "left")
    new = F.coalesce(F.col("_n"), F.lit(0))
    return out.select(*keys, item, order, new.alias("new_cells"), (new / F.col("_total")).alias("gain"))


def greedy_cover(candidates, masks, tiles, min_share, max_items, max_remaining, outside=None):
    """Greedy choice of items that cover each tile.

    ``candidates`` (tile, item_id, granule_id, tier, score) are walked in the order tier, score, id. An
    item is taken when it adds at least ``min_share`` of what is still uncovered; a tile stops when it is
    full or has ``max_items``, goes to the next tier only while at least ``max_remaining / 5`` is
    uncovered (a full tile that is asked to go on looks at the first of each further tier only), and returns nothing if ``max_remaining`` or more stays uncovered. ``tiles`` has ``total``
    cells per tile, ``outside`` the words outside the polygon, which count as covered. Where the candidates have a column
    ``meets``, one whose box misses the polygon is passed over, but its granule is spent at the place where it was first met.

    What a tile takes next is the first remaining candidate with enough gain, so the walk needs at most
    ``max_items`` rounds whatever the number of candidates; a round is a distributed sum over words for
    all tiles at once. No tile's candidates are gathered in one task.
    """
    enough = max_remaining / 5
    key = F.struct("tier", "score", "item_id")
    # a granule counts only where it is first met
    if "meets" in candidates.columns:
        first = F.min(F.struct(key.alias("key"), "meets")).alias("_first")
        firsts = candidates.groupBy("tile", "granule_id").agg(first).filter("_first.meets").select("tile", "_first.key")
    else:
        firsts = candidates.groupBy("tile", "granule_id").agg(F.min(key).alias("key")).drop("granule_id")
    firsts = firsts.withColumns({"item_id": F.col("key.item_id"), "_tier": F.col("key.tier")})
    heads = firsts.groupBy("tile", "_tier").agg(F.min("key").alias("_head"))
    firsts = cut(firsts.join(heads, ["tile", "_tier"]).withColumn("_head", F.col("_head") == F.col("key")).drop("_tier"))
    none = masks.limit(0).select("tile", "word", "mask")
    before = outside if outside is not None else none
    counted = before.groupBy("tile").agg(F.sum(F.bit_count("mask")).alias("_out"))
    item_type = firsts.schema["item_id"].dataType
    state = (
        tiles.join(firsts.groupBy("tile").agg(F.min("key.tier").alias("tier")), "tile")
        .join(counted, "tile", "left")
        .select(
            "tile", "total", "tier", (F.coalesce("_out", F.lit(0)) / F.col("total")).alias("found"),
            F.lit(None).cast(firsts.schema["key"].dataType).alias("last"), F.array().cast(T.ArrayType(item_type)).alias("chosen"),
            F.lit(True).alias("_changed"),
        )
    )
    masks = cut(masks.join(firsts.select("tile", "item_id"), ["tile", "item_id"], "left_semi"))
    for _ in range(max_items):
        left = 1 - F.col("found")
        # a tile that took nothing has no candidate left: what failed once is behind it or fails again
        open_tiles = state.filter(F.col("_changed") & (left >= min(FULL, enough))).select("tile", "found", "total", "tier", "last")
        waiting = salted_join(firsts, open_tiles, ["tile"]).filter(
            (F.col("last").isNull() | (F.col("key") > F.col("last")))
            & (
                (left >= FULL) & ((F.col("key.tier") == F.col("tier")) | (left >= enough))
                | (left < FULL) & (left >= enough) & F.col("_head") & (F.col("key.tier") > F.col("tier"))
            )
        )
        # the words seen so far follow from the chosen items, so the state is all that a round hands on
        picked = state.filter("_changed").select("tile", F.explode("chosen").alias("item_id"))
        shown = masks.join(picked, ["tile", "item_id"], "left_semi").select("tile", "word", "mask")
        seen = before.select("tile", "word", "mask").unionByName(shown).groupBy("tile", "word").agg(F.bit_or("mask").alias("_seen"))
        new_bits = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long")))))
        words = masks.join(waiting.select("tile", "item_id"), ["tile", "item_id"], "left_semi")
        gains = words.join(seen, ["tile", "word"], "left").groupBy("tile", "item_id").agg(F.sum(new_bits).alias("_gain"))
        taken = (
            waiting.join(gains, ["tile", "item_id"], "left")
            .withColumn("_gain", F.coalesce("_gain", F.lit(0)))
            .filter(F.col("_gain") / F.col("total") >= min_share * left)
            .groupBy("tile").agg(F.min(F.struct("key", "_gain")).alias("_take"))
        )
        state = cut(
            state.join(taken.select("tile", F.col("_take.key").alias("_key"), F.col("_take._gain").alias("_gain")), "tile", "left").select(
                "tile", "total", F.coalesce("_key.tier", "tier").alias("tier"),
                (F.col("found") + F.coalesce("_gain", F.lit(0)) / F.col("total")).alias("found"),
                F.coalesce("_key", "last").alias("last"),
                F.when(F.col("_key").isNull(), F.col("chosen"))
                .otherwise(F.array_append("chosen", F.col("_key.item_id"))).alias("chosen"),
                F.col("_key").isNotNull().alias("_changed"),
            )
        )
        if state.filter("_changed").isEmpty():
            break
    return state.filter(1 - F.col("found") < max_remaining).select(
        "tile", F.posexplode("chosen").alias("place", "item_id"), "found"
    )
