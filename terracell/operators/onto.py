"""Nearest cells of many overlapping rasters on target rasters, without a row per pair of a target cell and a source.

Source cells are packed by patches of ``PATCH`` x ``PATCH``, and so are target cells. A patch of a target is at home in one square,
and a patch of a source goes to all squares whose targets it may reach. So all sources of a target cell meet in one task, and what
is exchanged grows with sources and targets, not with their pairs. There the pairs are taken in numpy, a few sources at a time.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from terracell.plans.lineage import saved
from terracell.plans.skew import PATCH, tasks_for

PAIRS = 1 << 26  # of patches tested in a task
TASK_CELLS = 1 << 22  # source cells in a task
ROUND_CELLS = 1 << 27  # source cells sent in a round
DENSE = 1 << 20  # places looked at together
NEAR = 128  # targets tested together
WIDER = 4, 16  # times the side of a square, where there is little in it

_ON = ["_level", "_bx", "_by", "_pl", "_ps"]
_BOX = [f"_{k}" for k in "wsen"]
_EXTENT = [f"_x{k}" for k in "wsen"]


def _geometry(scenes):
    """Numbers of a raster as doubles, and its box; rasters without one of them meet nothing."""
    d = lambda k: F.col(k).cast("double")
    numbers = {k: d(k) for k in ("w", "n", "x_res", "y_res")} | {k: F.col(k).cast("int") for k in ("height", "width")}
    held = scenes.select("scene_id", *[c.alias(k) for k, c in numbers.items()]).dropna(subset=list(numbers))
    return held.withColumns({"_w": d("w"), "_s": d("n") - d("height") * d("y_res"), "_e": d("w") + d("width") * d("x_res"), "_n": d("n")})


def _extent(r0, r1, c0, c1):
    """The box of the cells from row r0 and column c0 to before row r1 and column c1."""
    x, y = lambda c: F.col("w") + c * F.col("x_res"), lambda r: F.col("n") - r * F.col("y_res")
    return {"_xw": x(c0), "_xs": y(r1), "_xe": x(c1), "_xn": y(r0)}


def _packed(cells):
    """A row per patch of cells: arrays of their rows, columns and values, their number and bounds."""
    place = lambda k: F.floor(F.col(k) / PATCH).cast("int")
    held = cells.select("scene_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v").dropna(subset=["scene_id", "r", "c"])
    held = held.groupBy("scene_id", place("r").alias("_pr"), place("c").alias("_pc"))
    bounds = [f(k).alias(f"_{k}{i}") for k in "rc" for i, f in enumerate((F.min, F.max))]
    held = held.agg(F.collect_list(F.struct("r", "c", "v")).alias("cells"), F.count(F.lit(1)).alias("_cells"), *bounds)
    return held.select("*", *[F.col(f"cells.{k}").alias(k) for k in "rcv"]).drop("cells")


def _floor(a, b, first, n):
    """Source places under the centres of ``n`` target places from ``first``, for every pair."""
    return np.floor(a[:, None] + b[:, None] * ((first[:, None] + np.arange(n)) + 0.5))


class _Sources:
    """Patches of sources in the order of their ids, as arrays."""

    def __init__(self, table):
        table = table.take(pc.sort_indices(table.column("scene_id"))).combine_chunks()
        column = lambda k: table.column(k).to_numpy()
        self.n, self.box, self.extent = len(table), [column(k) for k in _BOX], [column(k) for k in _EXTENT]
        self.w, self.north, self.x_res, self.y_res = (column(k) for k in ("w", "n", "x_res", "y_res"))
        self.r0, self.c0 = column("_r0").astype(np.int64), column("_c0").astype(np.int64)
        self.h, self.width = column("_r1") - self.r0 + 1, column("_c1") - self.c0 + 1
        listed = [table.column(k).combine_chunks() for k in "rcv"]
        listed = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in listed]
        self.r, self.c = (x.flatten().to_numpy().astype(np.int64) for x in listed[:2])
        self.v = listed[2].flatten()
        self.ends = np.concatenate(([0], np.cumsum(pc.list_value_length(listed[0]).to_numpy()))).astype(np.int64)
        self.dense = np.concatenate(([0], np.cumsum(self.h * self.width)))

    def parts(self, first):
        """Ranges of sources, few at first, of about ``DENSE`` places at most."""
        at, step = 0, first
        while at < self.n:
            end = int(np.searchsorted(self.dense, self.dense[at] + DENSE, side="right")) - 1
            end = max(at + 1, min(end, at + step, self.n))
            yield at, end
            at, step = end, step * 4

    def places(self, at, end):
        """Cells of the sources from ``at`` to ``end``, and their places in the dense rectangles of their patches."""
        cells = np.arange(self.ends[at], self.ends[end])
        of = np.repeat(np.arange(at, end), np.diff(self.ends[at : end + 1]))
        return cells, self.dense[of] - self.dense[at] + (self.r[cells] - self.r0[of]) * self.width[of] + self.c[cells] - self.c0[of]


class _Targets:
    def __init__(self, table):
        table = table.combine_chunks()
        column = lambda k: table.column(k).to_numpy()
        self.id, self.box, self.extent = table.column("scene_id"), [column(k) for k in _BOX], [column(k) for k in _EXTENT]
        self.w, self.north, self.x_res, self.y_res = (column(k) for k in ("w", "n", "x_res", "y_res"))
        self.r0, self.c0 = column("_r0").astype(np.int64), column("_c0").astype(np.int64)
        self.h, self.width = column("_r1") - self.r0, column("_c1") - self.c0
        self.start = np.concatenate(([0], np.cumsum(self.h * self.width)))

    def together(self):
        """All targets, neighbours next to each other."""
        strips = max(1, math.isqrt(len(self.h) // NEAR))
        place = np.argsort(np.argsort(self.extent[0], kind="stable"), kind="stable") * strips // max(1, len(self.h))
        return np.lexsort((self.extent[1], place))

    def under(self, s, at, end, open_):
        """Target cells of the targets ``open_`` under which one of the sources from ``at`` to ``end`` has a place, and that place;
        of one target cell those of later sources come first."""
        for h, w in sorted(set(zip(self.h[open_].tolist(), self.width[open_].tolist()))):
            shaped = open_[(self.h[open_] == h) & (self.width[open_] == w)]
            for k in range(0, len(shaped), NEAR):
                t = shaped[k : k + NEAR]
                # these targets lie together, so most sources are left out at once
                (tw, ts, te, tn), (sw, ss, se, sn) = [b[t] for b in self.extent], [b[at:end] for b in s.extent]
                near = np.flatnonzero((tw.min() <= se) & (sw <= te.max()) & (ts.min() <= sn) & (ss <= tn.max()))[::-1] + at
                met = np.ones((len(t), len(near)), bool)
                # both the rasters and what there is of them in these patches
                for tb, sb in ((self.extent, s.extent), (self.box, s.box)):
                    (tw, ts, te, tn), (sw, ss, se, sn) = [b[t][:, None] for b in tb], [b[near] for b in sb]
                    met &= (tw <= se) & (sw <= te) & (ts <= sn) & (ss <= tn)
                ti, si = np.nonzero(met)
                ti, si = t[ti], near[si]
                step = max(1, DENSE // (h * w))
                for p in range(0, len(ti), step):
                    yield self._cells(s, ti[p : p + step], si[p : p + step], at, h, w)

    def _cells(self, s, t, o, at, h, w):
        row = _floor((s.north[o] - self.north[t]) / s.y_res[o], self.y_res[t] / s.y_res[o], self.r0[t], h) - s.r0[o][:, None]
        col = _floor((self.w[t] - s.w[o]) / s.x_res[o], self.x_res[t] / s.x_res[o], self.c0[t], w) - s.c0[o][:, None]
        held = ((row >= 0) & (row < s.h[o][:, None]))[:, :, None] & ((col >= 0) & (col < s.width[o][:, None]))[:, None, :]
        p, i, j = np.nonzero(held)
        place = s.dense[o[p]] - s.dense[at] + row[p, i].astype(np.int64) * s.width[o[p]] + col[p, j].astype(np.int64)
        return self.start[t[p]] + i * w + j, place

    def rows(self, covered):
        """Ids, rows and columns of the target cells ``covered``."""
        t = np.searchsorted(self.start, covered, side="right") - 1
        inside = covered - self.start[t]
        r, c = self.r0[t] + inside // self.width[t], self.c0[t] + inside % self.width[t]
        return [self.id.take(pa.array(t)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))]


def _first(schema):
    """Per target cell the value of the first source that has one; ``src`` is that source."""

    def run(key, targets, sources):
        if not len(targets) or not len(sources):
            return schema.empty_table()
        t, s = _Targets(targets), _Sources(sources)
        ids = sources.column("scene_id").combine_chunks().take(pc.sort_indices(sources.column("scene_id")))
        valid = s.v.is_valid().to_numpy(zero_copy_only=False)
        best, covered, open_ = np.full(t.start[-1], -1), np.zeros(t.start[-1], bool), t.together()
        for at, end in s.parts(32):
            cells, place = s.places(at, end)
            # the rows of a cell may repeat; one with a value comes last
            order = np.argsort(valid[cells], kind="stable")
            held = np.full(s.dense[end] - s.dense[at], -1)
            held[place[order]] = cells[order]
            for target, place in t.under(s, at, end, open_):
                cell = held[place]
                target, cell = target[cell >= 0], cell[cell >= 0]
                covered[target] = True
                use = valid[cell] & ((best[target] < 0) | (best[target] >= s.ends[at]))
                # of equal targets the last one stays
                best[target[use]] = cell[use]
            if len(open_):
                done = np.add.reduceat(best >= 0, t.start[:-1]) == t.h * t.width
                open_ = open_[~done[open_]]
            if not len(open_):
                break
        at = np.flatnonzero(covered)
        found = best[at]
        cell = pa.array(found, mask=found < 0)
        of = pa.array(np.searchsorted(s.ends, np.maximum(found, 0), side="right") - 1, mask=found < 0)
        return pa.table([*t.rows(at), ids.take(of), s.v.take(cell)], names=schema.names).cast(schema)

    return run


def _weighted(schema):
    """Per target cell the sums of ``vw`` and ``w`` where a source has both."""

    def run(key, targets, sources):
        if not len(targets) or not len(sources):
            return schema.empty_table()
        t, s = _Targets(targets), _Sources(sources)
        parts = [s.v.field(k).cast(pa.float64()) for k in ("vw", "w")]
        both = pc.and_(s.v.is_valid(), pc.and_(parts[0].is_valid(), parts[1].is_valid())).to_numpy(zero_copy_only=False)
        numbers = [both.astype(np.float64), *[np.where(both, x.fill_null(0.0).to_numpy(), 0.0) for x in parts]]
        n = int(t.start[-1])
        covered, sums, open_ = np.zeros(n, bool), [np.zeros(n) for _ in numbers], t.together()
        for at, end in s.parts(1 << 10):
            cells, place = s.places(at, end)
            size = int(s.dense[end] - s.dense[at])
            there = np.zeros(size, bool)
            there[place] = True
            held = [np.bincount(place, x[cells], size) for x in numbers]
            for target, place in t.under(s, at, end, open_):
                target, place = target[there[place]], place[there[place]]
                covered[target] = True
                for total, x in zip(sums, held):
                    if len(target) * 4 > n:
                        total += np.bincount(target, x[place], n)
                    else:
                        np.add.at(total, target, x[place])
        at = np.flatnonzero(covered)
        none = sums[0][at] == 0
        out = [pa.array(x[at], mask=none) for x in sums[1:]]
        return pa.table([*t.rows(at), *out], names=schema.names).cast(schema)

    return run


def onto_targets(cells, sources, targets, cell, method="first"):
    """On every target cell (``scene_id``, r, c) whose centre lies in a cell of a source, ``v`` of all sources.

    ``cells`` has ``scene_id``, r, c and ``v``; the rasters of source and target meet if their boxes do. With ``first`` it is the value of
    the source with the smallest id that has one. With ``weighted`` ``v`` is a struct of ``vw`` and ``w``, and the result is the sum of the
    first over the sum of the second. Squares have the side ``cell`` or, for larger targets, that times a power of 4.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = targets.sparkSession
    starts = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1, F.lit(PATCH)))
    whole = saved(_packed(cells), "patches")
    sent = whole.join(_geometry(sources), "scene_id").filter(f"_pr between 0 and floor((height - 1) / {PATCH}) and _pc between 0 and floor((width - 1) / {PATCH})")
    sent = sent.withColumns(_extent(F.col("_r0"), F.col("_r1") + 1, F.col("_c0"), F.col("_c1") + 1)).drop("_pr", "_pc", "height", "width")
    # a little more than the cells, as places are rounded
    grown = {k: F.col(k) + by * F.col(f"{res}_res") * 1e-6 + by * F.abs(k) * 1e-12 for k, by, res in (("_xw", -1, "x"), ("_xs", -1, "y"), ("_xe", 1, "x"), ("_xn", 1, "y"))}
    sent = sent.withColumns(grown)

    spots = _geometry(targets).filter("height > 0 and width > 0").withColumn("_r0", starts("height")).withColumn("_c0", starts("width"))
    spots = spots.withColumns({"_r1": F.least("height", F.col("_r0") + PATCH), "_c1": F.least("width", F.col("_c0") + PATCH)})
    spots = spots.withColumns(_extent(F.col("_r0"), F.col("_r1"), F.col("_c0"), F.col("_c1"))).drop("height", "width")
    spots, square, count = saved(spots, "targets"), _ON[:3], F.count(F.lit(1)).cast("double")
    place = lambda v: F.floor(v / F.col("_side")).cast("long")

    def in_squares(cell):
        """Targets at home in a square, sources sent to it, and per square with both their numbers and that of the source cells."""
        side = F.greatest(F.col("_xe") - F.col("_xw"), F.col("_xn") - F.col("_xs"), F.lit(cell))
        at = spots.withColumn("_level", F.greatest(F.ceil(F.log(side * (1 + 1e-9) / F.lit(cell)) / math.log(4) - 1e-9), F.lit(0)).cast("int"))
        at = at.withColumn("_side", F.lit(cell) * F.pow(F.lit(4.0), F.col("_level")))
        at = at.withColumns({"_bx": place(F.col("_xw")), "_by": place(F.col("_xs"))}).drop("_side")
        sizes = at.groupBy("_level").agg(F.max(F.col("_xe") - F.col("_xw")).alias("w"), F.max(F.col("_xn") - F.col("_xs")).alias("h")).collect()
        one = lambda z: F.struct(*[F.lit(v).alias(k) for k, v in (("_level", z[0]), ("_side", cell * 4.0 ** z[0]), ("_tw", z[1]), ("_th", z[2]))])
        to = sent.select("*", F.inline(F.array(*[one(z) for z in sizes or [(0, 0.0, 0.0)]])))
        to = to.withColumn("_by", F.explode(F.sequence(place(F.col("_xs") - F.col("_th")), place(F.col("_xn")))))
        to = to.withColumn("_bx", F.explode(F.sequence(place(F.col("_xw") - F.col("_tw")), place(F.col("_xe"))))).drop("_side", "_tw", "_th")
        held = to.groupBy(*square).agg(count.alias("_ns"), F.sum("_cells").cast("double").alias("_nc"))
        return at, to, saved(at.groupBy(*square).agg(count.alias("_nt")).join(held, square), "squares")

    at, to, work = in_squares(float(cell))
    for by in reversed(WIDER):
        wider = [F.floor(F.col(k) / by) for k in ("_bx", "_by")]
        most = work.groupBy("_level", *wider).agg((F.sum("_nt") * F.sum("_ns")).alias("n"), F.sum("_nc").alias("c")).agg(F.max("n"), F.max("c")).first()
        if (most[0] or 0) <= PAIRS // 16 and (most[1] or 0) <= TASK_CELLS // 4:
            at, to, work = in_squares(float(cell) * by)
            break
    # the pairs of patches set the tasks, and what is sent the rounds
    work = work.withColumn("_ks", F.least(F.ceil(F.col("_nc") / TASK_CELLS), F.col("_ns")).cast("int"))
    work = work.withColumn("_kl", F.least(F.ceil(F.col("_nt") * F.col("_ns") / F.col("_ks") / PAIRS), F.col("_nt")).cast("int"))
    groups, pairs, moved, split = work.agg(F.sum(F.col("_kl") * F.col("_ks")), F.sum(F.col("_nt") * F.col("_ns")), F.sum(F.col("_nc") * F.col("_kl")), F.max("_ks")).first()
    rounds = tasks_for(moved, ROUND_CELLS)
    tasks = max(1, min(math.ceil((groups or 1) / rounds), max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks_for((pairs or 0) / rounds, PAIRS // 16), tasks_for((moved or 0) / rounds, TASK_CELLS // 16))))
    apart = split and split > 1 or not spots.filter("_r0 = 0 and _c0 = 0").groupBy("scene_id").count().filter("count > 1").isEmpty()

    id_, kind = targets.schema["scene_id"].dataType.simpleString(), cells.schema["v"].dataType.simpleString()
    results = {"first": f"src {sources.schema['scene_id'].dataType.simpleString()}, v {kind}", "weighted": "vw double, w double"}[method]
    schema = spark.createDataFrame([], f"scene_id {id_}, r int, c int, {results}").schema
    run = {"first": _first, "weighted": _weighted}[method](to_arrow_schema(schema))
    dealt = lambda on, parts: F.pmod(F.xxhash64(*on), F.col(parts)).cast("int")
    everywhere = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    def of_round(k):
        held = work.select(*square, "_kl", "_ks")
        held = held if rounds == 1 else held.filter(F.pmod(F.xxhash64(*square), F.lit(rounds)) == k)
        t = at.join(held, square).withColumn("_pl", dealt(["scene_id", "_r0", "_c0"], "_kl")).withColumn("_ps", everywhere("_ks"))
        s = to.join(held, square).withColumn("_ps", dealt(["scene_id", "_r0", "_c0"], "_ks")).withColumn("_pl", everywhere("_kl"))
        t, s = (x.drop("_kl", "_ks", "_cells").repartition(tasks, *_ON) for x in (t, s))
        found = t.groupBy(*_ON).cogroup(s.groupBy(*_ON)).applyInArrow(run, schema)
        return found if rounds == 1 else saved(found, "found")

    found = reduce(lambda a, b: a.unionByName(b), [of_round(k) for k in range(rounds)])
    if method == "first":
        merged = F.min_by("v", F.when(F.col("v").isNotNull(), F.col("src"))).alias("v")
        return found.groupBy("scene_id", "r", "c").agg(merged) if apart else found.select("scene_id", "r", "c", "v")
    found = found.groupBy("scene_id", "r", "c").agg(F.sum("vw").alias("vw"), F.sum("w").alias("w")) if apart else found
    return found.select("scene_id", "r", "c", F.try_divide("vw", "w").alias("v"))
