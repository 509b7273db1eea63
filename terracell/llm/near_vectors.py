"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside a cell, one representative per group.

Only vectors of equal label and length are compared. Equal ones are one class first, held by its smallest id and its
number of copies. A group of more than ``target`` classes may be cut into cells: k centers are fitted to a sample of at most
``sample`` vectors per group, centers of a cosine above the threshold become one (so a dense group of near copies is not
torn), and every class is entered at its nearest center and as a guest wherever its distance to the boundary between
the two centers is at most ``reach``. Cells that are still too large are cut again. A cut stays only if the sample says that
it leaves at most ``PAYS`` of the products: vectors without any order are guests almost everywhere, and their cells cost
more than they save. Two vectors linked by an angle with
chord ``s`` lie on different sides of a boundary only if one of them is within s/2 of it, so ``reach`` of s/2 misses
nothing. Up to 20 dimensions that is the reach; beyond, a difference of random direction crosses a boundary by
s/sqrt(d) only, and ``SIGMAS`` such deviations are enough to lose less than one pair in 10,000. A pair that meets in
several cells counts in the first of them.

Centers are few and go to the tasks; a vector is entered in its cells on the way to the products and never written again.
A cell is compared in blocks of at most ``block`` classes, a task for every pair of blocks; a cell that
no center can cut, however large, goes through the same blocks, so nothing is capped. Pairs of blocks are dealt to rounds
that send at most ``ROUND`` times the classes each, and what a round has exchanged goes with it: the disk in use does not
grow with the number of blocks. Products are taken in single precision, and those within its error of the threshold again
in double precision. A task emits sums and the smallest class reached, never pairs. Links make components by hooking and
pointer jumping.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing:
no links, their own component, kept. A row without an id is kept, has no component, and takes no part. Rows of equal ids
are vectors of their own. An empty table gives no rows.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from terracell.llm.common import parallelism, written
from terracell.llm.jaccard_join import components
from terracell.plans.lineage import saved
from terracell.plans.skew import tasks_for

THRESHOLD = 0.93
TARGET = 32_768
BLOCK = 32_768
BLOCK_BYTES = 1 << 24  # of a block in double precision; longer vectors make smaller blocks
SAMPLE = 20_000
PER_CENTER = 16  # sample vectors per center at least
LEVELS = 6
SIGMAS = 4.5
PAYS = 0.75
SIDE = 2048  # vectors on a side of one product
TASK_PAIRS = 1 << 27
ROUND = 2.5
ROUND_ROWS = 1 << 19  # a round sends so many rows in any case
SHARE = 10_000  # copies of one vector in a task of the last join


def units(column):
    """The rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = np.empty((len(column), len(flat) // max(1, len(column))))
    for at in range(0, len(x), SIDE):
        part = flat[at * x.shape[1] : (at + SIDE) * x.shape[1]].astype(np.float64).reshape(-1, x.shape[1])
        part /= np.abs(part).max(axis=1, keepdims=True)
        x[at : at + SIDE] = part / np.sqrt((part * part).sum(axis=1, keepdims=True))
    return x


def reach_of(threshold, dimensions, sigmas=SIGMAS):
    """How far from a boundary a vector still visits the other side."""
    half = math.sqrt(2 - 2 * threshold) / 2
    return half * min(1.0, sigmas / math.sqrt(dimensions))


def fitted(x, k, threshold, rounds=12):
    """Spherical k-means: at most ``k`` unit centers, no two of them nearer to each other than the threshold."""

    def apart(rows):
        held = rows[:1]
        for row in rows[1:]:
            if len(held) < k and (held @ row).max() < threshold:
                held = np.vstack((held, row))
        return held

    centers = apart(x)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + SIDE] @ centers.T).argmax(axis=1) for i in range(0, len(x), SIDE)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centers)
        if np.abs(moved - centers).max() < 1e-6:
            break
        centers = moved
    return apart(centers)


_CELL = ["label", "dim", "path"]


def _visits(x, centers, threshold, sigmas):
    """The home of each vector, and which cells it enters."""
    score = x @ centers.T
    home = score.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T)) * reach_of(threshold, x.shape[1], sigmas)
    return home, score[np.arange(len(x)), home][:, None] - score <= gap[home]


def _fit(threshold, target, sigmas):
    def run(key, table):
        order = np.argsort(table.column("h1").to_numpy(), kind="stable")
        x = units(table.column("e"))[order]
        n = table.column("members")[0].as_py()
        k = max(2, min(-(-n // target), len(x) // PER_CENTER))
        centers = fitted(x, k, threshold)
        # of the products without the cut
        left = sum((_visits(x[i : i + SIDE], centers, threshold, sigmas)[1].sum(axis=0) for i in range(0, len(x), SIDE)), np.zeros(len(centers)))
        left = float(((left / len(x)) ** 2).sum())
        held = [pa.array([k.as_py()], table.schema.field(c).type) for k, c in zip(key, _CELL)]
        return pa.Table.from_arrays([*held, pa.array([centers.ravel()]), pa.array([left])], names=[*_CELL, "centers", "left"])

    return run


def _enter(cuts, threshold, sigmas, schema):
    """Arrow batches of classes, repeated per cell entered."""

    def entered(rows, key):
        centers = cuts.get(key)
        if centers is None:
            yield from rows.select(schema.names).cast(schema).to_batches()
            return
        home, visits = _visits(units(rows.column("e")), centers, threshold, sigmas)
        # the cells a row is in, its home first
        before = rows.column("trail").to_pylist()
        trail = np.array([f"{before[i]}/{';'.join(map(str, [home[i], *np.flatnonzero(v)]))}" for i, v in enumerate(visits)], object)
        for c in np.flatnonzero(visits.any(axis=0)):
            at, path = np.flatnonzero(visits[:, c]), f"{key[2]}/{c}"
            out = rows.take(pa.array(at))
            out = out.set_column(out.schema.get_field_index("path"), "path", pa.array([path] * len(at)))
            out = out.set_column(out.schema.get_field_index("trail"), "trail", pa.array(trail[at], pa.string()))
            yield from entered(out, (*key[:2], path))

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            label, dim = rows.column("label"), rows.column("dim")
            rest = np.ones(len(rows), bool)
            for key in cuts:
                if not key[2]:
                    here = pc.and_(pc.equal(label, pa.scalar(key[0], label.type)), pc.equal(dim, key[1])).to_numpy()
                    if here.any():
                        rest &= ~here
                        yield from entered(rows.filter(pa.array(here)), key)
            if rest.any():
                yield from rows.filter(pa.array(rest)).to_batches()

    return run


def entered(classes, cuts, threshold, sigmas):
    """``classes`` with ``path`` (the cell) and ``trail`` (per level the home and all cells entered), repeated per cell entered."""
    from pyspark.sql.pandas.types import to_arrow_schema

    members = classes.withColumns({"path": F.lit(""), "trail": F.lit("")})
    return members.mapInArrow(_enter(cuts, threshold, sigmas, to_arrow_schema(members.schema)), members.schema) if cuts else members


def cells(classes, threshold, target, sample, sigmas):
    """The centers of every cell that is cut, by label, length and path: few, as a cell that is cut has over ``target`` classes."""
    cuts, tried = {}, set()
    for _ in range(LEVELS):
        members = entered(classes, cuts, threshold, sigmas)
        sizes = members.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > target)
        large = [row for row in sizes.collect() if row[:3] not in tried]
        if not large:
            break
        tried |= {row[:3] for row in large}
        chosen = members.join(F.broadcast(classes.sparkSession.createDataFrame(large, sizes.schema)), _CELL)
        wanted = F.greatest(F.lit(1), F.ceil(F.col("members") / F.least(F.lit(sample), F.ceil(F.col("members") / target) * 8 * PER_CENTER)))
        fit_on = chosen.filter(F.pmod(F.xxhash64("h1", F.lit(7)), wanted) == 0).select(*_CELL, "h1", "e", "members")
        kind = f"label {classes.schema['label'].dataType.simpleString()}, dim int, path string, centers array<double>, left double"
        found = fit_on.groupBy(*_CELL).applyInArrow(_fit(threshold, target, sigmas), kind).collect()
        # what one center holds cannot be cut
        paid = {row[:3]: np.array(row["centers"]).reshape(-1, row["dim"]) for row in found if len(row["centers"]) > row["dim"] and row["left"] <= PAYS}
        if not paid:
            break
        cuts |= paid
    return cuts


def _first_meeting(a, b, path):
    """Whether ``path`` is the first cell in which two rows of these trails are compared: one of them at home there."""
    for x, y, at in zip(a.split("/")[1:], b.split("/")[1:], path.split("/")[1:]):
        x, y = [list(map(int, t.split(";"))) for t in (x, y)]
        at_home = [h for h, others in ((x[0], y), (y[0], x)) if h in others]
        if not at_home or int(at) != min(at_home):
            return False
    return True


_FOUND = [("lead", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("r_lead", pa.int64()), ("r_h1", pa.int64()), ("r_h2", pa.int64())]
_FOUND_DDL = "lead bigint, h1 bigint, h2 bigint, n bigint, r_lead bigint, r_h1 bigint, r_h2 bigint"


def _linked_pairs(x, left, right, threshold):
    """Positions of the vectors of ``left`` and ``right`` (as positions in ``x``) that are linked, product by product."""
    # what single precision may add to or take from a product of unit vectors
    error = (x.shape[1] + 8) * 1.2e-7
    xl, xr = x[left].astype(np.float32), x[right].astype(np.float32)
    same = left is right
    for a in range(0, len(left), SIDE):
        for b in range(a if same else 0, len(right), SIDE):
            product = xl[a : a + SIDE] @ xr[b : b + SIDE].T
            at = np.flatnonzero(product >= threshold - error)
            if not len(at):
                continue
            unsure = product.ravel()[at] < threshold + error
            i, j = np.divmod(at, product.shape[1])
            i, j = left[a + i], right[b + j]
            if same and a == b:
                upper = i < j
                i, j, unsure = i[upper], j[upper], unsure[upper]
            held = np.ones(len(i), bool)
            near = np.flatnonzero(unsure)
            for at in range(0, len(near), 1 << 16):
                part = near[at : at + (1 << 16)]
                exact = np.einsum("nd,nd->n", x[i[part]], x[j[part]])
                held[part] = exact >= threshold
                # a product so near to the threshold that the order of its sum matters is summed exactly
                for n in part[np.abs(exact - threshold) < 1e-12]:
                    held[n] = math.fsum(x[i[n]] * x[j[n]]) >= threshold
            yield i[held], j[held]


def _join_roots(root, i, j):
    """Joins the components of the pairs; ``root`` has the smallest position of each component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _products(threshold):
    def run(key, table):
        low, high = key[-2].as_py(), key[-1].as_py()
        ids = np.stack([table.column(c).to_numpy() for c in ("lead", "h1", "h2")], axis=1)
        order = np.lexsort(ids.T[::-1])
        ids, m, block = ids[order], table.column("m").to_numpy()[order], table.column("block").to_numpy()[order]
        x = units(table.column("e"))[order]
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        path = key[2].as_py()
        if path:
            kinds, trail = np.unique(np.array(table.column("trail").to_pylist(), object)[order].astype(str), return_inverse=True)
        n, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for i, j in _linked_pairs(x, left, right, threshold):
            if path and len(i):
                met, back = np.unique(trail[i] * len(kinds) + trail[j], return_inverse=True)
                first = np.array([_first_meeting(kinds[c // len(kinds)], kinds[c % len(kinds)], path) for c in met])[back]
                i, j = i[first], j[first]
            np.add.at(n, i, m[j])
            np.add.at(n, j, m[i])
            root = _join_roots(root, i, j)
        at = np.flatnonzero(n)
        columns = [*ids[at].T, n[at], *ids[root[at]].T]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], schema=pa.schema(_FOUND))

    return run


def linked(members, threshold, block=BLOCK):
    """Per class and pair of blocks: copies linked with it, and the smallest class it reaches there."""
    rows = F.least(F.lit(block), F.greatest(F.lit(1024), F.floor(BLOCK_BYTES / (8 * F.col("dim")))))
    count = F.count(F.lit(1))
    sizes = saved(members.groupBy(*_CELL).agg(count.alias("members")).withColumn("blocks", F.ceil(F.col("members") / rows).cast("int")), "cells")
    size = F.col("members").cast("double")
    held, sent, pairs = sizes.agg(F.sum(size), F.sum(size * F.col("blocks")), F.sum(size * size / 2)).first()
    rounds = tasks_for(sent, max(ROUND * (held or 0), ROUND_ROWS))
    # cells of more than one block are few, as they are large
    dealt = members.join(F.broadcast(sizes.filter("blocks > 1").select(*_CELL, "blocks")), _CELL, "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod("h1", F.col("blocks")).cast("int"))
    low, high = lambda other: F.least("block", other), lambda other: F.greatest("block", other)
    turn = lambda other: F.pmod(F.xxhash64(*_CELL, low(other), high(other)), F.lit(rounds))
    pair = [*_CELL, "low", "high"]
    tasks = max(parallelism(members.sparkSession), tasks_for((pairs or 0) / rounds, TASK_PAIRS))

    def of_round(k):
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        sent = dealt.withColumn("other", F.explode(others if rounds == 1 else F.filter(others, lambda other: turn(other) == k)))
        sent = sent.withColumns({"low": low(F.col("other")), "high": high(F.col("other"))})
        sent = sent.select(*pair, "lead", "h1", "h2", "m", "block", "trail", "e").repartition(tasks, *pair)
        return saved(sent.groupBy(*pair).applyInArrow(_products(threshold), _FOUND_DDL), "found")

    return reduce(lambda a, b: a.unionByName(b), [of_round(k) for k in range(rounds)])


def near_vectors(rows, id="vec_id", vector="embedding", label="label", threshold=THRESHOLD, target=TARGET, sample=SAMPLE, block=BLOCK, sigmas=SIGMAS):
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``."""
    e = F.col(vector)
    infinite = F.lit(float("inf"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    usable = F.coalesce(F.col(id).isNotNull() & F.col(label).isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    slim = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), e.alias("e"), usable.alias("usable"))
    alone = slim.filter(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    slim = slim.filter("usable").withColumns({"h1": F.xxhash64("label", "e"), "h2": F.xxhash64(F.lit(1), "label", "e")})

    classes = slim.groupBy("label", "h1", "h2").agg(F.min("id").cast("long").alias("lead"), F.count(F.lit(1)).alias("m"), F.first("e").alias("e"))
    classes = saved(classes.withColumn("dim", F.size("e")), "classes")
    cuts = cells(classes, threshold, target, sample, sigmas)
    found = linked(entered(classes, cuts, threshold, sigmas), threshold, block)
    node = lambda *c: F.struct(*[F.col(x).alias(y) for x, y in zip(c, ("lead", "h1", "h2"))])
    links = found.select(node("lead", "h1", "h2").alias("a"), node("r_lead", "r_h1", "r_h2").alias("b")).filter("a <> b")
    reached = components(written(links.distinct(), "links")).select(F.col("doc.h1").alias("h1"), F.col("doc.h2").alias("h2"), F.col("c.lead").alias("least"))
    sums = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    known = classes.select("h1", "h2", "lead", "m").join(sums, ["h1", "h2"], "left").join(reached, ["h1", "h2"], "left")
    parts = F.ceil(F.col("m") / SHARE).cast("int").alias("parts")
    known = known.select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "lead").alias("component_id"), parts)
    known = saved(known, "known")
    # a vector of very many copies is dealt to several tasks; such vectors are few
    part_of = lambda parts: F.pmod(F.xxhash64("id"), F.coalesce(parts, F.lit(1))).cast("int")
    rows = slim.select("id", "h1", "h2").join(F.broadcast(known.filter("parts > 1").select("h1", "h2", "parts")), ["h1", "h2"], "left")
    rows = rows.withColumn("part", part_of(F.col("parts"))).drop("parts")
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    out = rows.join(known, ["h1", "h2", "part"])
    out = out.select("id", "n_links", F.col("component_id").cast(slim.schema["id"].dataType).alias("component_id")).unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id), "n_links", "component_id", kept.alias("kept"))
