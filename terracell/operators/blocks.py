"""Rasters as blocks: one row per square of cells, one array per channel, borders exchanged as strips of arrays.

A block row holds its keys, its place ``br``/``bc`` in the raster, its size ``h`` x ``w`` and a row-major array of
doubles per channel. Inside an array NULL is a cell that has no row and NaN a cell without a value (NULL, NaN or
infinite in the cells); ``to_cells`` turns both back. Operators that look at neighbours get each block with a border of
``n`` cells: a block sends strips of ``n`` rows or columns to the eight blocks around it, so what is exchanged per block
is its own arrays and its rim, never a row per cell, and what a task holds at a time is one Arrow batch of blocks.

Columns other than keys and channels are left out. An empty table gives an empty table.
"""

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell.operators.layers import is_value
from terracell.operators.metrics import COUNTS

BLOCK = 256
CELLS_OUT = 1 << 20  # cells of a batch that leaves a task
NEAR_COUNTS = (*COUNTS, "num_fp_f", "num_fn_f")


def _schema(df, keys, channels, numbers=("br", "bc", "h", "w")):
    numbers = [T.StructField(c, T.IntegerType()) for c in numbers]
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels]
    return T.StructType([*df.select(*keys).schema.fields, *numbers, *arrays])


def to_blocks(cells, keys, channels, block=BLOCK):
    """Cells to blocks of at most ``block`` x ``block``. Of a cell that occurs twice the greater value stays.

    The cells of a block are gathered before the exchange, one row per block and map task.
    """
    keys, channels = list(keys), list(channels)
    at = ((F.col("r") % block) * block + F.col("c") % block).cast("int")
    place = [F.floor(F.col(axis) / block).cast("int").alias(name) for axis, name in (("r", "br"), ("c", "bc"))]
    values = [F.when(is_value(ch), F.col(ch).cast("double")).otherwise(F.lit(float("nan"))).alias(ch) for ch in channels]
    lists = [F.collect_list(name).alias(name) for name in ("_at", *channels)]
    gathered = cells.select(*keys, *place, at.alias("_at"), *values).groupBy(*keys, "br", "bc").agg(*lists)
    return gathered.mapInArrow(partial(_dense, keys, channels, block), _schema(cells, keys, channels))


def to_cells(blocks, keys, channels, block=BLOCK):
    """Blocks to one row per cell, a column per channel."""
    keys, channels = list(keys), list(channels)
    zipped = F.arrays_zip(*[F.col(ch) for ch in channels])
    rows = blocks.select(*keys, "br", "bc", "w", F.posexplode(zipped).alias("_pos", "_cell"))
    rows = rows.filter(F.col(f"_cell.{channels[0]}").isNotNull())
    return rows.select(
        *keys,
        (F.col("br") * block + F.floor(F.col("_pos") / F.col("w"))).cast("int").alias("r"),
        (F.col("bc") * block + F.col("_pos") % F.col("w")).cast("int").alias("c"),
        *[F.nanvl(F.col(f"_cell.{ch}"), F.lit(None).cast("double")).alias(ch) for ch in channels],
    )


def map_blocks(blocks, keys, channels, fn, outputs, n=0, block=BLOCK):
    """``fn`` on each block with ``n`` cells around it; its arrays become the channels ``outputs``.

    ``fn`` takes an array (channel, h+2n, w+2n), NaN where there is no value or no cell, and a boolean array that is true
    where there is a cell; it returns one array of h x w per output.
    """
    bordered = with_border(blocks, keys, channels, n, block)
    run = partial(_mapped, list(keys), list(channels), fn, n, list(outputs))
    return bordered.mapInArrow(run, _schema(blocks, keys, outputs))


def fold_blocks(blocks, keys, channels, fn, names, n=0, block=BLOCK):
    """Sums over each raster: ``fn`` (as in ``map_blocks``) returns one whole number per name and block."""
    keys = list(keys)
    schema = T.StructType([*blocks.select(*keys).schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    bordered = with_border(blocks, keys, channels, n, block)
    parts = bordered.mapInArrow(partial(_folded, keys, list(channels), fn, n, list(names)), schema)
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def with_border(blocks, keys, channels, n, block=BLOCK):
    """Blocks with the strips of their neighbours: a list ``_pieces`` of at most nine arrays per block and channel."""
    keys, channels = list(keys), list(channels)
    if not 0 <= n <= block:
        raise ValueError(f"a border of {n} cells does not fit blocks of {block}")
    own = F.struct(F.lit(0).alias("_r"), F.lit(0).alias("_c"), "h", "w", *channels)
    if n == 0:
        return blocks.select(*keys, "br", "bc", F.array(own).alias("_pieces"))
    schema = _schema(blocks, keys, channels, ("br", "bc", "h", "w", "_r", "_c"))
    strips = blocks.mapInArrow(partial(_strips, keys, channels, n, block), schema)
    return strips.groupBy(*keys, "br", "bc").agg(F.collect_list(F.struct("_r", "_c", "h", "w", *channels)).alias("_pieces"))


# --- what the operators do with a block and its border ---


def slopes(blocks, keys, value="v", block=BLOCK):
    """``x_slope``, ``y_slope`` and ``gradient`` as ``neighbourhood.slopes`` has them, block to block."""
    return map_blocks(blocks, keys, [value], _slopes, ["x_slope", "y_slope", "gradient"], 1, block)


def tolerant_confusion(blocks, keys, n=1, p="p", t="t", block=BLOCK):
    """Confusion counts with near misses per raster, as ``metrics.tolerant_confusion`` has them."""
    return fold_blocks(blocks, keys, [p, t], partial(_near_counts, n), NEAR_COUNTS, n, block)


def extreme(blocks, keys, value, n, out, largest=True, block=BLOCK):
    """Greatest (or least) value in the (2n+1)² square around each cell, as ``neighbourhood.box_extreme`` has it."""
    return map_blocks(blocks, keys, [value], partial(_extreme_of_first, n, largest), [out], n, block)


def whole_rasters(blocks, keys, channels):
    """Blocks of the rasters that have a value in every channel of every cell; a raster that lacks one is left out."""
    gone = fold_blocks(blocks, keys, channels, _gone, ["_gone"]).filter("_gone > 0").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return blocks.join(gone, same, "left_anti")


def evaluation(blocks, keys, n=1, classes=range(23), score="score", cls="cls", block=BLOCK):
    """Counts of ``metrics.evaluation_table`` per raster, from channels of scores and labels; without a label none counts."""
    classes = list(classes)
    names = [*NEAR_COUNTS, *[f"target_val_{i}{end}" for i in classes for end in ("", "_correct")]]
    return fold_blocks(blocks, keys, [score, cls], partial(_evaluation, n, classes), names, n, block)


def score(blocks, keys, channels, predict, n=0, per_call=32, out="score", keep=(), block=BLOCK):
    """Scores of blocks that a model sees with ``n`` cells of context on each side.

    ``predict`` takes (k, channel, h+2n, w+2n) and returns (k, h+2n, w+2n), whose border is cut off, or (k, h, w).
    Blocks of equal shape share a call; calls are filled to ``per_call`` blocks across Arrow batches, and at most
    ``per_call`` of each of the last few shapes wait. NaN marks what has no value or lies outside the raster.
    The channels ``keep`` stay beside the scores; the model does not see them.
    """
    bordered = with_border(blocks, keys, [*channels, *keep], n, block)
    run = partial(_scored, list(keys), list(channels), list(keep), predict, n, per_call, out)
    return bordered.mapInArrow(run, _schema(blocks, keys, [out, *keep]))


# --- inside a task ---


def _lists(arrays, held):
    """Arrays of any shape as one Arrow column of lists; cells that are not held become NULL."""
    import numpy as np
    import pyarrow as pa

    sizes = np.cumsum([0, *[a.size for a in arrays]])
    flat = np.concatenate([a.ravel() for a in arrays])
    gaps = ~np.concatenate([a.ravel() for a in held])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.float64(), mask=gaps))


class _Rows:
    """Block rows on their way out: the keys are those of a row of ``batch``; a batch leaves when it holds enough cells."""

    def __init__(self, batch, keys, numbers, channels):
        self.batch, self.keys, self.numbers, self.channels = batch, keys, numbers, channels
        self.clear()

    def clear(self):
        self.rows, self.cells, self.held = [], 0, []
        self.values = {name: [] for name in (*self.numbers, *self.channels)}

    def add(self, row, numbers, arrays, held):
        self.rows.append(row)
        for name, x in (*zip(self.numbers, numbers), *zip(self.channels, arrays)):
            self.values[name].append(x)
        self.held.append(held)
        self.cells += held.size * len(self.channels)
        return self.leave() if self.cells >= CELLS_OUT else ()

    def leave(self):
        import pyarrow as pa

        if not self.rows:
            return ()
        taken = [self.batch.column(k).take(pa.array(self.rows, pa.int64())) for k in self.keys]
        numbers = [pa.array(self.values[name], kind) for name, kind in self.numbers.items()]
        lists = [_lists(self.values[ch], self.held) for ch in self.channels]
        out = pa.RecordBatch.from_arrays([*taken, *numbers, *lists], [*self.keys, *self.numbers, *self.channels])
        self.clear()
        return (out,)


def _numbers(*names, kind="int32"):
    import pyarrow as pa

    return {name: getattr(pa, kind)() for name in names}


def _unpacked(lists):
    """Function from a row of an Arrow list column to its values (NaN for NULL) and to where it is not NULL."""
    import numpy as np

    ends, inner = lists.offsets.to_numpy(), lists.values
    values = inner.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    held = np.asarray(inner.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    return lambda i: (values[ends[i] : ends[i + 1]], held[ends[i] : ends[i + 1]])


def _dense(keys, channels, block, batches):
    import numpy as np

    for batch in batches:
        out = _Rows(batch, keys, _numbers("br", "bc", "h", "w"), channels)
        place = list(zip(batch.column("br").to_pylist(), batch.column("bc").to_pylist()))
        at = _unpacked(batch.column("_at"))
        read = [_unpacked(batch.column(ch)) for ch in channels]
        for i in range(batch.num_rows):
            r, c = np.divmod(at(i)[0].astype("int64"), block)
            h, w = int(r.max()) + 1, int(c.max()) + 1
            held = np.zeros(h * w, dtype=bool)
            held[r * w + c] = True
            arrays = [np.full(h * w, np.nan) for _ in channels]
            for dense, values in zip(arrays, read):
                np.fmax.at(dense, r * w + c, values(i)[0])
            yield from out.add(i, (*place[i], h, w), arrays, held)
        yield from out.leave()


def _strips(keys, channels, n, block, batches):
    """Each block and its rim in eight directions, addressed to the block that needs it and placed in its frame."""
    import numpy as np

    span = lambda d, size: (0, size) if d == 0 else (0, min(n, size)) if d < 0 else (block - n, size)
    for batch in batches:
        out = _Rows(batch, keys, _numbers("br", "bc", "h", "w", "_r", "_c"), channels)
        place = list(zip(*[batch.column(name).to_pylist() for name in ("br", "bc", "h", "w")]))
        read = [_unpacked(batch.column(ch)) for ch in channels]
        for i, (br, bc, h, w) in enumerate(place):
            full = [values(i) for values in read]
            held = full[0][1].reshape(h, w)
            arrays = [values.reshape(h, w) for values, _ in full]
            for dr, dc in np.ndindex(3, 3):
                dr, dc = dr - 1, dc - 1
                (r0, r1), (c0, c1) = span(dr, h), span(dc, w)
                if r0 < r1 and c0 < c1 and br + dr >= 0 and bc + dc >= 0:
                    numbers = (br + dr, bc + dc, r1 - r0, c1 - c0, r0 - dr * block, c0 - dc * block)
                    yield from out.add(i, numbers, [a[r0:r1, c0:c1] for a in arrays], held[r0:r1, c0:c1])
        yield from out.leave()


def _framed(batch, channels, n):
    """For each block of a batch that is there itself: its row, size, stack of channels with border, and held cells."""
    import numpy as np

    pieces = batch.column("_pieces")
    ends, inner = pieces.offsets.to_pylist(), pieces.values
    place = list(zip(*[inner.field(name).to_pylist() for name in ("_r", "_c", "h", "w")]))
    read = [_unpacked(inner.field(ch)) for ch in channels]
    for i in range(batch.num_rows):
        rows = range(ends[i], ends[i + 1])
        own = [place[j][2:] for j in rows if place[j][:2] == (0, 0)]
        if not own:
            continue  # strips sent past the edge of a raster
        h, w = own[0]
        stack = np.full((len(channels), h + 2 * n, w + 2 * n), np.nan)
        held = np.zeros((h + 2 * n, w + 2 * n), dtype=bool)
        for j in rows:
            r, c, ph, pw = place[j]
            there = np.s_[r + n : r + n + ph, c + n : c + n + pw]
            lines, wide = held[there].shape  # a neighbour may reach past the frame of a ragged block
            for k, values in enumerate(read):
                piece, here = (a.reshape(ph, pw)[:lines, :wide] for a in values(j))
                stack[k][there] = piece
                if k == 0:
                    held[there] = here
        yield i, h, w, stack, held


def _inner(array, n, h, w):
    return array[..., n : n + h, n : n + w]


def _mapped(keys, channels, fn, n, outputs, batches):
    for batch in batches:
        out = _Rows(batch, [*keys, "br", "bc"], _numbers("h", "w"), outputs)
        for i, h, w, stack, held in _framed(batch, channels, n):
            yield from out.add(i, (h, w), fn(stack, held), _inner(held, n, h, w))
        yield from out.leave()


def _folded(keys, channels, fn, n, names, batches):
    for batch in batches:
        out = _Rows(batch, keys, _numbers(*names, kind="int64"), [])
        for i, _, _, stack, held in _framed(batch, channels, n):
            yield from out.add(i, [int(x) for x in fn(stack, held)], [], held)
        yield from out.leave()


def _scored(keys, channels, keep, predict, n, per_call, name, batches):
    import numpy as np
    import pyarrow as pa

    waiting = {}

    def call(shape):
        group = waiting.pop(shape)
        h, w = shape
        scores = np.asarray(predict(np.stack([stack[: len(channels)] for _, stack, _ in group])), dtype="float64")
        if scores.shape[1:] == (h + 2 * n, w + 2 * n):
            scores = _inner(scores, n, h, w)
        if scores.shape != (len(group), h, w):
            raise ValueError(f"scores of shape {scores.shape} for {len(group)} blocks of {h} x {w}")
        of_group = pa.concat_batches([row for row, _, _ in group])
        out = _Rows(of_group, of_group.schema.names, _numbers("h", "w"), [name, *keep])
        for i, (_, stack, held) in enumerate(group):
            yield from out.add(i, shape, [scores[i], *_inner(stack[len(channels) :], n, h, w)], held)
        yield from out.leave()

    for batch in batches:
        slim = batch.select([*keys, "br", "bc"])
        for i, h, w, stack, held in _framed(batch, [*channels, *keep], n):
            group = waiting.setdefault((h, w), [])
            group.append((slim.slice(i, 1), stack, _inner(held, n, h, w)))
            if len(group) == per_call:
                yield from call((h, w))
            elif len(waiting) > 4:
                yield from call(max(waiting, key=lambda shape: len(waiting[shape])))
    for shape in list(waiting):
        yield from call(shape)


def _slopes(stack, held):
    import numpy as np

    v = stack[0]
    core = v[1:-1, 1:-1]

    def central(before, after):
        b, a, has_b, has_a = v[before], v[after], held[before], held[after]
        one_sided = np.where(has_b, core - b, np.where(has_a, a - core, core - core))
        return np.where(has_b & has_a, ((core - b) + (a - core)) / 2.0, one_sided)

    x = central(np.s_[1:-1, :-2], np.s_[1:-1, 2:])
    y = -central(np.s_[:-2, 1:-1], np.s_[2:, 1:-1]) + 0.0  # no negative zero
    return x, y, np.sqrt(x * x + y * y)


def _extreme(a, n, largest=True):
    """Extremes of the squares of 2n+1 cells that lie inside ``a``; each pass doubles the reach."""
    import numpy as np

    pick = np.fmax if largest else np.fmin
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        reach, full = 1, 2 * n + 1
        while reach < full:
            step = min(reach, full - reach)
            a = pick(a[:-step], a[step:])
            reach += step
        a = np.moveaxis(a, 0, axis)
    return a


def _extreme_of_first(n, largest, stack, held):
    return [_extreme(stack[0], n, largest)]


def _near_counts(n, stack, held):
    import numpy as np

    h, w = held.shape[0] - 2 * n, held.shape[1] - 2 * n
    p, t = _inner(stack, n, h, w)
    most, least = [_extreme(a, n) for a in stack], [_extreme(a, n, False) for a in stack]
    both = ~np.isnan(p) & ~np.isnan(t)
    false_hit = (p == 1) & (t == 0) & (most[1] == 1) & (least[0] == 0)
    missed = (p == 0) & (t == 1) & (least[1] == 0) & (most[0] == 1)
    flags = (p == t, p == 1, t == 1, (p == 1) & (t == 1), both & (p != t), false_hit, missed)
    return [f.sum() for f in flags]


def _gone(stack, held):
    import numpy as np

    return [(held & np.isnan(stack).any(axis=0)).sum()]


def _evaluation(n, classes, stack, held):
    import numpy as np

    score, cls = stack
    p = np.where(np.isnan(score), np.nan, score >= 0.5)
    t = np.where(np.isnan(cls), np.nan, cls > 0)
    p[np.isnan(t)] = np.nan  # a cell without a label takes no part
    counts = _near_counts(n, np.stack([p, t]), held)
    h, w = held.shape[0] - 2 * n, held.shape[1] - 2 * n
    right, of = _inner(p == t, n, h, w), _inner(cls, n, h, w)
    for i in classes:
        counts += [(of == i).sum(), ((of == i) & right).sum()]
    return counts
