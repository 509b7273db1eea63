"""N-gram Jaccard self-join by vertical partitioning of the shingle order.

A document's set is its distinct shingles of ``k`` lower-cased words (a shorter document: its whole sequence), as 64-bit
hashes. The hash order is cut into fragments; a fragment holds, of every document, the part of the set that falls in
it. Work is done fragment by fragment on packed arrays and summed per document or per pair:

1. ``sizes``: every fragment counts, per document, the shingles that some other document has too. A document that links
   to another shares ``threshold`` of its set with it, so one with a smaller sum of shared shingles has no link; most
   documents end here. Each task first merges what it has itself, so copies in it are sent once. The number of
   fragments follows the bytes of the texts, so a fragment does not grow with the table.
2. Equal sets are one class with a number of its own; its smallest id leads it. Only classes go on.
3. Candidates: shingles are ordered by rarity among the classes left, and the necessary prefixes are joined, with
   bounds from lengths and positions. First each class meets the first and the previous one of each of its prefix
   shingles; linked classes become components. Then only classes of different components meet, so a large group of
   near copies costs its shingles, not its pairs, and no link between components is missed.
4. Overlaps of candidate pairs: pairs are put into blocks, a block gets the sets of its own documents only, cut into
   ``PIECES`` vertical fragments, each counted in a group of its own. The counts are summed per pair and links are
   decided on the sums, in integers.
5. Components: smallest label by hooking and pointer jumping over the links.

Null, empty and blank texts have no words: empty set, no link. Rows with equal ids count as one document holding the
set of each row: its sets are joined by the id, and each keeps its own links. A null id gives a row of its own with a
null component and takes no part. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.llm.common import chunks, free_name, mix64, numbered_by, parallelism, shingle_hashes, slices, word_hashes, written
from terracell.plans.skew import salted_join, split_hot

K = 4
THRESHOLD = 85  # per cent
CHUNK_BYTES = 4 << 20
FRAGMENT_BYTES = 16 << 20
BLOCK = 4096
BLOCK_SHINGLES = 4 << 20
PIECES = 8
MEETING = 4096
LIST = 500
SMALL = 500_000
SHIFT = np.uint64(18)  # a shingle's first 46 bits, with the document's number in its chunk below


def _sets(texts, k):
    """Sorted distinct shingle hashes of each text, concatenated, with the starts."""
    words, starts = word_hashes(texts)
    h, starts = shingle_hashes(words, starts, k)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def _prints(h, sizes):
    """Two sums over the hashes of each set: with its size they tell sets apart."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))[ends] for x in (h, mix64(h.copy()))]
    return np.stack([x[1:] - x[:-1] for x in sums], axis=1)


# --- 1: shared shingles per document ---

_PARTS = pa.schema([("fragment", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary())])
_PARTS_DDL = "fragment int, chunk bigint, tokens binary, docs binary"
HEADER = -1


def _pack(ascending):
    """Differences, in four bytes each where they fit."""
    gaps = np.diff(ascending, prepend=np.uint64(0))
    return gaps.astype("<u4").tobytes() + b"4" if gaps.max() < 1 << 32 else gaps.tobytes() + b"8"


def _unpack(packed):
    return np.cumsum(np.frombuffer(packed[:-1], "<u4" if packed[-1:] == b"4" else "<u8"), dtype=np.uint64)


def _fragments(k, fragments):
    """A task's shingles by fragment. ``tokens`` are packed 46-bit hashes; ``docs`` the document of each, or 65535 for a
    shingle that two documents of the chunk share, which those have counted already."""

    def part(chunk, ids, texts):
        h, doc, sizes = _sets(texts, k)
        prints = _prints(h, sizes)
        key = np.sort((h >> SHIFT << SHIFT) | doc.astype(np.uint64))
        token, owner = key >> SHIFT, (key & np.uint64(0xFFFF)).astype(np.uint16)
        # a token twice in one document (cut off bits) counts as shared: never too few
        same = token[1:] == token[:-1]
        first, shared = np.ones(len(key), bool), np.zeros(len(key), bool)
        first[1:] = ~same
        shared[1:] |= same
        shared[:-1] |= same
        counts = np.bincount(owner[shared], minlength=len(ids)).astype(np.int64)
        owner[shared] = 65535
        token, owner = token[first], owner[first]
        bounds = (np.arange(fragments) * ((1 << 46) // fragments)).astype(np.uint64)
        cut = np.searchsorted(token, bounds[1:])
        header = np.array([-(1 << 62) if i is None else i for i in ids], np.int64).tobytes() + sizes.tobytes() + prints.tobytes() + counts.tobytes()
        rows = [(HEADER - chunk % fragments, chunk, header, b"")]
        parts = zip(np.split(token, cut), np.split(owner, cut))
        rows += [(f, chunk, _pack(t - bounds[f]), o.tobytes()) for f, (t, o) in enumerate(parts) if len(t)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(chunks(batches, CHUNK_BYTES)):
            yield part(base + n, ids, texts)

    return run


_COUNTS = pa.schema([("chunk", pa.int64()), ("header", pa.binary()), ("docs", pa.binary())])


def _shared(key, table):
    """Per chunk the documents of the fragment's tokens that another chunk has too, one entry per token."""
    names, tokens, docs = (table.column(c).to_pylist() for c in ("chunk", "tokens", "docs"))
    if key[0].as_py() < 0:
        return pa.table({"chunk": names, "header": tokens, "docs": docs}, schema=_COUNTS)
    token = np.concatenate([_unpack(t) for t in tokens])
    sizes, owner = np.array([len(o) // 2 for o in docs]), np.concatenate([np.frombuffer(o, np.uint16) for o in docs])
    at = np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(token), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    hit &= owner != 65535
    at, owner = at[hit], owner[hit]
    ends = np.searchsorted(at, np.arange(len(names) + 1))
    out = [(c, None, owner[ends[i] : ends[i + 1]].tobytes()) for i, c in enumerate(names) if ends[i + 1] > ends[i]]
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_COUNTS)], schema=_COUNTS)


_SIZES = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("shared", pa.int64())])


def _summed(key, table):
    """Sum the fragments of a chunk: one row per document."""
    headers = [h for h in table.column("header").to_pylist() if h]
    raw = np.frombuffer(headers[0], np.int64)
    m = len(raw) // 5
    ids, sizes, prints, shared = raw[:m], raw[m : 2 * m], raw[2 * m : 4 * m].reshape(m, 2), raw[4 * m :].copy()
    for docs in table.column("docs").to_pylist():
        if docs:
            shared += np.bincount(np.frombuffer(docs, np.uint16), minlength=m)
    ids = pa.array(ids, pa.int64(), mask=ids == -(1 << 62))
    return pa.table([ids, *map(pa.array, (sizes, prints[:, 0].copy(), prints[:, 1].copy(), shared))], schema=_SIZES)


def sizes(docs, k, fragments):
    """Per row of ``docs`` (``doc``, ``text``): set size, fingerprint of the set, and number of shared shingles."""
    parts = docs.mapInArrow(_fragments(k, fragments), _PARTS_DDL)
    counted = parts.groupBy("fragment").applyInArrow(_shared, "chunk bigint, header binary, docs binary")
    return counted.groupBy("chunk").applyInArrow(_summed, "doc bigint, n bigint, p bigint, q bigint, shared bigint")


# --- 2 and 3: sets of the classes left, prefixes ---


def _tokens(k):
    def run(batches):
        for ids, texts in chunks(batches, CHUNK_BYTES):
            h, doc, n = _sets(texts, k)
            parts, prints = np.split(h, np.cumsum(n)[:-1]), _prints(h, n).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), *(pa.array(np.ascontiguousarray(x)) for x in prints.T), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc", "n", "p", "q", "tokens"],
            )

    return run


def _segments(fragments):
    """(doc, tokens) as rows (fragment, docs, sizes, tokens), one per chunk and fragment."""

    def run(batches):
        for docs, packed in chunks(batches, CHUNK_BYTES):
            docs = np.array(docs, np.int64)
            token = np.concatenate([np.frombuffer(t, np.uint64) for t in packed])
            at = np.repeat(np.arange(len(docs)), [len(t) // 8 for t in packed])
            f = (token.astype(np.float64) * (fragments / 2.0**64)).astype(np.int32)
            np.minimum(f, fragments - 1, out=f)
            order = np.argsort(f, kind="stable")
            f, token, owner = f[order], token[order], docs[at[order]]
            ends = np.searchsorted(f, np.arange(fragments + 1))
            rows = [(i, owner[a:b].tobytes(), token[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["fragment", "docs", "tokens"],
            )

    return run


_RARE = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])


def _frequencies(buckets):
    """The fragment's shingles that two or more documents have, with how many have them, by bucket of documents."""

    def run(key, table):
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        _, back, counts = np.unique(token, return_inverse=True, return_counts=True)
        count = counts[back]
        order = np.flatnonzero(count > 1)
        bucket = doc[order] % buckets
        order, bucket = order[np.argsort(bucket, kind="stable")], np.sort(bucket)
        doc, token, count = doc[order], token[order], count[order].astype(np.int64)
        used, starts = np.unique(bucket, return_index=True)
        cut = lambda x: pa.array([part.tobytes() for part in np.split(x, starts[1:])] if len(used) else [], pa.binary())
        return pa.table([pa.array(used), cut(doc), cut(token), cut(count)], schema=_RARE)

    return run


_PREFIX = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("i", pa.int64())])


def _prefix(threshold):
    """The necessary prefixes of a bucket's documents in rarity order, without shingles that only one has."""

    def run(key, rare, sized):
        if not rare.num_rows:
            return _PREFIX.empty_table()
        doc, token, count = (
            np.concatenate([np.frombuffer(x, kind) for x in rare.column(c).to_pylist()]) for c, kind in (("docs", np.int64), ("tokens", np.uint64), ("counts", np.int64))
        )
        order = np.lexsort((token, count, doc))
        doc, token = doc[order], token[order]
        ids, starts, shared = np.unique(doc, return_index=True, return_counts=True)
        known, sizes = sized.column("doc").to_numpy(), sized.column("n").to_numpy()
        by = np.argsort(known)
        n = sizes[by][np.searchsorted(known[by], ids)]
        i = np.arange(len(doc)) - np.repeat(starts - (n - shared), shared)
        n = np.repeat(n, shared)
        inside = i < n - -(-threshold * n // 100) + 1
        return pa.table([pa.array(x[inside]) for x in (token.view(np.int64), doc, n, i)], schema=_PREFIX)

    return run


def _possible(a, b, threshold):
    """Bounds for documents that share a prefix shingle at positions ``i``: what stands before it in the common order
    and is not shared limits the overlap and adds to the union."""
    overlap = F.least(F.col(f"{a}.n") - F.col(f"{a}.i"), F.col(f"{b}.n") - F.col(f"{b}.i"))
    union = F.greatest(F.col(f"{a}.n") + F.col(f"{b}.n") - overlap, F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")))
    return overlap * 100 >= union * threshold


def _near(postings, threshold):
    """Each document with the first and the previous one of each of its prefix shingles.

    A shingle that many documents have is cut into lists of about ``LIST`` of them, all with the same first.
    """
    own = F.struct("doc", "n", "i").alias("own")
    heads = postings.groupBy("token").agg(F.min(F.struct("i", "n", "doc")).alias("_least"), F.count(F.lit(1)).alias("_many"))
    listed = salted_join(postings, heads, ["token"], salt_on=["doc"])
    listed = listed.withColumn("_list", F.pmod(F.xxhash64("doc"), F.ceil(F.col("_many") / LIST)))
    order = Window.partitionBy("token", "_list").orderBy("i", "n", "doc")
    head = F.struct(F.col("_least.doc").alias("doc"), F.col("_least.n").alias("n"), F.col("_least.i").alias("i")).alias("head")
    met = listed.select("doc", "n", "i", F.lag(F.struct("doc", "n", "i")).over(order).alias("prev"), head)
    pair = lambda other: met.select(own, F.col(other).alias("other")).filter(F.col("other.doc") != F.col("own.doc"))
    both = pair("prev").union(pair("head")).filter(_possible("own", "other", threshold))
    return _ordered(both, "own", "other")


def _ordered(df, a, b):
    """Pairs once, with the smaller id first."""
    low, high = F.col(f"{a}.doc") < F.col(f"{b}.doc"), lambda x, y: F.struct(x.alias("doc"), y.alias("n"))
    x, y = high(F.col(f"{a}.doc"), F.col(f"{a}.n")), high(F.col(f"{b}.doc"), F.col(f"{b}.n"))
    return df.select(F.when(low, x).otherwise(y).alias("x"), F.when(low, y).otherwise(x).alias("y")).select(
        F.col("x.doc").alias("a"), F.col("x.n").alias("na"), F.col("y.doc").alias("b"), F.col("y.n").alias("nb")
    ).distinct()


def _across(postings, labels, threshold):
    """Classes that share a prefix shingle and are in different components.

    Sharing a shingle at position i limits the size of a partner: the overlap is at most n - i. Of two rows that both
    would need a partner smaller than themselves none can be it, so one of each pair is ``early`` (it may have a partner
    of its own size), and only early rows are sent to the others. Partners differ by at most one band of sizes.
    """
    held = salted_join(postings, labels, ["doc"], "left", salt_on=["token"]).withColumn("c", F.coalesce("c", F.col("doc")))
    # shingles inside one component need no pairs at all
    span = held.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    held = salted_join(held, span, ["token"], salt_on=["doc"])
    # a partner has at most (n - i) * (1 + t) / t - n shingles
    early = (F.col("n") - F.col("i")) * (100 + threshold) >= F.col("n") * (2 * threshold)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold)) + 1e-9).cast("int") if threshold < 100 else F.lit(0)
    held = written(held.withColumns({"early": early, "band": band}), "across")
    sent = held.filter("early").withColumn("band", F.explode(F.array(*[F.col("band") + d for d in ((-1, 0, 1) if threshold < 100 else (0,))])))
    a, b = split_hot(sent, held, ["token", "band"], MEETING, ["doc"], ["doc"])
    a, b = a.alias("a"), b.alias("b")
    # two early rows meet once
    once = ~F.col("b.early") | (F.col("a.doc") < F.col("b.doc"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("token", "band", "_pl", "_pr")]
    on = same[0] & same[1] & same[2] & same[3] & (F.col("a.c") != F.col("b.c")) & once & _possible("a", "b", threshold)
    side = lambda x: F.struct(F.col(f"{x}.doc").alias("doc"), F.col(f"{x}.n").alias("n"), F.col(f"{x}.i").alias("i")).alias(x)
    return _ordered(a.join(b, on).select(side("a"), side("b")), "a", "b")


# --- 4: overlaps per block of pairs and fragment, summed per pair ---

_BLOCKS = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("a", "na", "b", "nb"))])
_BLOCKS_DDL = "block bigint, a binary, na binary, b binary, nb binary"


def _blocks(batches):
    """Pairs in blocks of at most ``BLOCK`` pairs and about ``BLOCK_SHINGLES`` shingles."""
    base, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        columns = [np.array(c.to_pylist(), np.int64) for c in batch.columns]
        weight = np.cumsum(columns[1] + columns[3])
        i = 0
        while i < len(weight):
            before = weight[i - 1] if i else 0
            j = max(i + 1, min(i + BLOCK, int(np.searchsorted(weight, before + BLOCK_SHINGLES, side="right"))))
            yield pa.RecordBatch.from_arrays([pa.array([base + n]), *(pa.array([c[i:j].tobytes()], pa.binary()) for c in columns)], schema=_BLOCKS)
            n, i = n + 1, j


def _members(batches):
    """The documents of each block."""
    for batch in batches:
        for block, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b"))):
            docs = np.unique(np.frombuffer(a + b, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), block)), pa.array(docs)], names=["block", "doc"])


def _pieces(batches):
    """(block, doc, tokens) cut into the fragments of the block."""
    for batch in slices(batches):
        rows = []
        for block, doc, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            token = np.frombuffer(tokens, np.uint64)
            ends = np.searchsorted(token, (np.arange(1, PIECES) * (2**64 // PIECES)).astype(np.uint64))
            rows += [(block, f, doc, part.tobytes()) for f, part in enumerate(np.split(token, ends)) if len(part)]
        kinds = (("block", pa.int64()), ("fragment", pa.int32()), ("doc", pa.int64()), ("tokens", pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


_OVERLAPS = pa.schema([("block", pa.int64()), ("counts", pa.binary())])


def _overlaps(key, segments, pairs):
    """Overlap of each pair of a block inside one fragment."""
    if not segments.num_rows or not pairs.num_rows:
        return _OVERLAPS.empty_table()
    ids = segments.column("doc").to_numpy()
    parts = [np.frombuffer(x, np.uint64) for x in segments.column("tokens").to_pylist()]
    order = np.argsort(ids)
    ids, sizes = ids[order], np.array([len(parts[i]) for i in order])
    _, token = np.unique(np.concatenate([parts[i] for i in order]), return_inverse=True)
    starts, width = np.cumsum(sizes) - sizes, np.int64(len(token) + 1)
    # keys (pair, token) of both sides, sorted together: equal neighbours are common shingles
    sides = [np.frombuffer(pairs.column(c)[0].as_py(), np.int64) for c in ("a", "b")]
    counts = np.zeros(len(sides[0]), np.int64)
    for low in range(0, len(counts), 512):
        keys = []
        for side in sides:
            side = side[low : low + 512]
            at = np.minimum(np.searchsorted(ids, side), len(ids) - 1)
            size = np.where(ids[at] == side, sizes[at], 0)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            keys.append(np.repeat(np.arange(low, low + len(side)), size) * width + token[np.repeat(starts[at], size) + inside])
        both = np.sort(np.concatenate(keys))
        counts += np.bincount(both[1:][both[1:] == both[:-1]] // width, minlength=len(counts))
    return pa.table([pa.array([key[0].as_py()]), pa.array([counts.astype(np.int32).tobytes()], pa.binary())], schema=_OVERLAPS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _decide(threshold):
    def run(key, counted, pairs):
        if not pairs.num_rows or not counted.num_rows:
            return _LINKS.empty_table()
        a, na, b, nb = (np.frombuffer(pairs.column(c)[0].as_py(), np.int64) for c in ("a", "na", "b", "nb"))
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in counted.column("counts").to_pylist())
        linked = 100 * total >= threshold * (na + nb - total)
        return pa.table([pa.array(a[linked]), pa.array(b[linked])], schema=_LINKS)

    return run


def verified(pairs, held, threshold):
    """The pairs (``a``, ``na``, ``b``, ``nb``) whose sets, of ``held`` (``doc``, ``tokens``), reach the threshold.

    Blocks are written: they are numbered by task and order of rows, which a replay must not change. Pairs of one
    document stand side by side, so its set is sent to few blocks.
    """
    ranged = pairs.repartitionByRange(parallelism(pairs.sparkSession), "a", "b").sortWithinPartitions("a", "b")
    blocks = written(ranged.mapInArrow(_blocks, _BLOCKS_DDL), "blocks")
    wanted = blocks.mapInArrow(_members, "block bigint, doc bigint")
    sent = wanted.join(held.select("doc", "tokens"), "doc").select("block", "doc", "tokens")
    sent = sent.mapInArrow(_pieces, "block bigint, fragment int, doc bigint, tokens binary")
    each = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("fragment")
    spread = blocks.select(F.col("block").alias("block"), each, F.col("a").alias("a"), F.col("b").alias("b"))
    counted = sent.groupBy("block", "fragment").cogroup(spread.groupBy("block", "fragment")).applyInArrow(_overlaps, "block bigint, counts binary")
    whole = blocks.select(*[F.col(c).alias(c) for c in _BLOCKS.names])
    return counted.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(_decide(threshold), "a bigint, b bigint")


# --- 5: components ---


def components(links):
    """``doc`` and the smallest ``c`` reachable, for every document with a link."""
    ends = links.select(F.col("a").alias("doc")).union(links.select("b"))
    labels = written(ends.distinct().select("doc", F.col("doc").alias("c")), "labels")
    edges = links
    while True:
        edges = written(edges.filter("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m")).select("doc", F.least("doc", "m").alias("c"))
        hook = written(hook, "hooks")
        while True:
            # pointer jumping until every root points to itself
            up = hook.select(F.col("doc").alias("u"), F.col("c").alias("r"))
            jumped = written(hook.join(up, hook["c"] == up["u"], "left").select("doc", F.coalesce("r", "c").alias("r"), "c"), "jumps")
            moved = not jumped.filter("r <> c").isEmpty()
            hook = jumped.select("doc", F.col("r").alias("c"))
            if not moved:
                break
        to = hook.select(F.col("doc").alias("u"), F.col("c").alias("r"))
        labels = written(labels.join(to, labels["c"] == to["u"], "left").select("doc", F.coalesce("r", "c").alias("c")), "labels")
        edges = edges.join(to, edges["a"] == to["u"], "left").select(F.coalesce("r", "a").alias("a"), "b")
        edges = edges.join(to, edges["b"] == to["u"], "left").select("a", F.coalesce("r", "b").alias("b"))


def _joined_by_id(full, sets):
    """Links between the sets of an id that holds several."""
    print_ = F.struct("n", "p", "q")
    several = full.groupBy("doc").agg(F.min(print_).alias("lo"), F.max(print_).alias("hi")).filter("lo <> hi").select("doc", "lo")
    own = salted_join(full.select("doc", "n", "p", "q"), several, ["doc"], salt_on=["n", "p", "q"]).distinct()
    first = sets.select(F.struct("n", "p", "q").alias("lo"), F.col("key").alias("a"))
    return own.join(sets.select("n", "p", "q", F.col("key").alias("b")), ["n", "p", "q"]).join(first, "lo").select("a", "b").filter("a <> b")


def classes(docs, id="doc_id", text="text", k=K, threshold=THRESHOLD, fragments=None, small=SMALL):
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    if not fragments:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        fragments = max(16, 2 * parallelism(docs.sparkSession), -(-held // FRAGMENT_BYTES))
    sized = written(sizes(rows, k, fragments), "sizes")
    # equal sets are one class: n and two sums over the hashes
    full = sized.filter("n > 0 and doc is not null")
    sets = full.groupBy("n", "p", "q").agg(F.min("doc").alias("lead"), F.max("shared").alias("shared"))
    sets = written(numbered_by(sets, ["p", "q", "n"], "key"), "sets")
    left = written(sets.filter(F.col("shared") * 100 >= F.col("n") * threshold).select("key", "lead", "n", "p", "q"), "left")
    leads = left.select(F.col("lead").alias("doc")).distinct()
    leads = F.broadcast(leads) if left.count() <= small else leads
    found = rows.join(leads, "doc", "left_semi").mapInArrow(_tokens(k), "doc bigint, n bigint, p bigint, q bigint, tokens binary")
    found = found.join(left.withColumnRenamed("lead", "doc"), ["doc", "n", "p", "q"])
    # the rows of an id may repeat a set
    held = written(found.groupBy(F.col("key").alias("doc")).agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets-left")

    segments = held.select("doc", "tokens").mapInArrow(_segments(fragments), "fragment int, docs binary, tokens binary")
    rare = segments.groupBy("fragment").applyInArrow(_frequencies(fragments), "bucket bigint, docs binary, tokens binary, counts binary")
    sized_left = held.select("doc", "n", F.pmod("doc", F.lit(fragments)).alias("bucket"))
    postings = rare.groupBy("bucket").cogroup(sized_left.groupBy("bucket")).applyInArrow(_prefix(threshold), "token bigint, doc bigint, n bigint, i bigint")
    postings = written(postings, "postings")

    near = written(verified(_near(postings, threshold), held, threshold), "near")
    first = components(near)
    across = verified(_across(postings, first, threshold), held, threshold)
    links = written(near.union(across).union(_joined_by_id(full, sets)), "links")
    labels = components(links)

    led = labels.join(sets.select(F.col("key").alias("doc"), "lead"), "doc")
    least = led.groupBy("c").agg(F.min("lead").alias("least"))
    roots = written(sets.join(labels.withColumnRenamed("doc", "key").join(least, "c"), "key", "left").select("n", "p", "q", F.coalesce("least", "lead").alias("root")), "roots")
    own = salted_join(full.select("doc", "n", "p", "q"), roots, ["n", "p", "q"], salt_on=["doc"]).groupBy("doc").agg(F.min("root").alias("root"))
    out = sized.join(own, "doc", "left")
    return out.select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))


def distinct_documents(docs, id="doc_id", text="text", small=SMALL, **options):
    """One document per component, that of the smallest id, with its own columns; documents without an id stay."""
    out = written(classes(docs, id, text, small=small, **options), "classes")
    gone = written(out.filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("_gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= small else gone
    key = free_name(docs, "_gone")
    gone = gone.withColumnRenamed("_gone", key)
    return docs.join(gone, docs[id] == gone[key], "left_anti")
