"""Divergence of sources: how far the word use of each (language, source) group is from that of its peers.

Terms are runs of letters and characters outside ASCII, with A-Z lower-cased. A language keeps the terms of at least
``least`` of its documents. With N the occurrences of kept terms in a group (or the whole language) and V the number of
kept terms, a term has p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); two groups differ in it by
floor((p - q)**2 / (p + q)). All of it is integer arithmetic.

``pairs`` sums the difference over all kept terms for each group and each other source of its language by Gustavson's
row accumulation: postings are dealt to buckets of terms, each bucket is a term-major index, and each group scatters its
own terms through that index into a dense accumulator with one cell per peer. No pair of postings is emitted, only a
bucket's accumulators. Terms that one or both sides lack have no posting, so their part is put in as a baseline: all V
terms count as lacking on both sides, each group's terms are corrected once per distinct p, and the scatter corrects
those that both have.

Null text, language and source count as empty. A document without terms still makes its group occur; a group or language
without kept terms differs by 0 from its peers if the language keeps none. Repeated rows are documents of their own. An
empty table gives no rows. Very long texts are counted piece by piece. A task holds the partial counts of its rows
(``HELD`` at most), one bucket (about ``BUCKET`` postings and one cell per peer) or one group's peers; no group of
documents, term or language is gathered in one.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.llm.common import text_bytes, written
from terracell.plans.skew import salted_join

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
BUCKET = 50_000
HELD = 400_000
PIECE = 4 << 20

# a byte of a term stands for itself, A-Z for a-z, any other for a blank
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text):
    """How often each term (bytes) occurs in a text (bytes)."""
    plain = text.translate(_TERM)
    if len(plain) <= PIECE:
        return Counter(plain.split())
    found, start = Counter(), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        found.update(plain[start:end].split())
        start = end
    return found


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, n bigint, docs bigint"


def _count(batches):
    """Partial counts; each group also gets a row without a term."""

    def flush():
        rows = [(lang, source, None, 0, 0) for lang, source in held]
        rows += [(lang, source, term.decode(), n, docs[term]) for (lang, source), (times, docs) in held.items() for term, n in times.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)], schema=_COUNTS)

    held, size = {}, 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms_of(text), len(times)
            times.update(found)
            docs.update(found.keys())
            size += len(times) - before
            if size >= HELD:
                yield flush()
                size = 0
    if held:
        yield flush()


def _share(count, total, terms):
    """p of a term: exact, beyond 64 bits on the way."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", (wide(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(terms) * 2)).cast("long")


def _differ(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p, q):
    return (p - q) * (p - q) // (p + q)


_CELLS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("v", pa.int64())])


def _scatter(key, index, peers):
    """One bucket: every group's dense row over its peers, less the baseline of terms that neither has."""
    if not index.num_rows:
        return _CELLS.empty_table()
    zero = peers.column("p0").to_numpy()[np.argsort(peers.column("g").to_numpy())]
    term = index.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, g, p = term[order], index.column("g").to_numpy()[order], index.column("p").to_numpy()[order]
    starts = np.searchsorted(term, np.arange(term[-1] + 2))
    row, column, value = [], [], []
    everyone = np.arange(len(zero))
    for own in np.unique(g):
        at = np.flatnonzero(g == own)
        lacking = _f(zero[own], zero)
        alone = np.zeros(len(zero), np.int64)
        for q, times in zip(*np.unique(p[at], return_counts=True)):
            alone += times * (_f(q, zero) - lacking)
        first, last = starts[term[at]], starts[term[at] + 1]
        sizes = last - first
        met = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        q, h, r = np.repeat(p[at], sizes), g[met], p[met]
        row_of_peers = alone.copy()
        np.add.at(row_of_peers, h, _f(q, r) - _f(q, zero[h]) - _f(zero[own], r) + lacking[h])
        # the peers' rows lack this group's terms likewise
        others = everyone != own
        own_again = np.full(others.sum(), own)
        row += [own_again, everyone[others]]
        column += [everyone[others], own_again]
        value += [row_of_peers[others], alone[others]]
    row, column, value = (np.concatenate(x) for x in (row, column, value))
    return pa.table([pa.array([key[0].as_py()] * len(row), pa.string()), pa.array(row, pa.int64()), pa.array(column, pa.int64()), pa.array(value)], schema=_CELLS)


def audit(docs, text="text", lang="lang", source="source", least=LEAST, top=TOP, bucket=BUCKET):
    """Per (``lang``, ``source``) the parts ``pair`` (each other source) and ``term`` (overused terms): ``item``, ``value``, ``rank``."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), F.col(text).alias("text")).mapInArrow(_count, _COUNTS_DDL)
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = written(kept.filter(F.col("docs") >= least).drop("docs"), "kept")
    held = written(counts.drop("docs").join(kept, ["lang", "term"]), "held")

    own = held.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("postings"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n_lang"))
    peers = counts.filter("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    peers = peers.fillna(0, ["n_group", "postings", "terms", "n_lang"])
    across = Window.partitionBy("lang")
    peers = peers.select(
        "lang", "source", (F.row_number().over(across.orderBy("source")) - 1).cast("long").alias("g"), "n_group", "n_lang", "terms",
        F.greatest(F.lit(1), F.ceil(F.sum("postings").over(across) / bucket)).cast("int").alias("buckets"),
        F.when(F.col("terms") > 0, _share(F.lit(0), F.col("n_group"), F.col("terms"))).otherwise(0).alias("p0"),
    )
    peers = written(peers, "peers")

    index = salted_join(held, peers, ["lang", "source"], salt_on=["term"])
    index = index.select(
        "lang", "source", "g", "term", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"),
        _share(F.col("n"), F.col("n_group"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("n_lang"), F.col("terms")).alias("q"),
    )
    index = written(index, "index")
    return pairs(index, peers).unionByName(overused(index, top))


def overused(index, top=TOP):
    """The ``top`` terms of each group that it uses more than its language, by difference."""
    found = index.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def pairs(index, peers):
    """Every group with every other source of its language, the farthest first."""
    spread = peers.select("lang", "g", "p0", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    cells = index.select("lang", "g", "term", "bucket", "p").groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(
        _scatter, "lang string, g bigint, h bigint, v bigint"
    )
    summed = cells.groupBy("lang", "g", "h").agg(F.sum("v").alias("v"))
    ours = peers.select("lang", "source", "g", "terms", "p0")
    theirs = peers.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p0").alias("q0"))
    # the result itself: one row per group and peer
    both = ours.join(theirs, "lang").filter("g <> h").join(summed, ["lang", "g", "h"], "left")
    baseline = F.when(F.col("terms") > 0, F.col("terms") * _differ(F.col("p0"), F.col("q0"))).otherwise(0)
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", (baseline + F.coalesce("v", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order))
