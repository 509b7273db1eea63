"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 consecutive words (a shorter item is one window). A window is a set of word
shingles, and a document holds it only if it holds all of them, so the necessary prefix of a window is one shingle: its
rarest, by occurrences in the documents. Windows next to each other mostly share it, so the prefix shingles of an item
(its anchors) are few. Documents are joined to anchors by shingle; a match must leave room for the window on both sides
(length and positional bounds); then the words around it are compared one by one, which is exact, and the run of equal
words around the anchor is a hit if it is as long as the window. Documents that were met are cut into segments of
``SEGMENT`` words with the words a window can reach on either side, so a place carries its segment, never its document,
and an anchor carries the item's words within reach.

Words are lower-cased (A-Z) runs of digits, letters and anything outside ASCII. Null and empty texts have no words: as
documents they are not contaminated, as items they have no window. A window repeated in an item or in several items
counts for each item holding it. Repeated document rows are judged each on its own, repeated item rows count once per
distinct item_id; items without an id are ignored. Empty tables give no rows, or no hits.

``small`` bounds the rows of whatever is broadcast (shingles, anchors, ids of documents that were met), and
``SMALL_BYTES`` the words that anchors carry. Beyond it the same joins exchange their rows instead.
"""

from pyspark.sql import functions as F

from terracell.llm.common import free_name, lower_ascii, written
from terracell.plans.skew import salted_join

WINDOW = 13
SHINGLE = 3
SMALL = 200_000
SMALL_BYTES = 64 << 20
REACH = WINDOW - 1
SEGMENT = 64
STRETCH = 4096  # positions of a document whose hits are counted together
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Words of a text column; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORDS), lambda w: w != "")


def shingles_of(words, sizes):
    """Array of (position, hash) of all shingles of the given sizes; sizes differ in their hashes."""
    parts = []
    for k in sizes:
        count = F.size(words) - (k - 1)
        at = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        made = F.transform(at, lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]).alias("g")))
        parts.append(made)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _exploded(rows, sizes, keep):
    return rows.select(*keep, F.explode(shingles_of(F.col("w"), sizes)).alias("s")).select(*keep, F.col("s.p").alias("p"), F.col("s.g").alias("g"))


def _maybe_broadcast(df, rows, small):
    return F.broadcast(df) if rows <= small else df


def _anchors(items, counts):
    """One row per (item, position) that is the rarest shingle of one of its windows, with the words around it."""
    from pyspark.sql import Window

    # m words, windows of n = min(13, m) words, shingles of k = min(3, m) words
    grams = items.select("item", "w", "m", "n", "k", F.explode(F.expr("sequence(0, m - k)")).alias("p"))
    grams = grams.withColumn("g", F.xxhash64("k", F.get("w", F.col("p")), *[_word_or_nothing("w", j) for j in (1, 2)]))
    ranked = grams.join(counts, "g", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    order = ranked.withColumn("r", F.struct("c", "g", "p"))
    # the rarest shingle among those of each window that starts at p
    span = Window.partitionBy("item").orderBy("p").rowsBetween(0, WINDOW - SHINGLE)
    held = order.withColumn("best", F.min("r").over(span)).filter(F.col("p") + F.col("n") <= F.col("m"))
    best = held.select("item", "w", "m", "n", "k", "p", F.col("best.g").alias("g"), F.col("best.p").alias("q"))
    # least number of words that a window needs before and after its anchor
    anchors = best.groupBy("item", "g", "q").agg(
        F.min(F.col("q") - F.col("p")).alias("before"), F.min(F.col("p") + F.col("n") - F.col("q") - F.col("k")).alias("after"),
        *[F.first(c).alias(c) for c in ("w", "m", "n", "k")],
    )
    low = F.greatest(F.col("q") - REACH, F.lit(0))
    around = F.slice("w", low + 1, F.col("q") - low + F.col("k") + REACH).alias("v")
    return anchors.select("item", "g", "before", "after", "n", "k", around, (F.col("q") - low).alias("q"))


def _word_or_nothing(words, j):
    return F.when(F.col("k") > j, F.get(words, F.col("p") + j))


def _equal_run(doc, item, step):
    """How many words after (step 1) or before (step -1) the anchor are equal, as far as a window reaches."""
    first = (F.col("at"), F.col("q")) if step < 0 else (F.col("at") + F.col("k") - 1, F.col("q") + F.col("k") - 1)
    at = lambda a, i: F.when(i >= 0, F.get(a, i))
    same = F.transform(
        F.sequence(F.lit(1), F.lit(REACH)),
        lambda d: F.coalesce(at(F.col(doc), first[0] + d * step) == at(F.col(item), first[1] + d * step), F.lit(False)),
    )
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def hits(docs, benchmark, id="doc_id", text="text", item_id="item_id", item_text="text", small=SMALL):
    """Runs of document words equal to item words, one row per anchor: ``d``, ``item``, first position and length.

    ``docs`` must tell its rows apart by ``id``.
    """
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("w"))
    items = items.withColumn("m", F.size("w")).filter("m > 0").dropDuplicates(["item_id", "w"])
    items = items.select(
        F.struct("item_id", F.xxhash64("w").alias("x")).alias("item"), "w", "m",
        F.least("m", F.lit(WINDOW)).alias("n"), F.least("m", F.lit(SHINGLE)).alias("k"),
    )
    items = written(items, "items")
    sizes = sorted(r[0] for r in items.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    rows = docs.select(F.col(id).alias("d"), words_of(F.col(text)).alias("w"))

    wanted = items.select(F.explode(F.expr("sequence(0, m - k)")).alias("p"), "w", "k")
    wanted = wanted.select(F.xxhash64("k", F.get("w", F.col("p")), *[_word_or_nothing("w", j) for j in (1, 2)]).alias("g")).distinct()
    wanted = written(wanted, "shingles")
    # the places of benchmark shingles in the documents: what follows works on these alone
    seen = _exploded(rows, sizes, ["d"]).join(_maybe_broadcast(wanted, wanted.count(), small), "g", "left_semi")
    seen = written(seen, "seen")
    counts = written(seen.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "counts")
    anchors = written(_anchors(items, counts), "anchors")
    held = anchors.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("v", "")))).first()
    if held[0] <= small and (held[1] or 0) <= SMALL_BYTES:
        met = seen.join(F.broadcast(anchors), "g")
    else:
        met = salted_join(seen, anchors, ["g"], salt_on=["d", "p"])
    met = written(met.filter("p >= before").withColumn("s", F.expr(f"p div {SEGMENT}")), "met")
    named = written(met.select("d").distinct(), "named")
    segments = _segments(rows.join(_maybe_broadcast(named, named.count(), small), "d", "left_semi"))
    # a segment has few places: its key is never hot
    found = met.join(segments, ["d", "s"]).withColumn("at", F.col("p") - F.col("first"))
    found = found.filter(F.col("at") + F.col("k") + F.col("after") <= F.size("u"))
    found = found.withColumns({"left": _equal_run("u", "v", -1), "right": _equal_run("u", "v", 1)})
    return found.filter(F.col("left") + F.col("k") + F.col("right") >= F.col("n")).select(
        "d", "item", (F.col("p") - F.col("left")).alias("at"), (F.col("left") + F.col("k") + F.col("right")).alias("length")
    )


def _segments(rows):
    """Words of documents (``d``, ``w``) in segments ``s``: ``u`` from position ``first``, with the reach of a window on both sides."""
    starts = F.transform(F.expr(f"CASE WHEN size(w) > 0 THEN sequence(0, CAST((size(w) - 1) div {SEGMENT} AS INT)) ELSE CAST(array() AS array<int>) END"), _segment)
    return rows.select("d", F.explode(starts).alias("x")).select("d", "x.s", "x.first", "x.u")


def _segment(s):
    first = F.greatest(s * SEGMENT - REACH, F.lit(0))
    return F.struct(s.cast("bigint").alias("s"), first.alias("first"), F.slice("w", first + 1, (s + 1) * SEGMENT + SHINGLE + REACH - first).alias("u"))


def judge(docs, benchmark, id="doc_id", text="text", small=SMALL, **names):
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    key = F.struct(F.col(id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.select(F.col(id).alias("_id"), key.alias("_key"), F.col(text).alias("_text"))
    runs = hits(keyed, benchmark, "_key", "_text", small=small, **names)
    merged = written(_merged(written(runs, "runs")), "hits")
    base = keyed.select("_id", "_key", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    out = base.join(_maybe_broadcast(merged, merged.count(), small), base["_key"] == merged["d"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("_id").alias(id), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _merged(runs):
    """Per document: the number of positions in the union of its runs, and its items.

    A run is shorter than a stretch of ``STRETCH`` positions, so it lies in one or two of them; each stretch is counted
    on its own.
    """
    ends = runs.select("d", "at", (F.col("at") + F.col("length")).alias("end")).distinct()
    parts = ends.withColumn("x", F.explode(F.sequence(F.expr(f"at div {STRETCH}"), F.expr(f"(end - 1) div {STRETCH}"))))
    inside = F.struct(F.greatest("at", F.col("x") * STRETCH).cast("int").alias("at"), F.least("end", (F.col("x") + 1) * STRETCH).cast("int").alias("end"))
    parts = parts.groupBy("d", "x").agg(F.sort_array(F.collect_set(inside)).alias("runs"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda a, r: F.struct(
        (a["hit"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["at"]))).alias("hit"), F.greatest(a["end"], r["end"]).alias("end")
    )
    hit = parts.select("d", F.aggregate("runs", start, step)["hit"].alias("hit")).groupBy("d").agg(F.sum("hit").alias("n_hit"))
    items = runs.groupBy("d").agg(F.sort_array(F.collect_set("item.item_id")).alias("items"))
    return hit.join(items, "d").select("d", "n_hit", F.size("items").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))


def clean_documents(docs, benchmark, id="doc_id", text="text", small=SMALL, **names):
    """The documents that are not contaminated, with their own columns."""
    whole, key = free_name(docs, "_row"), free_name(docs, "_key")
    both = F.struct(F.col(id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias(key)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(whole), both)
    keyed = docs.select(F.col(id).alias("_id"), both.alias("_key"), F.col(text).alias("_text"))
    merged = _merged(written(hits(keyed, benchmark, "_key", "_text", small=small, **names), "runs"))
    words = F.size(words_of(F.col("_text")))
    bad = keyed.select("_key", words.alias("n_words")).join(merged.withColumnRenamed("d", "_key"), "_key")
    bad = written(bad.filter(F.col("n_hit") * 20 >= F.col("n_words")).select(F.col("_key").alias(key)).distinct(), "contaminated")
    out = held.join(_maybe_broadcast(bad, bad.count(), small), key, "left_anti")
    return out.select(*[F.col(whole)[c].alias(c) for c in docs.columns])
