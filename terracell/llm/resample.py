"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs are hashed into a fixed number of buckets. The raw model counts them over all documents, the
target model over labelled good documents (quality 1 and not toxic; at most ``sample`` of them, those with the smallest hashes of their ids).
A document's log weight is the sum over its n-grams of log target share minus log raw share, with additive smoothing.
Gumbel noise, a hash of id and seed, is added, and the ``k`` largest are a sample without replacement that is
proportional to the weights. ``k`` defaults to the share of good ones among the labels whose quality is known, of all documents.

Only the bucket counts (a fixed number) reach the driver. The k-th largest is found by ranking: range partitions and
their counts, no global sort in one task. A null or empty text has weight 1 (log 0). Ties of the noisy weight are
broken by id. Repeated rows are sampled as rows of their own; repeated ids share their noise. Without good labels
both models are the raw one and the sample is uniform. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terracell.llm.common import chunks, numbered_by, word_hashes

BUCKETS = 1 << 14
SAMPLE = 20_000
SMOOTHING = 1.0
SEED = 7
CHUNK_BYTES = 1 << 20


def buckets_of(texts, buckets):
    """Buckets of all words and word pairs of ``texts``, and the text of each."""
    words, starts = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    pairs = (words[:-1] ^ (words[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    inside = text[1:] == text[:-1]
    both = np.concatenate((words, pairs[inside]))
    return ((both >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), np.concatenate((text, text[1:][inside]))


def _count(buckets):
    def run(batches):
        totals = np.zeros((2, buckets), np.int64)
        for good, texts in chunks(batches, CHUNK_BYTES):
            bucket, text = buckets_of(texts, buckets)
            totals[0] += np.bincount(bucket, minlength=buckets)
            totals[1] += np.bincount(bucket[np.array(good, bool)[text]], minlength=buckets)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], names=["bucket", "raw", "target"])

    return run


def _score(weights):
    def run(batches):
        for ids, texts in chunks(batches, CHUNK_BYTES):
            bucket, text = buckets_of(texts, len(weights))
            total = np.bincount(text, weights=weights[bucket], minlength=len(texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["doc", "log_weight"])

    return run


def good_label():
    """A label is good if its quality is 1 and it is not toxic; both the target model and the sample's size take it so."""
    return (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)


def fit(docs, labels, id="doc_id", text="text", buckets=BUCKETS, sample=SAMPLE, smoothing=SMOOTHING):
    """Log ratio of the two models for each bucket."""
    good = labels.filter(good_label() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(sample)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    marked = rows.join(F.broadcast(good), F.col("_id") == F.col("_good"), "left").select(F.col("_good").isNotNull().alias("good"), "_text")
    counts = marked.mapInArrow(_count(buckets), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    totals = np.zeros((2, buckets))
    for b, raw, target in counts.collect():  # at most ``buckets`` rows
        totals[:, b] = raw, target
    if not totals[1].any():
        return np.zeros(buckets)
    shares = (totals + smoothing) / (totals + smoothing).sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def scores(docs, weights, id="doc_id", text="text"):
    """``doc`` and ``log_weight`` of every document."""
    return docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_score(weights), "doc bigint, log_weight double")


def resample(docs, labels, k=None, id="doc_id", text="text", seed=SEED, **options):
    """The sampled documents: id, ``log_weight``, ``noisy_weight``, ``rank`` (0 is the largest), ``kept`` (true)."""
    if k is None:
        n, share = docs.count(), labels.agg(F.avg(good_label().cast("double"))).first()[0]
        k = n if share is None else round(n * share)
    weights = fit(docs, labels, id, text, **options)
    uniform = (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = scores(docs, weights, id, text).withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(uniform)))
    ranked = numbered_by(noisy.withColumn("_order", -F.col("noisy_weight")), ["_order", "doc"], "rank")
    return ranked.filter(F.col("rank") < k).select(F.col("doc").alias(id), "log_weight", "noisy_weight", "rank", F.lit(True).alias("kept"))
