"""What the operators share: reading tables, cutting lineage, naming, text bytes and word hashes."""

import os

import numpy as np
from pyspark.sql import functions as F

from terracell.plans.lineage import scratch_path

# ASCII white space, and the capitals that are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df, name):
    """``df`` written once to the shared folder and read back: executors may be lost without a replay."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df, name):
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column):
    """A-Z lower-cased, every other character left alone."""
    return F.translate(column, CAPITALS, SMALL)


def parallelism(spark):
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered_by(df, order, name="_rank", totals=None):
    """Number rows from 0 in the total order ``order``, with running sums of ``totals``, at any size.

    Rows are range-partitioned by ``order`` and numbered inside their partition; the counts and sums of the
    partitions before (one row per partition, never more) shift them. A hot value is split, as ``order`` ends in
    columns that tell its rows apart. ``totals`` maps an output column to the column whose sum over all earlier rows
    it gets. The ranged rows are written first, so both uses see the same partitions.
    """
    from pyspark.sql import Window

    spark, totals = df.sparkSession, totals or {}
    ranged = df.repartitionByRange(parallelism(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sums = [F.sum(c).alias(f"_sum{i}") for i, c in enumerate(totals.values())]
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ["_n", *[f"_sum{i}" for i in range(len(totals))]]]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = {name: F.count(F.lit(1)).over(inside)} | {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in totals.items()}
    out = ranged.withColumns(running).join(F.broadcast(shifts), "_part")  # one row per partition
    out = out.withColumns({name: F.col(name) + F.col("_before_n")} | {k: F.col(k) + F.col(f"_before_sum{i}") for i, k in enumerate(totals)})
    return out.drop("_part", "_before_n", *[f"_before_sum{i}" for i in range(len(totals))])


# --- words of many texts at once, in numpy ---

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTES = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WHITE]] = True
PIECE = 1 << 16  # bytes hashed at once
_POWERS, _INVERSE = (
    np.multiply.accumulate(np.array([1] + [b] * PIECE, np.uint64)) for b in (int(_BASE), pow(int(_BASE), -1, 2**64))
)


def mix64(h):
    """Finalise 64-bit hashes; changes ``h`` in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts):
    """64-bit hashes of all words of ``texts`` (bytes), and where each text's words start.

    A word is a run of bytes that are not ASCII white space; A-Z count as a-z. Equal words have equal hashes. Returns
    (hashes, starts) with ``starts`` one longer than ``texts``. Words are hashed ``PIECE`` bytes at a time, so beside the
    bytes themselves only the words take memory.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    h = np.empty(len(first), np.uint64)
    i = 0
    while i < len(h):
        # the words that end inside a piece; a word beyond it goes alone
        j = int(np.searchsorted(last, first[i] + PIECE, side="right"))
        if j > i:
            part = joined[first[i] : last[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * _POWERS[: len(part)], out=sums[1:])
            a, b = first[i:j] - first[i], last[i:j] - first[i]
            h[i:j] = (sums[b] - sums[a]) * _INVERSE[a]
        else:
            j = i + 1
            h[i] = _long_word(joined[first[i] : last[i]])
        i = j
    h += (last - first).astype(np.uint64) * _MIX
    starts = np.concatenate(([0], np.searchsorted(first, ends)))
    return mix64(h), starts


def _long_word(word):
    """The sum that ``word_hashes`` takes of a word, piece by piece."""
    total = 0
    for at in range(0, len(word), PIECE):
        part = _BYTES[word[at : at + PIECE]]
        total += int((part * _POWERS[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 2**64)
    return total % 2**64


def shingle_hashes(words, starts, k):
    """Hashes of the ``k``-word shingles of each text, in order, and where each text's shingles start.

    A text with fewer words, but not none, has its whole sequence as its only shingle; a text without words has none.
    """
    n, counts = len(words), np.diff(starts)
    # the hash of a whole short text also takes its length in, so it differs from a prefix of a longer one
    size = max(0, n - k + 1)
    h = words[:size].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + words[i : i + size]
    h = mix64(h)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_starts = np.concatenate(([0], np.cumsum(per)))
    short = np.flatnonzero((counts > 0) & (counts < k))
    text = np.repeat(np.arange(len(counts)), per)
    at = np.arange(out_starts[-1]) - out_starts[text] + starts[text]
    out = np.empty(len(at), np.uint64)
    long_text = counts[text] >= k
    out[long_text] = h[at[long_text]]
    for t in short:
        x = words[starts[t] : starts[t] + 1].copy()
        for w in words[starts[t] + 1 : starts[t + 1]]:
            x = (x ^ (x >> np.uint64(29))) * _MIX + w
        out[out_starts[t]] = mix64(x + np.uint64(counts[t]))[0]
    return out, out_starts


def text_bytes(column):
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def slices(batches, rows=128):
    """Arrow batches in slices of ``rows`` rows: of a batch, only a slice need be Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(batches, size):
    """Lists of ids and of texts (bytes) of about ``size`` bytes from Arrow batches of (id, text)."""
    ids, texts, held = [], [], 0
    for part in slices(batches):
        for i, t in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
            ids.append(i), texts.append(t)
            held += len(t)
            if held >= size or len(ids) == 65_535:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def token_file(name):
    """Path of a public tokenizer's file; ``TERRACELL_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TERRACELL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
