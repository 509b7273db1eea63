"""Dedup of lines across documents by range-partitioned hashes; the result is a keep bitmap per document, not text.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
points that are in two or more documents lose all their lines except those of the smallest document id. Each document
sends one row per distinct key: a 128-bit hash, its id and the positions of the key's lines. The rows are
range-partitioned by hash with a secondary sort by document; each partition is streamed once, and every row that is
not the first of its hash is a drop. A hot key is split over partitions by the document ids, so the first hash of a
partition may have begun earlier: the first row of each partition and the first row of its last hash are kept as
markers (two per partition), and the markers of equal hashes decide which partition held the first.

Null and empty texts are one empty line, which is never dropped. Rows with equal id and equal text are one document.
A null id sorts before all others. Line order is kept. An empty table gives no rows.
"""

import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.llm.common import WHITE, parallelism, text_bytes, written

MIN_CHARS = 10
_WHITE = WHITE.encode()

_KEYS = "h binary, doc bigint, version bigint, at binary"
_KEYS_ARROW = pa.schema([("h", pa.binary()), ("doc", pa.int64()), ("version", pa.int64()), ("at", pa.binary())])
_DROPS_ARROW = pa.schema([*_KEYS_ARROW, ("kind", pa.int8())])
DROP, HEAD, TAIL = 0, 1, 2


def pack_positions(positions):
    """Ascending positions as bytes: differences in base 128."""
    out, last = bytearray(), -1
    for p in positions:
        gap, last = p - last - 1, p
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def unpack_positions(packed):
    out, last, gap, shift = [], -1, 0, 0
    for b in packed:
        gap |= (b & 127) << shift
        shift += 7
        if b < 128:
            last += gap + 1
            out.append(last)
            gap = shift = 0
    return out


def _keys_of(text, min_chars):
    found = {}
    for i, line in enumerate(text.lower().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(_WHITE)
            # bytes that go on a code point don't count
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return found


def _line_keys(min_chars):
    def run(batches):
        for batch in batches:
            h, doc, version, at = [], [], [], []
            for d, v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                for key, positions in _keys_of(t, min_chars).items():
                    h.append(key), doc.append(d), version.append(v), at.append(pack_positions(positions))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((h, doc, version, at), _KEYS_ARROW)], schema=_KEYS_ARROW)

    return run


def _stream(batches):
    """Drops of a sorted partition, and the markers of its first and last hash."""
    current = first = tail = head = None
    for batch in batches:
        rows = []
        for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if row[0] != current:
                current, first = row[0], row
                head = row[0] if tail is None else head
                tail = row
            # a further version of the first document shares its lot
            if row[1] != first[1]:
                rows.append((*row, DROP))
            elif row[0] == head:
                rows.append((*row, HEAD))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DROPS_ARROW)], schema=_DROPS_ARROW)
    if tail is not None:
        last = [*tail[:3], b"", TAIL]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _DROPS_ARROW)], schema=_DROPS_ARROW)


def _bitmaps(key, table):
    bits = bytearray()
    for packed in table.column("at").to_pylist():
        for p in unpack_positions(packed):
            if p >= 8 * len(bits):
                bits.extend(bytes(p // 8 + 1 - len(bits)))
            bits[p // 8] |= 1 << p % 8
    return pa.table({"doc": [key[0].as_py()], "version": [key[1].as_py()], "dropped": [zlib.compress(bytes(bits), 1)]}, schema=_BITMAP_ARROW)


_BITMAP_ARROW = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("dropped", pa.binary())])


def _version(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_bitmaps(docs, id="doc_id", text="text", min_chars=MIN_CHARS):
    """Compressed bitmaps of the lines to drop: ``doc``, ``version`` (hash of the text), ``dropped``.

    Bit p of the decompressed bytes stands for line p; lines beyond the end stay. Documents that keep all
    their lines have no row. ``kept`` lines are the complement: see :func:`keep_lines`.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), _version(F.col(text)).alias("version"), F.col(text).alias("text"))
    keys = rows.mapInArrow(_line_keys(min_chars), _KEYS)
    order = ["h", "doc", "version"]
    ranged = keys.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_stream, _KEYS + ", kind tinyint"), "line-drops")
    # two markers per partition: of equal hashes the smallest document is the first of all
    least = F.min(F.struct(F.col("doc"))).over(Window.partitionBy("h"))
    heads = found.filter(F.col("kind") != DROP).withColumn("least", least).filter(F.col("kind") == HEAD)
    late = heads.filter(~F.struct(F.col("doc")).eqNullSafe(F.col("least"))).select("doc", "version", "at")
    drops = found.filter(F.col("kind") == DROP).select("doc", "version", "at").union(late)
    return drops.groupBy("doc", "version").applyInArrow(_bitmaps, "doc bigint, version bigint, dropped binary")


def _keep(batches):
    for batch in batches:
        texts, bitmaps = text_bytes(batch.column("_text")), batch.column("dropped").to_pylist()
        out, lines, gone = [], [], []
        for text, packed in zip(texts, bitmaps):
            split = text.split(b"\n")
            lines.append(len(split))
            if packed:
                bits = zlib.decompress(packed)
                split = [x for p, x in enumerate(split) if p >= 8 * len(bits) or not bits[p // 8] >> p % 8 & 1]
            gone.append(lines[-1] - len(split))
            out.append(b"\n".join(split))
        columns = [batch.column("_row"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "_kept", "_lines", "_gone"])


def keep_lines(docs, bitmaps, id="doc_id", text="text"):
    """Apply bitmaps: a frame of ``_row`` (the document's own columns), ``_kept``, ``_lines`` and ``_gone``."""
    held = docs.select(
        F.col(id).cast("long").alias("_doc"), _version(F.col(text)).alias("_version"), F.col(text).alias("_text"),
        F.struct(*[docs[c] for c in docs.columns if c != text]).alias("_row"),
    )
    both = held["_doc"].eqNullSafe(bitmaps["doc"]) & (held["_version"] == bitmaps["version"])
    joined = held.join(bitmaps, both, "left").select("_row", "_text", "dropped")
    kind = held.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(_keep, f"_row {kind}, _kept string, _lines bigint, _gone bigint")


def dedup_report(docs, id="doc_id", text="text", min_chars=MIN_CHARS):
    """One row per document: id, ``n_lines``, ``n_dropped`` and ``kept_sha256`` of the text that stays."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).alias("_body"))
    out = keep_lines(slim, drop_bitmaps(slim, "_id", "_body", min_chars), "_id", "_body")
    return out.select(
        F.col("_row._id").alias(id), F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256")
    )


def dedup_documents(docs, id="doc_id", text="text", chars=None, min_chars=MIN_CHARS):
    """All documents with the kept lines as their text, and ``chars`` (if named) set to its length."""
    out = keep_lines(docs, drop_bitmaps(docs, id, text, min_chars), id, text)
    held = lambda c: F.col("_kept").alias(c) if c == text else F.length("_kept").cast(docs.schema[c].dataType).alias(c) if c == chars else F.col("_row")[c].alias(c)
    return out.select(*[held(c) for c in docs.columns])
