"""Token counts under a sentence-piece model; huge documents are encoded in overlapping chunks and spliced.

A document of at most ``huge`` characters is encoded whole. A longer one is cut into chunks of ``chunk`` characters that
overlap by ``overlap``; chunks are dealt to tasks and encoded with offsets. Two neighbours are spliced at a boundary that
both have between the same two characters and that is proven stable: no piece of the model holds these two characters
next to each other, so no merge can ever cross it, whatever the rest of the text is. If an overlap has no such boundary
(a long run without white space, say), the document goes round again with a wider overlap and larger chunks, until it
is one chunk. Counts are therefore those of the whole text.

A null text counts as empty: no bytes, no tokens. Rows are counted one by one, so repeated rows and ids keep their own
counts. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terracell.llm.common import parallelism, token_file, written

HUGE = 65_536
CHUNK = 32_768
OVERLAP = 256
WIDEN = 8
LIMIT = 4096
MODEL = "piece_bpe_32k.model"

_COUNTED = "row bigint, id bigint, n_bytes bigint, n_tokens bigint"
_COUNTED_ARROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_CHUNKS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("chars", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.string())])
_CHUNKS_DDL = "row bigint, id bigint, start bigint, chars bigint, n_bytes bigint, part string"
_ENCODED = pa.schema([*[f for f in _CHUNKS if f.name != "part"], ("size", pa.int64()), ("tokens", pa.int64()), ("marks", pa.binary())])
_ENCODED_DDL = _CHUNKS_DDL.replace("part string", "size bigint, tokens bigint, marks binary")


def _processor(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_file(model))


def _batch(rows, schema):
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _count_whole(model):
    def run(batches):
        sp = _processor(model)
        for batch in batches:
            rows, ids, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            out = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                counts = map(len, sp.encode(part, num_threads=1))
                out += zip(rows[i : i + 256], ids[i : i + 256], (len(t.encode()) for t in part), counts)
            yield _batch(out, _COUNTED_ARROW)

    return run


def _cut(chunk, overlap):
    def run(batches):
        for batch in batches:
            for row, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                n_bytes, out = len(text.encode()), []
                for start in range(0, len(text), chunk):
                    out.append((row, i, start, len(text), n_bytes, text[start : start + chunk + overlap]))
                    if start + chunk + overlap >= len(text):
                        break
                    if len(out) == 64:
                        yield _batch(out, _CHUNKS)
                        out = []
                yield _batch(out, _CHUNKS)

    return run


def inner_pairs(sp):
    """Character pairs that stand next to each other inside some piece: a merge may cross these and no others."""
    pairs = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i)
            pairs.update(zip(piece, piece[1:]))
    return pairs


def stable_marks(sp, pairs, part, zones):
    """Token count of ``part``, and (position, tokens before it) of its proven boundaries inside ``zones``."""
    pieces = sp.encode(part, return_type="proto").pieces
    # offsets count bytes; a boundary counts only where a character starts
    begins = np.flatnonzero((np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80)
    begin = np.array([p.begin for p in pieces], np.int64)
    chars = np.searchsorted(begins, begin)
    whole = (chars < len(begins)) & (begins[np.minimum(chars, len(begins) - 1)] == begin)
    shown = lambda c: "▁" if c == " " else c
    marks = []
    for n in np.flatnonzero(whole & (chars > 0)).tolist():
        at = int(chars[n])
        if any(a <= at <= b for a, b in zones) and (shown(part[at - 1]), shown(part[at])) not in pairs:
            marks.append((at, n))
    # pieces of one character's bytes begin at the same place: the first has the count before it
    first = {}
    for at, n in marks:
        first.setdefault(at, n)
    return len(pieces), sorted(first.items())


def _encode(model, overlap):
    def run(batches):
        sp = _processor(model)
        pairs = inner_pairs(sp)
        for batch in batches:
            out = []
            for row, i, start, chars, n_bytes, part in zip(*(c.to_pylist() for c in batch.columns)):
                zones = [(1, overlap)] * (start > 0) + [(len(part) - overlap, len(part) - 1)] * (start + len(part) < chars)
                tokens, marks = stable_marks(sp, pairs, part, zones)
                out.append((row, i, start, chars, n_bytes, len(part), tokens, np.array([(start + a, n) for a, n in marks], np.int64).tobytes()))
            yield _batch(out, _ENCODED)

    return run


def splice(chunks):
    """Tokens of a document from its chunks (start, tokens, marks) in order; None where two don't align."""
    total, entered = 0, 0
    for (start, tokens, marks), after in zip(chunks, [*chunks[1:], None]):
        if after is None:
            return total + tokens - entered
        left = dict(marks)
        common = [a for a, _ in after[2] if a in left]
        if not common:
            return None
        at = common[len(common) // 2]
        total += left[at] - entered
        entered = dict(after[2])[at]


def _splice(key, table):
    table = table.sort_by("start")
    marks = [[tuple(m) for m in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()] for x in table.column("marks").to_pylist()]
    found = splice(list(zip(table.column("start").to_pylist(), table.column("tokens").to_pylist(), marks)))
    return pa.table([pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("row", "id", "n_bytes")] + [pa.array([found], pa.int64())], schema=_COUNTED_ARROW)


def count_tokens(docs, id="doc_id", text="text", model=MODEL, limit=LIMIT, huge=HUGE, chunk=CHUNK, overlap=OVERLAP):
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > huge
    out = rows.filter(~long).mapInArrow(_count_whole(model), _COUNTED)
    todo = written(rows.filter(long), "huge")
    longest = todo.agg(F.max(F.length("text"))).first()[0]
    while longest is not None:
        parts = todo.mapInArrow(_cut(chunk, overlap), _CHUNKS_DDL).repartition(parallelism(docs.sparkSession), "row", "start")
        encoded = parts.mapInArrow(_encode(model, overlap), _ENCODED_DDL)
        spliced = written(encoded.groupBy("row").applyInArrow(_splice, _COUNTED), "spliced")
        out = out.union(spliced.filter("n_tokens is not null"))
        again = spliced.filter("n_tokens is null").select("row")
        if chunk + overlap >= longest or again.isEmpty():
            break
        todo = written(todo.join(again, "row", "left_semi"), "huge")
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
    return out.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
