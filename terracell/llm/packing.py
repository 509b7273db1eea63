"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Every task keeps at most ``windows`` open sequences. A document's ids and one end id are cut into full sequences and a
rest; the rest goes to the open window with the least free space that holds it. If none does and all windows are in
use, the fullest is emitted: its free space is filled with the head of the rest if that saves more than ``slack``
padding. What is open at the end of a task is left over: leftovers of ``FAN`` tasks are packed again in one task, level
by level, until one task closes the last windows, filling them from each other, so that one sequence at most is short.
No task ever holds more than its windows and a batch.

A null or empty text is the end id alone. Repeated rows and ids are packed one by one. An empty table gives no rows.
Very long texts give as many full sequences as they need. Level 0 is written once, so ids are computed once and a lost
executor cannot change a sequence that others have seen.
"""

import base64
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from terracell.llm.common import token_file, written

LENGTH = 1024
WINDOWS = 64
SLACK = 16
FAN = 64
END_ID = 0

_PIECES = pa.schema([
    ("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
])
_PIECES_DDL = "doc bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence bigint, offset bigint, open boolean"


class Encoder:
    """Ids of texts under the byte-level BPE ``name``.json.

    Ordinary text goes through the faster library on the same vocabulary, which gives the same ids; a text with the
    special string goes through the first library, which knows it. So does a run of ``long`` or more white space, on
    which the faster one fails from a million characters up: no piece of the pattern holds white space after another
    character, and the last character of a run may belong to the next piece, so the text is cut around the rest of it.
    """

    SPECIAL = "<|endoftext|>"
    LONG = 100_000
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, name="byte_bpe_50k", long=LONG):
        import tiktoken
        from tokenizers import Tokenizer

        with open(token_file(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(token_file(f"{name}.json"))
        self.long = long

    def __call__(self, text):
        if self.SPECIAL in text:
            return self._full(text)
        if len(text) < self.long:
            return self._fast(text)
        out, at = [], 0
        for run in re.finditer(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text):
            start, end = run.start(), run.end() - (run.end() < len(text))
            if end - start >= self.long:
                out += [self._fast(text[at:start]), self._full(text[start:end])]
                at = end
        return np.concatenate((*out, self._fast(text[at:])))

    def _fast(self, text):
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _full(self, text):
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Open windows of one task. ``add`` and ``close`` return pieces of emitted sequences."""

    def __init__(self, length, windows, slack, first_sequence):
        self.length, self.windows, self.slack, self.next = length, windows, slack, first_sequence
        self.free = []  # (free space, sequence), sorted
        self.held = {}  # sequence: its pieces

    def _emit(self, sequence, open=False):
        return [(*p, open) for p in self.held.pop(sequence)]

    def _put(self, sequence, free, piece):
        doc, start, ids, total = piece
        self.held[sequence].append((doc, start, len(ids), ids.tobytes(), total, sequence, self.length - free))
        return free - len(ids)

    def _new(self):
        self.next += 1
        self.held[self.next - 1] = []
        return self.next - 1

    def add(self, doc, start, ids, total):
        """Place ids ``start``... of a document of ``total`` ids."""
        out = []
        while len(ids) >= self.length:
            s = self._new()
            self._put(s, self.length, (doc, start, ids[: self.length], total))
            out += self._emit(s)
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect_left(self.free, (len(ids), -1))
            if at < len(self.free):
                free, s = self.free.pop(at)
            elif len(self.free) < self.windows:
                free, s = self.length, self._new()
            else:
                # none fits: the fullest goes, filled up if it has room worth a cut
                free, s = self.free.pop(0)
                if free > self.slack:
                    self._put(s, free, (doc, start, ids[:free], total))
                    start, ids = start + free, ids[free:]
                out += self._emit(s)
                continue
            left = self._put(s, free, (doc, start, ids, total))
            if left:
                insort(self.free, (left, s))
            else:
                out += self._emit(s)
            break
        return out

    def leave(self):
        """The pieces of the windows still open, marked as such."""
        return [p for _, s in self.free for p in self._emit(s, open=True)]

    def close(self):
        """Emit all windows, the fullest filled from the emptiest."""
        out, slots = [], [[free, s] for free, s in self.free]
        while slots:
            free, s = slots.pop(0)
            while free and slots:
                donor = slots[-1]
                doc, start, n, ids, total, _, offset = self.held[donor[1]].pop()
                take = min(n, free)
                # the tail of the donor's last piece moves
                ids = np.frombuffer(ids, "<u4")
                free = self._put(s, free, (doc, start + n - take, ids[n - take :], total))
                if take < n:
                    self.held[donor[1]].append((doc, start, n - take, ids[: n - take].tobytes(), total, donor[1], offset))
                donor[0] += take
                if not self.held[donor[1]]:
                    del self.held[donor[1]]
                    slots.pop()
            out += self._emit(s)
        return out


def _batches(pieces, size=2048):
    for i in range(0, len(pieces), size):
        part = pieces[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PIECES)], schema=_PIECES)


def _pack_texts(length, windows, slack, end_id, tokenizer):
    def run(batches):
        encode = Encoder(tokenizer)
        packer = Packer(length, windows, slack, TaskContext.get().partitionId() << 28)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((encode(text or ""), end))
                out += packer.add(doc, 0, ids, len(ids))
                if len(out) > 2048:
                    yield from _batches(out)
                    out = []
            yield from _batches(out)
        yield from _batches(packer.leave())

    return run


def _pack_again(length, windows, slack, level, last):
    def run(batches):
        packer = Packer(length, windows, slack, (level << 56) + (TaskContext.get().partitionId() << 28))
        for batch in batches:
            out = []
            for doc, start, _, ids, total, *_ in zip(*[c.to_pylist() for c in batch.columns]):
                out += packer.add(doc, start, np.frombuffer(ids, "<u4"), total)
            yield from _batches(out)
        yield from _batches(packer.close() if last else packer.leave())

    return run


def pack(docs, id="doc_id", text="text", length=LENGTH, windows=WINDOWS, slack=SLACK, end_id=END_ID, tokenizer="byte_bpe_50k"):
    """One row per piece: ``doc``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence``,
    ``offset``."""
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    packed = written(rows.mapInArrow(_pack_texts(length, windows, slack, end_id, tokenizer), _PIECES_DDL), "packed")
    done, level, last = packed.filter("not open"), 0, False
    groups = (packed.agg(F.max(F.expr("sequence >> 28"))).first()[0] or 0) + 1
    while not last:
        groups, level = -(-groups // FAN), level + 1
        last = groups == 1
        task = F.expr(f"(sequence & {(1 << 56) - 1}) >> 28")
        left = packed.filter("open").repartition(groups, F.floor(task / FAN)).sortWithinPartitions("sequence", "offset")
        packed = left.mapInArrow(_pack_again(length, windows, slack, level, last), _PIECES_DDL)
        if not last:
            packed = written(packed, f"packed-{level}")
        done = done.union(packed.filter("not open"))
    return done.drop("open")


def pieces(docs, id="doc_id", **options):
    """The packing with a checksum in place of the ids."""
    out = pack(docs, id, **options)
    return out.select(
        F.col("doc").alias(id), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        F.col("sequence").alias("sequence_id"), "offset",
    )
