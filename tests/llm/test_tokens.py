import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terracell.llm import packing, token_counts
from terracell.llm.common import token_file
from tests.llm.frames import by_id, documents, prose

ROWS = [
    (1, None), (2, ""), (3, "one"), (4, prose(1, 700)), (5, prose(2, 5000)), (6, "a<|endoftext|>b"), (7, "日本語 é \x00 \t\n\n  x"), (7, "the same id"), (None, "no id"),
    *[(100 + i, prose(i, 10 + 13 * i)) for i in range(60)],
]


@pytest.fixture(scope="module")
def encode():
    full = Tokenizer.from_file(token_file("byte_bpe_50k.json"))
    return lambda t: np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("partitions, options", [(1, {}), (5, {"windows": 3}), (70, {"windows": 2, "length": 256, "slack": 0})])
def test_every_id_is_packed_once(spark, encode, partitions, options):
    rows = [r for r in ROWS if r[0] is not None and r[1] != "the same id"]
    out = packing.pack(documents(spark, rows).repartition(partitions), **options).collect()
    length = options.get("length", 1024)
    seen, sequences = {}, {}
    for r in out:
        seen.setdefault(r.doc, []).append(r)
        sequences.setdefault(r.sequence, []).append(r)
    assert set(seen) == {i for i, _ in rows}
    for i, text in rows:
        ids = encode(text)
        parts = sorted(seen[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids.tobytes() and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == [sum(p.length for p in parts[:n]) for n in range(len(parts))]
    fill = []
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:n]) for n in range(len(parts))]
        fill.append(sum(p.length for p in parts))
    assert max(fill) <= length and sum(fill) >= 0.95 * length * (len(fill) - 1)


def test_repeats_and_nulls_are_packed(spark):
    out = packing.pieces(documents(spark, ROWS)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in out) == sum(len(packing.Encoder()(t or "")) + 1 for _, t in ROWS)
    assert packing.pieces(documents(spark, [])).count() == 0


def test_checksum(spark, encode):
    r = packing.pieces(documents(spark, [(3, "one two")])).first()
    assert (r.ids_crc32, r.length, r.doc_tokens) == (zlib.crc32(encode("one two").tobytes()), len(encode("one two")), len(encode("one two")))


def test_fast_library_gives_the_same_ids(spark, encode):
    fast = packing.Encoder()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert (fast(r.text) == encode(r.text)[:-1]).all()


def test_long_white_space_gives_the_same_ids(encode):
    blank = " " * 1_200_000
    for text in (blank, f"one{blank}two", f"one \n{blank}\n", "\u3000" * 1_000_001 + "x"):
        assert (packing.Encoder()(text) == encode(text)[:-1]).all()


def test_text_cut_around_white_space_gives_the_same_ids(encode):
    r, cut = random.Random(1), packing.Encoder(long=3)
    for _ in range(2000):
        text = "".join(r.choice(["a", "it's", "7", "!", "é", "\x1c", "\u200b", " ", "  ", "\n", "\t ", "\u3000", "\xa0", "     "]) for _ in range(r.randrange(14)))
        ids, want = cut(text), encode(text)[:-1]
        assert ids.dtype == want.dtype and ids.tolist() == want.tolist(), text


def test_a_long_white_space_run_is_packed(spark, encode):
    text = "one" + " " * 1_200_000 + "two"
    out = packing.pack(documents(spark, [(1, text), (2, "three")])).filter("doc = 1").orderBy("start").collect()
    assert b"".join(bytes(r.ids) for r in out) == encode(text).tobytes()


COUNT_ROWS = [*ROWS[:7], (8, "a" * 3000 + "bc" * 400), (9, "日本語漢字" * 300 + " é" * 400), (10, "x  \n\n  y " * 400 + "<s> </s> ▁"), *ROWS[9:30]]


@pytest.mark.parametrize("options", [{}, {"huge": 500, "chunk": 128, "overlap": 8}, {"huge": 50, "chunk": 40, "overlap": 2}])
def test_counts_equal_the_library(spark, options):
    sp = token_counts._processor(token_counts.MODEL)
    out = by_id(token_counts.count_tokens(documents(spark, COUNT_ROWS), **options), "n_bytes", "n_tokens", "over_limit")
    assert out == {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in COUNT_ROWS}


def test_repeated_rows_are_counted_each(spark):
    rows = [(1, prose(1, 400)), (1, prose(1, 400)), (None, "x y")]
    assert token_counts.count_tokens(documents(spark, rows), huge=100, chunk=64, overlap=8).count() == 3
    assert token_counts.count_tokens(documents(spark, [])).count() == 0
