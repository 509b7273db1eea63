import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from terracell.llm import common, jaccard_join
from tests.llm.frames import by_id, documents, prose


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, threshold=85, k=4):
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "two words"), (5, "two  WORDS"), (6, "two words more"), (7, "é É")]
    base = [prose(s, 60 + 40 * s) for s in range(6)]
    n = 10
    for s, text in enumerate(base):
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            rows.append((n, edited(text, n, edits)))
            n += 1
    # a chain: neighbours link, ends do not
    words = prose(99, 140).split()
    rows += [(200 + i, " ".join(words[4 * i : 4 * i + 90])) for i in range(10)]
    passage = prose(7, 60)
    rows += [(300 + i, passage + " " + prose(1000 + i, 40)) for i in range(25)]
    rows += [(400 + i, prose(5000, 30).upper()) for i in range(12)]
    return rows


@pytest.mark.parametrize("options", [{}, {"fragments": 3, "small": 0}, {"threshold": 60}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    out = by_id(jaccard_join.classes(documents(spark, rows).repartition(3), **options), "n_shingles", "component_id")
    assert out == brute(rows, options.get("threshold", 85))


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = jaccard_join.distinct_documents(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in brute(rows).items() if c == i)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (None, None)]
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.classes(documents(spark, rows)).collect())
    assert out == [(0, 0, 0), (0, 2, 0), (2, 2, 2), (2, 2, 2), (3, 2, 2)]
    assert jaccard_join.classes(documents(spark, [])).count() == 0
    assert jaccard_join.distinct_documents(documents(spark, rows)).count() == 4


def test_components_of_a_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(39)] + [(100, 101)], "a long, b long")
    out = {r.doc: r.c for r in jaccard_join.components(links).collect()}
    assert out == {i: 0 for i in range(40)} | {100: 100, 101: 100}


def test_blocks_are_written_before_they_are_used(spark):
    pairs = spark.createDataFrame([(1, 2, 2, 2), (1, 2, 3, 2)], "a long, na long, b long, nb long").distinct()
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j")], "doc long, text string")
    held = texts.mapInArrow(jaccard_join._tokens(4), "doc bigint, n bigint, p bigint, q bigint, tokens binary").select("doc", "tokens")
    out = jaccard_join.verified(pairs, held, 85)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 2)]


def test_an_id_with_several_texts_keeps_all_their_links(spark):
    a, b, other = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(5, a), (5, b), (8, b), (7, b + " end"), (4, "start " + a), (9, other), (9, ""), (10, other + " end")]
    out = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.classes(documents(spark, rows)).collect()}
    assert out == {(5, 77): 4, (8, 77): 4, (7, 78): 4, (4, 78): 4, (9, 77): 9, (9, 0): 9, (10, 78): 9}


def test_pieces_and_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(jaccard_join, "MEETING", 3)
    out = by_id(jaccard_join.classes(documents(spark, rows), fragments=5), "n_shingles", "component_id")
    assert out == brute(rows)


def test_a_template_group_below_the_threshold_makes_no_pairs(spark):
    """Documents that share 85 to 91 % of their shingles and link to nothing: none of them is sent to the others."""
    template = prose(11, 900, 5000)
    rows = [(i, template + " " + prose(10_000 + i, 110, 10**6)) for i in range(300)]
    docs = documents(spark, rows).selectExpr("doc_id as doc", "text")
    held = docs.mapInArrow(jaccard_join._tokens(4), "doc bigint, n bigint, p bigint, q bigint, tokens binary").select("doc", "n", "tokens")
    segments = held.select("doc", "tokens").mapInArrow(jaccard_join._segments(4), "fragment int, docs binary, tokens binary")
    rare = segments.groupBy("fragment").applyInArrow(jaccard_join._frequencies(4), "bucket bigint, docs binary, tokens binary, counts binary")
    sized = held.selectExpr("doc", "n", "pmod(doc, 4) as bucket")
    postings = rare.groupBy("bucket").cogroup(sized.groupBy("bucket")).applyInArrow(jaccard_join._prefix(85), "token bigint, doc bigint, n bigint, i bigint")
    assert postings.count() > 10_000
    none = spark.createDataFrame([], "doc long, c long")
    assert jaccard_join._across(postings, none, 85).count() == 0
    out = by_id(jaccard_join.classes(documents(spark, rows)), "component_id")
    assert out == {i: i for i in range(300)}


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def plain_hash(word):
    total = sum(int(common._BYTES[c]) * pow(int(common._BASE), i, 2**64) for i, c in enumerate(word))
    return int(common.mix64(np.array([(total + len(word) * int(common._MIX)) % 2**64], np.uint64))[0])


def test_words_are_hashed_piece_by_piece(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 8)
    texts = [b"", b" ", b"a bb  ccc\tD", b"seven77 eight888 nine99999 " + b"x" * 40, b"Z" * 16 + b"\n" + b"y" * 17]
    hashes, starts = common.word_hashes(texts)
    assert [int(h) for h in hashes] == [plain_hash(w) for t in texts for w in t.split()]
    assert starts.tolist() == [0, 0, 0, 4, 8, 10]


def test_hashing_a_chunk_takes_little_memory():
    """A worker held 128 MB of powers and 96 MB of products for a chunk of 4 MB."""
    one = " ".join(prose(s, 200) for s in range(5)).encode()
    texts = [one] * (jaccard_join.CHUNK_BYTES // len(one))
    assert peak_mb(lambda: common.word_hashes(texts)) < 80
    assert peak_mb(lambda: common.word_hashes([b"x" * jaccard_join.CHUNK_BYTES])) < 80


def test_a_full_batch_is_cut_before_its_sets_are_unpacked():
    n, each = 4096, 1024
    sets = np.sort(np.random.RandomState(1).randint(0, 2**63, (n, each), dtype=np.int64).astype(np.uint64) * np.uint64(2), axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc", "tokens"])
    found = {}

    def run():
        for out in jaccard_join._segments(4)([batch]):
            for f, docs in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                found[f] = found.get(f, 0) + len(docs) // 8

    assert peak_mb(run) < 64
    assert [found[f] for f in range(4)] == np.bincount((sets >> np.uint64(62)).astype(int).ravel()).tolist()


def test_chunks_do_not_follow_batches():
    rows = [(i, "x" * (i % 7)) for i in range(1000)]
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc", "text"])
    want = list(common.chunks([whole.slice(i, 1) for i in range(1000)], 500))
    assert list(common.chunks([whole], 500)) == want and sum((ids for ids, _ in want), []) == list(range(1000))
    assert [part.num_rows for part in common.slices([whole, whole.slice(0, 0)], 300)] == [300, 300, 300, 100]
