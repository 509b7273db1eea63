import hashlib
import re

import pytest

from terracell.llm import decontaminate, line_dedup
from tests.llm.frames import by_id, documents, prose

LINES = [
    (5, "A shared line here\nonly in five\nA shared line here"), (3, "  a SHARED line here\t\nshort\nonly in three"), (9, "A shared line here"),
    (7, "short\nshort\n\n" + "x" * 20), (1, None), (2, ""), (4, "élan vitalé\nélan vital"), (6, "ÉLAN VITALÉ\nélan vital"), (8, "\n\n\n"), (11, prose(1, 3000).replace(" w1", "\nw1")),
    (12, prose(1, 3000).replace(" w1", "\nw1")), (None, "A shared line here"), (3, "  a SHARED line here\t\nshort\nonly in three"),
]


def brute_lines(rows, least=10):
    key = lambda line: re.sub(rb"[A-Z]", lambda m: m[0].lower(), line.encode().strip(b" \t\n\x0b\x0c\r")).decode()
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first.setdefault(k, []).append(-1 if i is None else i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(first[key(x)]) == (-1 if i is None else i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_lines_equal_brute_force(spark, partitions):
    docs = documents(spark, LINES).repartition(partitions)
    out = by_id(line_dedup.dedup_report(docs), "n_lines", "n_dropped", "kept_sha256")
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute_lines(LINES).items()}
    assert out == want
    kept = line_dedup.dedup_documents(docs, chars="n_chars")
    assert kept.schema == docs.schema and kept.count() == len(LINES)
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (t, len(t)) for i, (_, _, t) in brute_lines(LINES).items()}


def test_a_hot_line_over_many_partitions(spark):
    rows = [(i, f"the line that all of them have\nown line of document {i}") for i in range(700)]
    out = by_id(line_dedup.dedup_report(documents(spark, rows).repartition(7)), "n_dropped")
    assert out == {i: int(i > 0) for i in range(700)}


def test_no_lines(spark):
    assert line_dedup.dedup_report(documents(spark, [])).count() == 0


def test_positions_round_trip():
    for positions in ([0], [5, 6, 200, 201, 70_000], []):
        assert line_dedup.unpack_positions(line_dedup.pack_positions(positions)) == positions


ITEM = prose(50, 40, 10_000)
ITEMS = [("b", ITEM), ("a", "Short item"), ("c", ITEM), ("c", ITEM), ("d", None), ("e", ""), (None, ITEM), ("f", prose(51, 13, 10_000)), ("g", "one"), ("h", "x y x y x y x y x y x y x y x y")]
ITEM_WORDS = ITEM.split()
TEXTS = [
    (1, None), (2, ""), (3, "nothing of it"), (4, "say SHORT, item!"), (5, " ".join(ITEM_WORDS[5:25])), (6, prose(60, 200) + " " + " ".join(ITEM_WORDS[5:18])), (7, " ".join(ITEM_WORDS[5:17])),
    (8, prose(61, 400) + " " + ITEM + " " + prose(62, 300)), (9, ITEM.upper()), (10, " ".join(ITEM_WORDS[:14] + ["no"] + ITEM_WORDS[14:28])), (11, "x y " * 30), (12, "y x " * 7), (13, "one two one"), (9, ITEM.upper()),
    (14, prose(51, 13, 10_000) + "é"), (15, "one"), (None, ITEM),
]


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for i, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(13, len(own))
        windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own and i is not None else set()
        for s in range(len(words) - n + 1):
            if tuple(words[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(i)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("small", [200_000, 0])
def test_contamination_equals_brute_force(spark, small):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = documents(spark, TEXTS)
    out = by_id(decontaminate.judge(docs, items, small=small), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = {i: brute_hits(t, ITEMS) for i, t in TEXTS}
    assert out == want
    clean = decontaminate.clean_documents(docs, items, small=small)
    assert clean.schema == docs.schema
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id) == sorted(i for i, t in TEXTS if i and not want[i][4])


def test_a_long_text_with_a_hit_at_every_second_word(spark):
    items = [("t", "the"), ("u", " ".join(f"the r{i}" for i in range(9, 29)))]
    rows = [(1, " ".join(f"the r{i}" for i in range(100_000))), (2, "the " * 50_000), (3, "no such word")]
    out = by_id(decontaminate.judge(documents(spark, rows), spark.createDataFrame(items, "item_id string, text string")), "n_words", "n_hit", "n_items", "contaminated")
    assert out == {1: (200_000, 100_000 + 20, 2, True), 2: (50_000, 50_000, 1, True), 3: (3, 0, 0, False)}


@pytest.mark.parametrize("segment, stretch", [(1, 1), (5, 16)])
def test_segments_and_stretches_of_any_size_give_the_same(spark, monkeypatch, segment, stretch):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    monkeypatch.setattr(decontaminate, "SMALL_BYTES", 0)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    out = by_id(decontaminate.judge(documents(spark, TEXTS), items), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert out == {i: brute_hits(t, ITEMS) for i, t in TEXTS}


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = documents(spark, TEXTS)
    assert decontaminate.judge(docs, none).filter("contaminated or n_items > 0").count() == 0
    assert decontaminate.judge(docs.limit(0), spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == len(TEXTS)


def test_no_python_on_the_way(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    text = decontaminate.judge(documents(spark, TEXTS), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text
