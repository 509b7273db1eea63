import random
import re
import zlib
from collections import Counter

import pytest

from terracell.llm import quality_rules, sharding
from tests.llm.frames import by_id, documents, prose

ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "a b c " * 40), (6, prose(1, 300)), (7, prose(1, 300)),
    (8, "# $ % " + prose(2, 60)), (9, "same line here\nsame line here\n\nother\n" + prose(3, 80)), (10, prose(4, 5000)), (11, "é ñ 日本 語 x"), (6, prose(1, 300)),
]


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_plain_loops(spark):
    out = by_id(quality_rules.judge(documents(spark, ROWS)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in ROWS:
        n, chars, symbols, lines, repeats = measures(text)
        failed = n < 50 or 100 * repeats > 50 * n
        assert out[i][:6] == (n, chars, symbols, lines, repeats, failed)
        assert not (failed and out[i][6])
    assert out[1][6] is False and out[3][6] is False


def test_kept_documents_keep_their_columns(spark):
    docs = documents(spark, ROWS)
    out = quality_rules.kept_documents(docs)
    assert out.schema == docs.schema
    verdicts = quality_rules.judge(docs).filter("kept")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in verdicts.collect())
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0


def test_a_clean_text_of_over_a_million_words_is_kept(spark):
    r = random.Random(1)
    text = " ".join("the" if i % 50 == 0 else f"w{r.randrange(10**6)}" for i in range(1_000_100))
    docs = documents(spark, [(1, text)])
    out = quality_rules.judge(docs).first()
    assert (out.n_words, out.base_failed, out.kept) == (1_000_100, False, True)
    assert quality_rules.kept_documents(docs).count() == 1


def test_one_projection(spark):
    text = quality_rules.judge(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_are_balanced_and_gapless(spark, shards):
    rows = [(i, prose(i % 90, 20 + i % 50)) for i in range(300)] + [(400, None), (401, ""), (None, "x"), (3, prose(3, 23))]
    out = [r for r in sharding.shard_by_bytes(documents(spark, rows), shards).collect()]
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    texts = dict(rows)
    for r in out:
        body = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(body) + 16 and r.text_crc32 == zlib.crc32(body)
    sizes = Counter()
    for s in range(shards):
        mine = [r for r in out if r["shard"] == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r["size"] for r in mine)
    target, largest = sum(sizes.values()) / shards, max(r["size"] for r in out)
    assert all(abs(sizes[s] - target) < 2 * largest for s in sizes)
    order = sorted(out, key=lambda r: (r["shard"], r.slot))
    # equal texts stand side by side
    runs = [r.text_crc32 for n, r in enumerate(order) if n == 0 or order[n - 1].text_crc32 != r.text_crc32]
    assert len(runs) == len(set(runs))


def test_hot_group_is_cut(spark):
    rows = [(i, "the same text over and over") for i in range(400)] + [(1000 + i, prose(i, 10)) for i in range(100)]
    out = sharding.shard_by_bytes(documents(spark, rows), 10).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 200


def test_no_rows(spark):
    assert sharding.shard_by_bytes(documents(spark, []), 4).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, prose(i, 30)) for i in range(50)] + [(1, "a b"), (1, "a c"), (1, "a c"), (None, "x y"), (None, None), (2, "q")]
    docs = documents(spark, rows)
    assigned, shard, slot = sharding.write_shards(docs, 5, str(tmp_path / "out"))
    assert (shard, slot) == ("_shard", "_slot")
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert sorted(map(key, back.collect())) == sorted((i or -1, t or "") for i, t in rows)
    assert set(docs.columns) <= set(back.columns) and back.select("_shard").distinct().count() == 5
    found = sorted((r["_shard"], r["_slot"]) for r in back.collect())
    assert found == sorted((r["shard"], r.slot) for r in assigned.collect())


def test_write_shards_with_taken_names(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 9)) for i in range(20)]).selectExpr("*", "1 as _shard", "2 as _SLOT", "3 as _number")
    _, shard, slot = sharding.write_shards(docs, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert (shard, slot) == ("_shard_", "_slot_") and back.count() == 20 and back.filter("_shard = 1 and _SLOT = 2 and _number = 3").count() == 20
