import numpy as np

import corpus_pipeline
from terracell.llm import packing, quality_rules
from tests.llm.frames import by_id
from tests.llm.test_lines_and_benchmark import brute_hits, brute_lines
from tests.llm.test_pairs import brute
from tests.llm.test_rules_and_shards import measures

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = packing_of(corpus_pipeline.run(spark, FOLDER))

    verdict = by_id(quality_rules.judge(docs), "kept")
    rows = [(i, t) for i, t in rows if verdict[i]]
    assert all(measures(t)[0] >= 50 for _, t in rows)
    rows = [(i, t) for i, (_, _, t) in brute_lines(rows).items()]
    components = brute(rows, threshold=80, k=5)
    rows = [(i, t) for i, t in rows if components[i][1] == i]
    rows = [(i, t) for i, t in rows if not brute_hits(t, items)[4]]
    encode = packing.Encoder()
    want = {i: np.append(encode(t), np.uint32(0)).astype("<u4").tobytes() for i, t in rows}
    assert out == want


def packing_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc, []).append((r.start, bytes(r.ids)))
    return {i: b"".join(x for _, x in sorted(parts)) for i, parts in found.items()}


def test_every_query_reads_whole_tables(spark):
    from terracell.llm.queries import QUERIES, SQL

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
