"""Clean a corpus in five stages, each written as Parquet and read again by the next."""

from terracell.llm.common import table, written


def quality_rules(spark, docs, sf_dir):
    """Documents that break a quality rule go."""
    from terracell.llm.quality_rules import kept_documents

    return kept_documents(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines that an earlier document has go; the texts that stay keep all other lines."""
    from terracell.llm.line_dedup import dedup_documents

    return dedup_documents(docs, chars="n_chars")


def jaccard_join(spark, docs, sf_dir, words=5, percent=80):
    """Of each group of near copies (shingles of ``words`` words, ``percent`` of them shared) the document of the smallest id stays."""
    from terracell.llm.jaccard_join import distinct_documents

    return distinct_documents(docs, k=words, threshold=percent)


def decontamination(spark, docs, sf_dir):
    """Documents that benchmark windows cover in part go."""
    from terracell.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Token sequences of at most 1024 ids, one row per piece."""
    from terracell.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# Connected components and a tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-").lower())
    return docs
