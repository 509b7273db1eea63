"""Small frames with every odd case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, words string, part int, _key string, kind int"


def documents(spark, rows):
    """Rows of (id, text) with the columns of documents and extra ones whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "w", 3, "k", None) for i, t in rows]
    return spark.createDataFrame(full, TEXTS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
