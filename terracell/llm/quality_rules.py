"""Quality rules as a table of thresholds, compiled into one Spark projection without user functions.

Definitions. Words are runs without ASCII white space. A null or empty text has no words, fails ``n_words`` and is not
kept. Thresholds are inclusive bounds on integer expressions, so no rounding can decide a case. Rows are judged one by
one: repeated rows and repeated ids each get their own verdict, an empty table gives an empty result, and other columns
are untouched (:func:`kept_documents`) or dropped (:func:`judge`).
"""

from pyspark.sql import functions as F

from terracell.llm.common import WHITE, free_name

SYMBOLS = "#*$%&|<>"
# Frequent words of the corpus languages, to tell running text from tables and lists.
STOP_WORDS = (
    "the of and to in a is that it for de la que le les et des un une en el los las y der die das und ist ein eine zu von mit"
).split()

# measure, bound, limit: a document is kept if every line holds. Shares are in thousandths.
RULES = (
    ("n_words", "min", 50),
    ("repeated_words", "max", 500),
    ("mean_word_chars", "min", 1_500),
    ("mean_word_chars", "max", 20_000),
    ("symbols", "max", 100),
    ("stop_words", "min", 5),
    ("repeated_lines", "max", 500),
)
BASE = RULES[:2]


def share(part, whole):
    """``part`` in thousandths of ``whole``, compared without division: see :func:`compile_rules`."""
    return F.col(part) * 1000, F.col(whole)


# Each measure is a pair (value * unit, base): it is compared as value <= limit * base.
MEASURES = {
    "n_words": lambda: (F.col("n_words"), F.lit(1)),
    "repeated_words": lambda: share("n_repeat_words", "n_words"),
    "mean_word_chars": lambda: share("word_chars", "n_words"),
    "symbols": lambda: share("n_symbols", "word_chars"),
    "stop_words": lambda: share("n_stop_words", "n_words"),
    "repeated_lines": lambda: share("n_dup_lines", "n_lines"),
}


def compile_rules(rules):
    """One boolean expression over the columns of :func:`measure`: true if every rule holds."""
    verdict = F.lit(True)
    for name, bound, limit in rules:
        value, base = MEASURES[name]()
        verdict = verdict & (value <= base * limit if bound == "max" else value >= base * limit)
    return verdict


def words_of(text):
    """The words of a text column that is not null."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated(words, n=3):
    """Steps (name, expression) that end in the number of words in ``n``-word windows found twice or more.

    Windows are sorted by hash with their position; equal neighbours mark repeated windows, and the sorted
    positions of those give the words covered. The work is n log n in the words of one text.
    """
    last = F.size(words) - (n - 1)
    window = lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(n)]).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    grams = F.when(last > 1, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), window))).otherwise(none)

    def twice(grams):
        same = lambda g, k: F.coalesce(F.get(grams, k)["h"] == g["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(grams, lambda g, k: same(g, k - 1) | same(g, k + 1)), lambda g: g["i"]))

    def covered(at):
        width = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

    return grams, twice, covered


def measure(df, text):
    """``df`` with the measures appended; ``df`` must hold none of their names (callers select first).

    What is built on the measures goes through :func:`once`.
    """
    t = F.col("_text")
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_words": words_of(t), "_lines": F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")})
    grams, twice, covered = repeated(F.col("_words"))
    df = df.withColumn("_grams", grams).withColumn("_at", twice(F.col("_grams")))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered(F.col("_at")),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
            "_n": F.monotonically_increasing_id(),
        }
    )
    return df.drop("_text", "_words", "_lines", "_grams", "_at")


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def once(column):
    """``column``, tied to the row number of :func:`measure`.

    The optimiser moves filters below projections and copies each measure into them, once for every use; it does
    not move them below a row number.
    """
    return F.when(F.col("_n") >= 0, column)


def judge(docs, rules=RULES, id="doc_id", text="text"):
    """One row per document: its id, the measures, ``base_failed`` and ``kept``."""
    out = measure(docs.select(F.col(id).alias("_id"), F.col(text).alias("_raw")), "_raw").drop("_raw")
    verdicts = {"base_failed": ~compile_rules(BASE), "kept": compile_rules(rules)}
    return out.select(F.col("_id").alias(id), *[once(F.col(c)).alias(c) for c in MEASURED], *[once(v).alias(c) for c, v in verdicts.items()])


def kept_documents(docs, rules=RULES, text="text"):
    """The documents that keep every rule, with their own columns. ``rules`` should begin with those of ``BASE``."""
    whole = free_name(docs, "_row")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(whole), F.col(text).alias("_raw"))
    out = measure(held, "_raw").filter(once(compile_rules(rules)))
    return out.select(*[F.col(whole)[c].alias(c) for c in docs.columns])
