"""Pixel accuracy, tolerant accuracy, per-class counts and loss values."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terracell.functions import bands as B
from terracell.operators.neighbourhood import max_pool, spread, with_halo, without_halo
from terracell.plans.skew import join_patches, numbered, patch_extent

COUNTS = ("num_correct", "num_model_one", "num_target_one", "num_one_correct", "num_wrong")


def confusion_columns(p="p", t="t"):
    """Aggregates over cells with a 0/1 prediction and a 0/1 target."""
    p, t = F.col(p), F.col(t)
    return [
        F.count_if(p == t).alias("num_correct"), F.count_if(p == 1).alias("num_model_one"),
        F.count_if(t == 1).alias("num_target_one"), F.count_if((p == 1) & (t == 1)).alias("num_one_correct"),
        F.count_if(p != t).alias("num_wrong"),
    ]


def confusion(cells, keys, p="p", t="t"):
    return cells.groupBy(*keys).agg(*confusion_columns(p, t))


def _f1(p, r):
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))


def plain_ratios(names=("a_n", "p_n", "r_n", "f1_n"), prefix=""):
    """Accuracy, precision, recall, F1; NULL where undefined."""
    k = {c: F.col(prefix + c) for c in COUNTS}
    precision = F.try_divide(k["num_one_correct"], k["num_model_one"])
    recall = F.try_divide(k["num_one_correct"], k["num_target_one"])
    accuracy = F.try_divide(k["num_correct"], k["num_correct"] + k["num_wrong"])
    return dict(zip(names, (accuracy, precision, recall, _f1(precision, recall))))


def tolerant_ratios(names=("a_f", "p_f", "r_f", "f1"), prefix=""):
    """The same ratios with near misses counted as hits."""
    k = {c: F.col(prefix + c) for c in (*COUNTS, "num_fp_f", "num_fn_f")}
    found = k["num_one_correct"] + k["num_fp_f"]
    targets = k["num_target_one"] + k["num_fp_f"] - k["num_fn_f"]
    precision = F.try_divide(found, k["num_model_one"])
    recall = F.when(targets > 0, F.try_divide(found, targets))
    accuracy = F.try_divide(
        k["num_correct"] + k["num_fp_f"] + k["num_fn_f"], k["num_correct"] + k["num_wrong"]
    )
    return dict(zip(names, (accuracy, precision, recall, _f1(precision, recall))))


def near_misses(cells, keys, n=1, p="p", t="t"):
    """Add ``fp_near`` and ``fn_near``.

    A wrong cell of predicted value m is a near miss when within ``n`` cells the target holds m and the
    prediction holds 1-m.
    """
    df = spread(
        with_halo(cells, keys, n), keys,
        {"_tmax": (t, True), "_tmin": (t, False), "_pmax": (p, True), "_pmin": (p, False)}, n,
    )
    df = without_halo(df, n)
    p, t = F.col(p), F.col(t)
    return df.withColumns(
        {
            "fp_near": (p == 1) & (t == 0) & (F.col("_tmax") == 1) & (F.col("_pmin") == 0),
            "fn_near": (p == 0) & (t == 1) & (F.col("_tmin") == 0) & (F.col("_pmax") == 1),
        }
    ).drop("_tmax", "_tmin", "_pmax", "_pmin")


def tolerant_confusion(cells, keys, n=1, p="p", t="t"):
    """Confusion counts plus ``num_fp_f`` and ``num_fn_f`` per image."""
    return near_misses(cells, keys, n, p, t).groupBy(*keys).agg(
        *confusion_columns(p, t), F.count_if("fp_near").alias("num_fp_f"), F.count_if("fn_near").alias("num_fn_f")
    )


def pixel_stats(image_counts, by=()):
    """Micro averages over all images from their counts."""
    names = (*COUNTS, "num_fp_f", "num_fn_f")
    sums = image_counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    plain = plain_ratios(("a_pixel", "p_pixel", "r_pixel", "f1_pixel"))
    tolerant = tolerant_ratios(("a_pixel_f", "p_pixel_f", "r_pixel_f", "f1_pixel_f"))
    return sums.select(*by, *[v.alias(k) for k, v in {**plain, **tolerant}.items()])


def class_columns(classes, cls="cls", p="p"):
    t = F.when(F.col(cls) > 0, 1).otherwise(0)
    columns = []
    for i in classes:
        of_class = F.col(cls) == i
        columns += [
            F.count_if(of_class).alias(f"target_val_{i}"),
            F.count_if(of_class & (F.col(p) == t)).alias(f"target_val_{i}_correct"),
        ]
    return columns


def class_counts(cells, keys, classes, cls="cls", p="p"):
    """Cells and correctly predicted cells of each class, one column pair per class."""
    return cells.groupBy(*keys).agg(*class_columns(classes, cls, p))


def weighted_bce(p, t, w):
    """Aggregate: mean weighted cross entropy with logarithms held above -100."""
    log = lambda x: F.greatest(F.coalesce(F.ln(F.when(x > 0, x)), F.lit(-100.0)), F.lit(-100.0))
    return F.avg(-w * (t * log(p) + (1 - t) * log(1 - p)))


def tanimoto_loss(p, t, w):
    """Aggregate: one minus the mean similarity of the weighted values and of their complements."""
    def similarity(a, b):
        bottom = F.sum(a * a + b * b - a * b)
        return F.when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(F.sum(a * b), bottom))

    a, b = w * p, w * t
    return 1 - (similarity(a, b) + similarity(w - a, w - b)) / 2


def losses(cells, keys, p="prob", t="t", w="weight", tanimoto_share=0.7):
    """Cross entropy, dual Tanimoto (weights held below 1) and their blend."""
    p, t, w = F.col(p).cast("double"), F.col(t).cast("double"), F.col(w).cast("double")
    out = cells.groupBy(*keys).agg(
        weighted_bce(p, t, w).alias("bce"), tanimoto_loss(p, t, F.least(w, F.lit(1.0))).alias("tanimoto")
    )
    return out.withColumn("total", F.col("tanimoto") * tanimoto_share + F.col("bce") * (1 - tanimoto_share))


def boosted_weights(cells, image_ratios, keys, t="t", w="weight"):
    """Double the positives of images that found nothing; raise the negatives of images that marked all.

    ``image_ratios`` holds the tolerant a_f, r_f and f1 per image.
    """
    ratios = image_ratios.select(*keys, "a_f", "r_f", "f1")
    nothing = (F.coalesce("f1", F.lit(0.0)) == 0) & (F.col("a_f") < 0.9)
    everything = (F.col("r_f") > 0.98) & (F.col("a_f") < 0.2)
    weight = (
        F.when(nothing & (F.col(t) == 1), F.col(w) * 2.0)
        .when(nothing, F.col(w))
        .when(everything & (F.col(t) == 0), F.col(w) + 0.5)
        .otherwise(F.col(w))
    )
    placed = cells.groupBy(*keys).agg(*patch_extent()).join(ratios, list(keys))
    return join_patches(cells, placed, keys).withColumn(w, weight).drop("a_f", "r_f", "f1")


def clip_hard_images(entropies, batch="batch", value="entropy", keep=20, spread_limit=2.5, segment=100_000):
    """Entropy of each image, 0 where above mean + 2.5 deviations of the last ``keep`` batches.

    Batches are reduced to their moments first and numbered; the rolling window then runs over the numbers cut
    into segments with a border of ``keep`` batches, so no single task sees the whole history. Variances are merged
    around the window's mean, which does not cancel for large values.
    """
    v = F.col(value)
    batches = entropies.select(batch).distinct()
    # batches are counted, not their numbers: gaps don't shorten the history
    ranks = numbered(batches.filter(F.col(batch).isNotNull()), [], batch, segment, name="_rank")
    moments = entropies.groupBy(batch).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.var_pop(v).alias("_q")).join(ranks, batch)
    seg = lambda x: F.floor(x / F.lit(segment))
    spread_out = moments.withColumn("_seg", F.explode(F.sequence(seg(F.col("_rank")), seg(F.col("_rank") + keep - 1))))
    w = Window.partitionBy("_seg").orderBy("_rank").rowsBetween(-(keep - 1), 0)
    rolled = spread_out.select(
        batch, "_seg", "_rank", F.sum("_n").over(w).alias("_n"), F.sum("_s").over(w).alias("_s"), F.collect_list(F.struct("_n", "_s", "_q")).over(w).alias("_of")
    ).filter(seg(F.col("_rank")) == F.col("_seg"))
    mean = F.col("_s") / F.col("_n")
    off = lambda m: m["_s"] / m["_n"] - mean
    spread_of = F.aggregate(F.filter("_of", lambda m: m["_n"] > 0), F.lit(0.0), lambda a, m: a + m["_n"] * (m["_q"] + off(m) * off(m)))
    deviation = F.sqrt(spread_of / F.col("_n"))
    limits = rolled.select(batch, (mean + spread_limit * deviation).alias("_top"))
    out = entropies.join(limits, batch)
    return out.withColumn("clipped", F.when(v > F.col("_top"), F.lit(0.0)).otherwise(v)).drop("_top")


def evaluation_table(cells, keys, prob="prob", cls="cls", n=1, classes=range(23)):
    """One row per image: ratios, tolerant ratios, counts and class counters, in one pass over the cells."""
    df = cells.withColumns(
        {"p": B.binarise(F.col(prob)), "t": F.when(F.col(cls) > 0, F.lit(1)).otherwise(F.lit(0))}
    )
    marked = near_misses(df.select(*keys, "r", "c", "p", "t", cls), keys, n)
    grouped = marked.groupBy(*keys).agg(
        *confusion_columns(), F.count_if("fp_near").alias("num_fp_f"), F.count_if("fn_near").alias("num_fn_f"),
        *class_columns(classes, cls),
    )
    return grouped.withColumns({**plain_ratios(), **tolerant_ratios()})


def score_against_labels(scores, labels, keys, pool_steps, cls="cls"):
    """Scores joined to labels pooled down to the score's resolution."""
    return scores.join(max_pool(labels, keys, pool_steps, (cls,)), [*keys, "r", "c"])
