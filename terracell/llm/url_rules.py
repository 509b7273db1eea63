"""URL rules by a sort-merge range join.

A host is written with its labels reversed, each followed by a dot (``a.example.net`` is ``net.example.a.``). A rule for
a host and a path prefix is then the interval of all keys that begin with ``reversed host`` + NUL + ``path``. A URL is
probed once for its host and each host above it, with its own path, so a rule fits a URL exactly if one of the probes
lies in the rule's interval. Intervals of prefixes are nested or apart: one sweep over rules and probes, sorted by key,
keeps the stack of the rules that hold at the current key, and the top of the stack is the longest that fits.

Probes and rules are range-partitioned by key and page, so a host with a third of all pages spreads over partitions. A
partition may begin inside intervals opened before it: each reports the rules still open at its end and its first key,
and the few that go on are handed to the partitions after it. Equal probes of equal pages are not merged; each page
takes the longest of its probes' rules (host and path together; then the longer host, then block before allow).

Null URLs and URLs without ``://`` have an empty host and path and match no rule. Repeated pages are judged each on
its own. Rules with a null or an empty host, or a null path, are ignored; of equal rules with different verdicts block
wins. Without a rule the verdict is ``default``. Empty tables give no rows, or only default verdicts.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from terracell.llm.common import lower_ascii, parallelism, written

DEFAULT = "allow"
_SWEPT = "row bigint, host string, path string, verdict string"
_SWEPT_ARROW = pa.schema([("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])


def reversed_host(host):
    """``a.b`` as ``b.a.``; an empty host stays empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _probes(pages):
    """Keys of a page's host and of each host above it."""
    labels = F.reverse(F.split("host", r"\."))
    heads = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".\0"), F.col("path")))
    return pages.filter("host <> ''").select(F.explode(heads).alias("key"), F.lit(1).alias("kind"), "row", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"), F.lit(None).cast("string").alias("verdict"))


_REPORT = "part int, first string, last string, key string, host string, path string, verdict string"
_REPORT_NAMES = [c.split()[0] for c in _REPORT.split(", ")]


def _push(stack, rule):
    """Open a rule; of equal rules the first stays."""
    if not stack or stack[-1][0] != rule[0]:
        stack.append(rule)


def _close(stack, key):
    """Close the rules whose interval ends before ``key``."""
    while stack and not key.startswith(stack[-1][0]):
        stack.pop()


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _open_at_end(batches):
    """Per partition its first and last key and the rules still open at its end, in one row each."""
    found, part = [], None
    stack = first = last = None

    def told():
        return [(part, first, last, *s) for s in stack] or [(part, first, last, None, None, None, None)]

    for p, key, kind, _, host, path, verdict in _rows(batches):
        if p != part:
            found += told() if part is not None else []
            part, first, stack = p, key, []
        last = key
        _close(stack, key)
        if kind == 0:
            _push(stack, (key, host, path, verdict))
    found += told() if part is not None else []
    columns = zip(*found) if found else [[]] * 7
    types = [pa.int32(), *[pa.string()] * 6]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_REPORT_NAMES)


def _carried(reports):
    """Rules open at the start of each partition, from what the partitions before report."""
    own, ends, found, stack = {}, {}, {}, []
    for part, first, last, *rule in reports:
        ends[part] = (first, last)
        own.setdefault(part, []).extend([tuple(rule)] if rule[0] is not None else [])
    for part in sorted(ends):
        first, last = ends[part]
        _close(stack, first)
        found[part] = tuple(stack)
        _close(stack, last)
        for rule in own[part]:
            _push(stack, rule)
    return found


def _sweep(opened):
    """The rule on top of the stack for each probe of the partitions, which come sorted one after another."""

    def run(batches):
        stack, part = [], None
        for batch in batches:
            out = []
            for p, key, kind, row, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, stack = p, list(opened.get(p, ()))
                _close(stack, key)
                if kind == 0:
                    _push(stack, (key, host, path, verdict))
                elif stack:
                    out.append((row, *stack[-1][1:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SWEPT_ARROW)], schema=_SWEPT_ARROW)

    return run


def matches(pages, rules):
    """For each probe of ``pages`` (``row``, ``host``, ``path``) inside a rule: ``row`` and its longest rule."""
    spark = pages.sparkSession
    clean = rules.filter("host is not null and host <> '' and path is not null").withColumn("host", lower_ascii(F.col("host")))
    # the longest first in the stack is the last opened; of equal rules block sorts first
    starts = clean.select(
        F.concat(reversed_host(F.col("host")), F.lit("\0"), F.col("path")).alias("key"), F.lit(0).alias("kind"),
        F.when(F.col("verdict") == "block", 0).otherwise(1).cast("long").alias("row"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict",
    ).distinct()
    both = starts.union(_probes(pages))
    order = ["key", "kind", "row"]
    n = parallelism(spark)
    ranged = both.repartitionByRange(n, *order).select(F.spark_partition_id().alias("part"), *both.columns)
    ranged = written(ranged, "ranged").repartition(n, "part").sortWithinPartitions("part", *order)
    # rows per partition: the nesting depth at its last key at most
    opened = _carried([tuple(r) for r in ranged.mapInArrow(_open_at_end, _REPORT).collect()])
    return ranged.mapInArrow(_sweep(opened), _SWEPT)


def judge(pages, rules, id="page_id", url="url", default=DEFAULT):
    """One row per page: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    u = F.col("_u")
    after = F.when(F.locate("://", u) > 0, F.expr("substring(_u, locate('://', _u) + 3)"))
    slim = pages.select(F.col(id).alias("_id"), F.col(url).alias("_u")).withColumn("_rest", F.coalesce(after, F.lit("")))
    slim = slim.select(
        F.monotonically_increasing_id().alias("row"), "_id", lower_ascii(F.regexp_extract("_rest", r"\A([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("_rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"),
    )
    slim = written(slim, "urls")
    size = F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("labels"), (F.col("verdict") == "block").alias("block"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("said"),
    )
    best = matches(slim, rules).select("row", size.alias("r")).groupBy("row").agg(F.max("r").alias("r"))
    out = slim.join(best, "row", "left")
    return out.select(F.col("_id").alias(id), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.said", F.lit(default)).alias("verdict"))
