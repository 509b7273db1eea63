"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf: the SHA-256 of its columns. The leaves of a group (a language) are numbered in the order of their
ids and form a tree of ``arity`` children per node; the group's last node is its subroot, and the subroots, ordered by
group, form one more tree up to the root. A level is a table of (tree, index, digest). Each node is equijoined with its
siblings at computed indices (index XOR 1 for two children, slot offsets otherwise); the rows of slot zero then hold a
whole run and emit its parent. Levels are written, so a lost executor repeats one level. The siblings met on the way
are kept: joined from the top level down they give each leaf its path, which is its proof of membership.

A value enters a leaf as its UTF-8 byte count, ``:`` and itself, a null as ``-``, so no two rows share an input unless
they are equal. Nulls in any column, empty and very long texts are thus leaves like others; null ids and null groups
come first. Rows with the same id are ordered by their leaves; equal rows are equal leaves side by side. An empty table
gives no rows. A group of one row has no level: its leaf is its subroot. Digests are held as 32 bytes and hashed as
lower-case hex.
"""

from functools import reduce

from pyspark.sql import functions as F

from terracell.llm.common import numbered_by, written
from terracell.plans.skew import salted_join

ARITY = 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<slot:int,others:array<binary>>>"


def encoded(column):
    """A value with its byte count; null as ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def _text(digest):
    return F.lower(F.hex(digest))


def leaf_of(columns):
    """The digest (32 bytes) of the given column expressions."""
    return _digest(F.concat(*[encoded(c) for c in columns]))


def run_digest(others, own, slot):
    """Digest of a run: its nodes' digests in order, ``own`` standing at ``slot`` among the ``others``."""
    left = F.array_join(F.transform(F.filter(others, lambda x, i: i < slot), _text), "")
    right = F.array_join(F.transform(F.filter(others, lambda x, i: i >= slot), _text), "")
    return _digest(F.concat(left, _text(own), right))


def with_siblings(nodes, arity):
    """Nodes (``tree``, ``i``, ``n``, ``h``) with ``others``: the digests of their siblings from left to right."""
    index = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else None
    out, found = nodes, []
    for shift in range(1, arity):
        at = index if index is not None else F.col("i") - F.col("i") % arity + (F.col("i") + shift) % arity
        side = nodes.select("tree", F.col("i").alias("_at"), F.col("h").alias(f"_h{shift}"))
        out = out.withColumn("_at", at).join(side, ["tree", "_at"], "left").drop("_at")
        found.append(F.struct(((F.col("i") + shift) % arity).alias("slot"), F.col(f"_h{shift}").alias("h")))
    siblings = F.filter(F.array(*found), lambda s: s["h"].isNotNull())
    ordered = siblings if arity == 2 else F.array_sort(siblings)
    return out.select("tree", "i", "n", "h", (F.col("i") % arity).cast("int").alias("slot"), F.transform(ordered, lambda s: s["h"]).alias("others"))


def grow(nodes, most, arity):
    """Levels and roots of all trees at once.

    ``nodes`` are the leaves (``tree``, ``i``, ``n`` leaves in the tree, ``h``); ``most`` is the largest ``n``. Returns the
    levels from the leaves up, each with the siblings of its nodes, and the roots (``tree``, ``h``).
    """
    levels, roots = [], []
    while most > 1:
        roots.append(nodes.filter("n = 1").select("tree", "h"))
        level = written(with_siblings(nodes.filter("n > 1"), arity), f"level{len(levels)}")
        levels.append(level)
        parent = run_digest(F.col("others"), F.col("h"), F.lit(0)).alias("h")
        parents = level.filter("slot = 0").select("tree", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), parent)
        nodes, most = parents, -(-most // arity)
    roots.append(nodes.filter("n = 1").select("tree", "h"))
    return levels, reduce(lambda a, b: a.unionByName(b), roots)


def paths(levels, arity):
    """Per leaf (``tree``, ``i``) its steps up to the root of its tree; leaves that are roots have no row."""
    out = None
    for depth, level in enumerate(reversed(levels), 1):
        step = F.struct("slot", "others").alias("step")
        own = level.select("tree", "i", F.expr(f"i div {arity}").alias("up"), step)
        if out is None:
            out = own.select("tree", "i", F.array("step").alias("path"))
            continue
        above = out.select("tree", F.col("i").alias("up"), F.col("path").alias("rest"))
        rest = F.coalesce("rest", F.array().cast(STEP))
        out = own.join(above, ["tree", "up"], "left").select("tree", "i", F.concat(F.array("step"), rest).alias("path"))
        if depth % 4 == 0 and depth < len(levels):
            out = written(out, f"paths{depth}")  # no plan holds the joins of more than a few levels
    return out


def fold(leaf, path):
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: run_digest(s["others"], h, s["slot"]))


def proof_digest(path):
    """Digest of all siblings of a path, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["others"])), _text), ""), 256)


def manifest(docs, columns=COLUMNS, id="doc_id", group="lang", arity=ARITY, changed=None):
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``path``, ``folded_root`` and ``verified``.

    ``changed`` maps a column to the expression of the value found at the time of checking: the folded root comes from
    the leaf of those values and the siblings of the original, so it meets the root only where nothing was changed.
    """
    values = [F.col(c) for c in columns]
    found = [(changed or {}).get(c, F.col(c)) for c in columns]
    # a null group comes before all others, and the rest in the order of their bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(F.col(id).alias("id"), tree.alias("tree"), leaf_of(values).alias("h"), leaf_of(found).alias("found"))
    placed = written(numbered_by(rows, ["tree", "id", "h"]), "leaves")
    trees = written(placed.groupBy("tree").agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    leaves = salted_join(placed, trees, ["tree"], salt_on=["_rank"])
    leaves = written(leaves.select("tree", (F.col("_rank") - F.col("first")).alias("i"), "n", "h", "id", "found"), "placed")
    count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    levels, subroots = grow(leaves.select("tree", "i", "n", "h"), count[0] or 0, arity)

    ranked = numbered_by(subroots, ["tree"], "i")
    tops = written(ranked.select(F.lit("").alias("tree"), "i", F.lit(count[1]).alias("n"), "h", F.col("tree").alias("of")), "subroots")
    above, root = grow(tops.select("tree", "i", "n", "h"), count[1], arity)
    empty = F.array().cast(STEP)
    led = paths(above, arity)
    tops = tops.join(led.withColumnRenamed("path", "top"), ["tree", "i"], "left") if led is not None else tops.withColumn("top", empty)
    tops = tops.join(root.select("tree", F.col("h").alias("root")), "tree")
    tops = written(tops.select(F.col("of").alias("tree"), F.col("h").alias("subroot"), F.coalesce("top", empty).alias("top"), "root"), "tops")

    led = paths(levels, arity)
    held = leaves.join(led, ["tree", "i"], "left") if led is not None else leaves.withColumn("path", empty)
    out = salted_join(held, tops, ["tree"], salt_on=["i"])
    out = out.withColumn("path", F.concat(F.coalesce("path", empty), F.col("top")))
    out = out.withColumn("folded", fold(F.col("found"), F.col("path")))
    return out.select(
        F.col("id").alias(id), _text(F.col("h")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), "path", _text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def tampered_chars(id="doc_id", chars="n_chars"):
    """``n_chars`` of a copy in which one id in seven has one character more; nulls stay."""
    hit = F.crc32(F.col(id).cast("string").cast("binary")) % 7 == 0
    return F.when(hit, F.col(chars) + 1).otherwise(F.col(chars))
