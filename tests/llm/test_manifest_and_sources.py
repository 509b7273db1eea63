import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from terracell.llm import divergence, merkle
from tests.llm.frames import TEXTS, documents

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
encoded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, i, arity):
    out = []
    for level in levels[:-1]:
        run = level[i - i % arity :][:arity]
        out.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        i //= arity
    return out


def brute_manifest(rows, arity):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, chars: H(*map(encoded, (r[0], r[3], r[2], chars, r[1])))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf(r, r[4]) for r in sorted(groups[k], key=order)], arity) for k in keys}
    top, out = tree([trees[k][-1][0] for k in keys], arity), []
    for n, k in enumerate(keys):
        for i, r in enumerate(sorted(groups[k], key=order)):
            path = steps(trees[k], i, arity) + steps(top, n, arity)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, r[4] + 1 if hit else r[4])
            for slot, others in path:
                folded = H(*others[:slot], folded, *others[slot:])
            proof = H(*[x for _, others in path for x in others])
            out.append((r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(map(str, out))


def odd_documents():
    r = random.Random(3)
    rows = [(i, f"t{i} é" * (i % 5), r.choice(["en", "de", None, "", "z", "é"]), r.choice(["a", None, ""]), r.choice([None, 5, i])) for i in range(137)]
    rows += [(3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (None, None, None, None, None), (None, "q", "solo", "s", 7), (200, "y" * 300_000, "en", "a", 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 3, "k", None) for r in rows], TEXTS)


def manifest_rows(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(str(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_brute_force(spark, arity):
    rows = odd_documents()
    out = merkle.manifest(frame(spark, rows).repartition(5), arity=arity, changed={"n_chars": merkle.tampered_chars()})
    assert manifest_rows(out) == brute_manifest(rows, arity)


def test_manifests_of_few_rows(spark):
    rows = odd_documents()
    assert merkle.manifest(frame(spark, [])).count() == 0
    alone = merkle.manifest(frame(spark, rows[:1])).collect()[0]
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.verified and alone.path == []


def test_any_change_of_a_row_is_found(spark):
    """Every column counts; a path that is folded from another row's leaf misses the root."""
    from pyspark.sql import functions as F

    rows = frame(spark, [(i, f"t{i}", "en", "s", i) for i in range(9)])
    for change in ({"text": F.concat("text", F.lit(" "))}, {"source": F.lit(None).cast("string")}, {"doc_id": F.col("doc_id") + 1}):
        assert merkle.manifest(rows, changed=change).filter("verified").count() == 0
    assert merkle.manifest(rows).filter("verified").count() == 9


def brute_audit(rows, least=10, top=10):
    """Rows of (doc_id, text, lang, source, ...)."""
    count, seen, groups = Counter(), Counter(), set()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        count.update((lang, source, w) for w in words)
        seen.update((lang, w) for w in set(words))
    f, out = lambda p, q: (p - q) ** 2 // (p + q), set()
    for lang in {g[0] for g in groups}:
        kept = [w for (l, w), n in seen.items() if l == lang and n >= least]
        sources = sorted(s for l, s in groups if l == lang)
        tables = {s: {w: count[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(tables[s][w] for s in sources) for w in kept}
        share = lambda t: {w: 1 + 10**9 * (n + 2) // (sum(t.values()) + 2 * len(kept)) for w, n in t.items()}
        p, q = {s: share(t) for s, t in tables.items()}, share(whole)
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[x][w]) for w in kept), x) for x in sources if x != s]
            terms = [(-f(p[s][w], q[w]), w) for w in kept if tables[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, n) for n, (v, item) in enumerate(found, 1)}
    return out


def words_of_sources():
    r, rows = random.Random(8), []
    for i in range(400):
        source = r.choice(["hot"] * 6 + [f"s{k}" for k in range(12)] + [None, ""])
        words = [f"Word{chr(97 + int(r.paretovariate(0.8)) % 26)}{'é' * (r.randrange(4) == 0)}" for _ in range(r.randrange(60))]
        rows.append((i, r.choice([" ", "-", "7", "\n"]).join(words), r.choice(["en", "en", "de", None]), source, 1))
    return rows + [(None, None, "en", "silent", None), (1, "", "solo", "s1", 0), (1, "", "solo", "s2", 0), (2, "a b " * 30_000, "en", "s1", 1)]


@pytest.mark.parametrize("options", [{}, {"bucket": 5}, {"least": 60, "top": 3}])
def test_audit_equals_brute_force(spark, options):
    rows = words_of_sources()
    out = divergence.audit(frame(spark, rows).repartition(4), **options).collect()
    found = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out]
    want = brute_audit(rows, **{k: v for k, v in options.items() if k != "bucket"})
    assert len(found) == len(set(found)) and set(found) == want


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Alpha beta,GAMMA é1Alpha " * 50).encode()
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert divergence.terms_of(text) == whole == {b"alpha": 100, b"beta": 50, b"gamma": 50, "é".encode(): 50}


def test_shares_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, terms = 7 * 10**12 + 3, 9 * 10**12 + 1, 12_345
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
