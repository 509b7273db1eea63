"""The operators as named queries over the whole tables, with SQL twins where SQL can say the same."""

from pyspark.sql import functions as F

from terracell.llm.common import table

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _rules_sql():
    from terracell.llm.quality_rules import BASE, RULES

    pairs = {
        "n_words": ("n_words", "1"), "repeated_words": ("n_repeat_words*1000", "n_words"),
        "mean_word_chars": ("word_chars*1000", "n_words"), "symbols": ("n_symbols*1000", "word_chars"),
        "stop_words": ("n_stop_words*1000", "n_words"), "repeated_lines": ("n_dup_lines*1000", "n_lines"),
    }
    line = lambda r: f"{pairs[r[0]][0]} {'<=' if r[1] == 'max' else '>='} {pairs[r[0]][1]}*{r[2]}"
    return " AND ".join(map(line, BASE)), " AND ".join(map(line, RULES))


def _op8_sql():
    from terracell.llm.quality_rules import STOP_WORDS, SYMBOLS

    base, kept = _rules_sql()
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT *, NOT ({base}) AS base_failed, ({kept}) AS kept FROM m"""


@query("op8_quality_rules", _op8_sql())
def op8(spark, folder):
    from terracell.llm.quality_rules import judge

    return judge(table(spark, folder, "documents"))


@query("op9_byte_sharding")
def op9(spark, folder):
    from terracell.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, folder, "documents"), shards=40)


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, ws, len(ws) AS m, least(13, len(ws)) AS n FROM (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, m-n+2)) AS s FROM iw)),
dg AS (SELECT doc_id, n, s, array_to_string(ws[s:s+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws)-n+2)) AS s FROM dw, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, s, n, item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s+n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op4_decontamination", OP4_SQL)
def op4(spark, folder):
    from terracell.llm.decontaminate import judge

    return judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, first IS NULL OR first = doc_id AS stays FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE stays), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark, folder):
    from terracell.llm.line_dedup import dedup_report

    return dedup_report(table(spark, folder, "documents"))


@query("op3_packing")
def op3(spark, folder):
    from terracell.llm.packing import pieces

    return pieces(table(spark, folder, "documents"))


@query("op10_jaccard_join")
def op10(spark, folder):
    from terracell.llm.jaccard_join import classes

    return classes(table(spark, folder, "documents"))


@query("op7_token_counts")
def op7(spark, folder):
    from terracell.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"))


# The rules of the URL query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h, r
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id"""


@query("op2_url_rules", OP2_SQL)
def op2(spark, folder):
    from terracell.llm.url_rules import judge

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge(table(spark, folder, "pages"), rules)


@query("op1_importance_resampling")
def op1(spark, folder):
    from terracell.llm.resample import resample

    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_html_extraction")
def op5(spark, folder):
    from terracell.llm.html_text import extract

    return extract(table(spark, folder, "pages"))


def _tree_sql(leaves, nodes):
    return rf"""
{nodes}(tree, lvl, i, n, h) AS (SELECT tree, 0, i, n, h FROM {leaves} UNION ALL
    SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {nodes} WHERE n > 1 GROUP BY tree, lvl, i // 2, n)"""


def _climb_sql(name, start, nodes):
    """Rows of ``start`` carried up their tree: sibling digests are appended to the proof and folded in."""
    return rf"""
{name}(k, tree, lvl, i, h, proof, f) AS (SELECT k, tree, 0, i, h, proof, f FROM {start} UNION ALL
    SELECT u.k, u.tree, u.lvl + 1, u.i // 2, u.h, u.proof || coalesce(s.h, ''), sha256(CASE WHEN u.i % 2 = 0 THEN u.f || coalesce(s.h, '') ELSE s.h || u.f END)
    FROM {name} u JOIN {nodes} o ON o.tree = u.tree AND o.lvl = u.lvl AND o.i = u.i AND o.n > 1
    LEFT JOIN {nodes} s ON s.tree = u.tree AND s.lvl = u.lvl AND s.i = xor(u.i, 1::BIGINT))"""


def _op12_sql():
    value = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda chars: f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', chars, 'text'))})"
    # CRC-32 of the digits: a byte is mixed in, then eight shifts
    crc = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295::BIGINT)"""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('n_chars')} AS h, {leaf(f'CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END')} AS f FROM documents),
l AS (SELECT row_number() OVER () AS k, doc_id, tree, h, f, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql('l', 'nodes')},
subroots AS (SELECT '' AS tree, tree AS of, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql('subroots', 'tops')},
{_climb_sql('up', 'l', 'nodes')},
mid AS (SELECT up.k, '' AS tree, s.i, s.h, proof, f FROM up JOIN nodes o ON o.tree = up.tree AND o.lvl = up.lvl AND o.i = up.i AND o.n = 1 JOIN subroots s ON s.of = up.tree),
{_climb_sql('over', 'mid', 'tops')}
SELECT doc_id, l.h AS leaf, over.h AS subroot, o.h AS root, sha256(over.proof) AS proof_sha256, over.f AS folded_root, over.f = o.h AS verified
FROM l JOIN over USING (k) JOIN tops o ON o.lvl = over.lvl AND o.i = over.i AND o.n = 1"""


@query("op12_merkle_manifest", _op12_sql())
def op12(spark, folder):
    from terracell.llm.merkle import manifest, tampered_chars

    return manifest(table(spark, folder, "documents"), changed={"n_chars": tampered_chars()}).drop("path")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS ng FROM (SELECT DISTINCT lang, source FROM d) d
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.ng + 2 * l.v) AS p, 1 + 1000000000 * (total + 2) // (l.nl + 2 * l.v) AS q
        FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY x.lang, x.source, y.source),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark, folder):
    from terracell.llm.divergence import audit

    return audit(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(k, b) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.k, min(u.vec_id) AS least FROM r JOIN u ON u.k = r.b GROUP BY r.k),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.least, vec_id) AS component_id, coalesce(vec_id = coalesce(c.least, vec_id), true) AS kept
FROM v LEFT JOIN n USING (k) LEFT JOIN c USING (k)"""


@query("op11_near_vectors", OP11_SQL)
def op11(spark, folder):
    from terracell.llm.near_vectors import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))
