import re

import pytest

from terracell.llm import html_text, labelled_pages, resample, url_rules
from tests.llm.frames import documents, prose

URLS = [
    "http://a.example.net/en/x?q#f", "https://example.net/en", "HTTP://Example.NET/EN/", "http://net/", "http://net", "http://notexample.net/x", "ftp://x.org/fr/", "http://org/fr/a/b", "http://example.com/de/",
    "http://deep.er.example.com/de/x/y", "http://example.com:80/de/", None, "", "no scheme", "http://", "http:///en/", "x://y://z.net/", "http://a..net/", "http://example.net./en/", "http://ünet.net/ü", "http://example.net/en/../",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("org", "", "allow"), ("ÜNET.net", "/ü", "allow"), (None, "/", "block"), ("x", None, "block"), ("", "/", "block")]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    low = lambda h: re.sub("[A-Z]", lambda m: m[0].lower(), h)
    fits = [(len(h) + len(p), len(h), v == "block", low(h) + p, v) for h, p, v in rules if h and p is not None and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 0) for r in rows], "page_id long, url string, html string, row long, key string, part int")


@pytest.mark.parametrize("repeat", [1, 60])
def test_url_rules_equal_brute_force(spark, repeat):
    rows = [(n, u, "") for n, u in enumerate(URLS * repeat)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages(spark, rows), rules).collect()}
    assert out == {n: brute_url(u, RULES) for n, u, _ in rows}


def test_many_nested_rules_over_partitions(spark):
    rules = [("h.example", "/a" * n, "block" if n % 2 else "allow") for n in range(12)] + [(f"s{n}.h.example", "/", "allow") for n in range(50)]
    rows = [(n, f"http://s{n % 70}.h.example" + "/a" * (n % 14) + f"/{n}", "") for n in range(900)]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages(spark, rows), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert out == {n: brute_url(u, rules) for n, u, _ in rows}


def test_no_urls_and_no_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge(pages(spark, []), none).count() == 0
    assert {r.verdict for r in url_rules.judge(pages(spark, [(1, "http://a.net/", ""), (1, "http://a.net/", ""), (None, None, "")]), none).collect()} == {"allow"}


def test_held_out_labelled_pages():
    """Each layout is left out once, with all its pages, and judged by a field that has not seen it."""
    groups = labelled_pages.GROUPS
    right = total = whole = 0
    for n, group in enumerate(groups):
        field = html_text.train([p for k, other in enumerate(groups) if k != n for p in other], rounds=120)
        for page in group:
            found = html_text.blocks(page)
            guess, truth = field.viterbi(html_text.features(found)), html_text.marks(found)
            right, total, whole = right + sum(g == t for g, t in zip(guess, truth)), total + len(truth), whole + (guess == truth)
    assert len(html_text.PAGES) >= 40 and right >= 0.85 * total and whole >= 0.45 * len(html_text.PAGES)


@pytest.mark.parametrize("page, want", [
    ("<body><svg width=1/><article><p>{}</p></article>", ["{}"]), ("<body><math/><p>{}</p>", ["{}"]), ("<body><svg><g/><path d=1/></svg><p>{}</p>", ["{}"]),
    ("<body><svg><path><p>{}</p>", ["{}"]), ("<body><svg><title>no</title><foreignObject><div>no</div></foreignObject></svg><p>{}</p>", ["{}"]), ("<div/><p>{}</p>", ["{}"]),
    ("<p>x <math><mi/>y</math> {}</p>", ["x y {}"]),
])
def test_closing_slashes(page, want):
    text = "A sentence of the article."
    assert [b[0] for b in html_text.blocks(page.replace("{}", text))] == [w.replace("{}", text) for w in want]


A, B, C = "The first sentence of a long paragraph, with some words more.", "Another one follows it, and says what the first left out.", "The last one ends the page."


@pytest.mark.parametrize("page, want", [
    (f"<nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{A}</p><pre>make all</pre><p>{B}</p></article><footer>&copy; Site</footer>", ["Title of it", A, "make all", B]),
    (f"<nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{A}</p><figure><img><figcaption>A picture</figcaption></figure><p>{B}</p></article>", ["Title of it", A, "A picture", B]),
    (f"<div><a href=/1>One</a> <a href=/2>Two</a></div><div><div>{A}</div><div>{B}</div><div>{C}</div></div><div class=footer>Imprint</div>", [A, B, C]),
    (f"<nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{A}</p><p>{B}</p></article><section class=comments><h2>Comments</h2><p>Nice text, I liked it a lot.</p></section>", ["Title of it", A, B]),
])
def test_nothing_of_an_article_is_lost(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.train()) == "\n\n".join(want)


def test_deep_pages_take_time_in_proportion():
    import time

    field, took = html_text.train(html_text.PAGES[:3], rounds=3), []
    for n in (5_000, 50_000):
        start = time.process_time()
        page = "<div class='a b'>x" * n + "</div>" * n + "<p>y" + "<button>" + "<span>" * n + "<div>z</div>" * 100
        assert len(html_text.main_text(page, field)) >= 0 and len(html_text.blocks(page, field.known)) == n + 101
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] and took[1] < 60


def test_viterbi_is_the_best_of_all_sequences():
    field = html_text.train(html_text.PAGES[:3], rounds=20)
    page = html_text.features(html_text.blocks(html_text.PAGES[3]))[:9]
    gain = field.scores(page)
    score = lambda labels: sum(gain[i] * y for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
    best = max(([(m >> i) & 1 for i in range(len(page))] for m in range(1 << len(page))), key=score)
    assert score(field.viterbi(page)) == pytest.approx(score(best))


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in rows.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub(r"<br>", " ", p) for p in re.split(r"</?(?:h1|p)>", inside))
        import html

        want[r.page_id] = "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if t)
    out = html_text.extract(rows)
    assert {r.page_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, None, "no markup &amp; all &#233;"), (5, "u", "<article><p>a" + " b" * 50_000 + "</p></article>"), (5, "u", "<script>x"), (None, "u", "<!-- <p>x</p> -->")]
    out = html_text.extract(pages(spark, rows)).collect()
    assert len(out) == 7 and all(r.text is not None for r in out)
    assert next(r for r in out if r.n_chars > 1000).n_chars == 100_001
    assert html_text.extract(pages(spark, [])).count() == 0


ARTICLE = "<article><h1>A title of the page</h1><p>The first sentence of a long paragraph, with some words more. It goes on.</p></article>"


@pytest.mark.parametrize("start", [
    "<body>", "", "<noscript><img src=x><p>no</p></noscript><body>", "<meta name=a><bgsound src=x><body>", "<style>p {}</style>",
])
def test_head_without_its_end_tag(start):
    page = "<html><head><title>Site</title>{}" + ARTICLE + "</html>"
    want = [b[0] for b in html_text.blocks(page.format("</head><body>"))]
    assert [b[0] for b in html_text.blocks(page.format(start))] == want and len(want) == 2
    field = html_text.train()
    assert html_text.main_text(page.format(start), field) == html_text.main_text(page.format("</head><body>"), field) != ""


def test_text_right_in_the_head_ends_it():
    found = lambda page: [b[0] for b in html_text.blocks(page)]
    assert found("<head><title>Site</title> \n Text <b>of</b> the page") == ["Text of the page"]
    assert found("<head><title>Site</title></body>late<p>x") == ["late", "x"]
    assert found("<head><script>a</script><title>Site</title></head>") == []


def test_formulas_are_text():
    page = "<body><p>So <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m tex</annotation></semantics></math> holds.</p>"
    assert [b[0] for b in html_text.blocks(page)] == ["So E=m holds."]


def test_resampling_prefers_the_target(spark):
    good = [(i, prose(i, 80, 200)) for i in range(200)]
    junk = [(1000 + i, " ".join(f"j{(i * k) % 150}" for k in range(80))) for i in range(100)]
    docs = documents(spark, good + junk + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000 + i, 0, 0) for i in range(0, 100, 2)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    out = resample.resample(docs, labels, k=200).collect()
    assert len(out) == 200 and sorted(r["rank"] for r in out) == list(range(200)) and all(r.kept for r in out)
    assert sum(r.doc_id < 1000 for r in out) >= 195
    assert sorted((r["rank"], r.doc_id) for r in resample.resample(docs, labels, k=200).collect()) == sorted((r["rank"], r.doc_id) for r in out)


def test_weights_ranks_and_sample_equal_plain_loops(spark):
    """Both models counted word by word, weights summed n-gram by n-gram, noise added and everything sorted."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    buckets, seed = 64, 7
    rows = [(i, prose(i, 5 + i % 40, 60)) for i in range(150)] + [(200, None), (201, " "), (202, "One two"), (203, "one TWO")]
    labelled = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 150, 2)] + [(202, 1, None), (151, None, 0), (None, 1, 0)]
    docs, labels = documents(spark, rows), spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")

    def grams(text):
        words = (text or "").encode().lower().split()
        return [(w,) for w in words] + list(zip(words, words[1:]))

    def bucket(gram):
        found, _ = resample.buckets_of([b" ".join(gram)], buckets)
        return int(found[len(gram) - 1 if len(gram) == 1 else 2])

    place = {g: bucket(g) for _, t in rows for g in grams(t)}
    good = {i for i, q, t in labelled if q == 1 and not t and i is not None}
    raw, target = Counter(), Counter()
    for i, t in rows:
        for g in grams(t):
            raw[place[g]] += 1
            target[place[g]] += i in good
    share = lambda c, b: (c[b] + 1.0) / (sum(c.values()) + buckets)
    weight = {i: sum(math.log(share(target, place[g])) - math.log(share(raw, place[g])) for g in grams(t)) for i, t in rows}
    noise = {r.doc_id: r.u for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).alias("u")).collect()}
    noisy = {i: w - math.log(-math.log((noise[i] + 0.5) / (1 << 52))) for i, w in weight.items()}
    order = sorted(noisy, key=lambda i: (-noisy[i], i))
    known = [(q == 1 and not t) for _, q, t in labelled if q is not None]
    k = round(len(rows) * sum(known) / len(known))

    out = resample.resample(docs, labels, seed=seed, buckets=buckets).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r["rank"])] == order[:k] and sorted(r["rank"] for r in out) == list(range(k))
    for r in out:
        assert r.log_weight == pytest.approx(weight[r.doc_id]) and r.noisy_weight == pytest.approx(noisy[r.doc_id])


def test_resampling_odd_inputs(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "c")])
    assert resample.resample(docs, labels).count() == 4
    assert resample.resample(docs.limit(0), labels).count() == 0


def test_gumbel_top_k_follows_the_weights(spark):
    """One of many draws: the share of draws that take a document is near its share of the weights."""
    docs = documents(spark, [(i, "x") for i in range(2000)])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    took = {r.doc_id for r in resample.resample(docs, labels, k=1000).collect()}
    assert 400 < sum(i < 1000 for i in took) < 600
