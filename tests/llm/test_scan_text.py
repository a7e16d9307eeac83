"""Operators 4, 8, 9 and 10 against brute force and fixed cases."""

import hashlib
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalens.llm import fingerprints, html_extract, licenses, pii


# ---- licenses -----------------------------------------------------------------------
def plain(t):
    return [x for x in re.sub(r"[^\w\s]|_", "", (t or "").lower()).split() if x]


def brute_licenses(t, names=licenses.TEMPLATES):
    """Templates of which three quarters of the shingles lie in one window of the planned length."""
    w = plain(t)
    have = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, text in names.items():
        v = plain(text)
        want = {tuple(v[i:i + 5]) for i in range(len(v) - 4)}
        d, width, _ = licenses.plan(len(want))
        for q in range(0, max(1, len(have)), d):
            found = len(want & set(have[q:q + width]))
            if 4 * found >= 3 * len(want):
                out[name] = max(out.get(name, 0), found / len(want))
    return out


def test_licenses_match_brute_force(spark, docs):
    rng = np.random.default_rng(2)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        pad = [f"p{x}" for x in rng.integers(0, 99, 300)]
        rows.append((10_000 + i, " ".join(pad[:i * 7] + w + pad[i * 7:])))
        if len(w) > 20:          # one changed word near an end keeps three quarters
            rows.append((20_000 + i, " ".join(pad[:31] + w[:-2] + ["changed"] + w[-1:] + pad[31:])))
        rows.append((30_000 + i, " ".join(pad[:50] + w[:len(w) // 2] + pad[50:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {x["license"]: x["containment"] for x in r["licenses"]}
           for r in licenses.scan(df).collect()}
    want = {i: brute_licenses(t) for i, t in rows}
    assert got == want
    assert sum(map(bool, want.values())) >= 15


def test_bands_guarantee_recall():
    for m in range(1, 200):
        d, w, b = licenses.plan(m)
        least = -(-3 * m // 4)
        s = least / (w + m - least)
        assert w >= m and (m <= 3 or w >= m + d - 1) and 1 - (1 - min(s, 1)) ** b >= 0.999


def test_measured_recall_of_every_template(spark):
    rng = np.random.default_rng(8)
    rows, contexts = [], 200
    for name, text in licenses.TEMPLATES.items():
        w = plain(text)
        m = len({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
        least = -(-3 * m // 4) if m < 500 else 9 * m // 10      # long texts repeat shingles
        # whole, and exactly three quarters of the shingles: the first ones, the last ones
        for kind, cut in enumerate((w, w[:len(w) - (m - least)], w[m - least:])):
            for _ in range(contexts if m < 500 else 2):
                pad = [f"c{x}" for x in rng.integers(0, 10**6, 60)]
                at = int(rng.integers(0, 61))
                rows.append((name, kind, " ".join(pad[:at] + cut + pad[at:])))
    df = spark.createDataFrame(rows, "name string, kind int, text string")
    got = licenses.scan(df).groupBy("name", "kind").agg(F.avg(F.array_contains(
        F.transform("licenses", lambda x: x["license"]), F.col("name")).cast("int")).alias("recall")).collect()
    assert {r["name"] for r in got} == set(licenses.TEMPLATES)
    assert [r for r in got if r["recall"] < 0.99] == []


def test_usual_licenses_are_covered(spark):
    body = licenses.TEMPLATES["mit-text"].split("\n\n")
    rows = {"gpl-2.0": "Distributed under the GNU General Public License version 2 only.",
            "lgpl": "You may use it under the terms of the GNU Lesser General Public License.",
            "agpl": "You may use it under the terms of the GNU Affero General Public License.",
            "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
            "mit-text": "Some tool.\n" + "\n".join([body[0], *body[1:]]),
            "gpl-2.0-text": licenses.TEMPLATES["gpl-2.0-text"], "zlib-text": licenses.TEMPLATES["zlib-text"],
            "unlicense-text": licenses.TEMPLATES["unlicense-text"],
            "none": "This program is free software: you can redistribute it."}
    got = {r["name"]: [x["license"] for x in r["licenses"]] for r in licenses.scan(
        spark.createDataFrame(list(rows.items()), "name string, text string")).collect()}
    assert all(n in got[n] for n in rows if n != "none") and got["none"] == []
    # a notice of one of the GNU licenses is not taken for another
    assert got["lgpl"] == ["lgpl"] and got["agpl"] == ["agpl"] and got["gpl-2.0"] == ["gpl-2.0"]


def test_license_edges(spark, edge, nothing):
    out = licenses.scan(edge)
    assert out.count() == edge.count() and out.where("size(licenses) > 0").count() == 0
    assert set(edge.columns) < set(out.columns)
    assert licenses.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.template_shingles(spark, {"short": "too short"})


# ---- fingerprints --------------------------------------------------------------------
def test_edited_text_and_context_free_anchors(spark, edge):
    rng = np.random.default_rng(6)
    short = [(100 + i, "".join(rng.choice(list("abc "), int(n)))) for i, n in enumerate(rng.integers(0, 45, 150))]
    df = (edge.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
          .union(spark.createDataFrame(short, "doc_id long, text string")))
    rows = sorted(df.collect(), key=lambda r: -r["doc_id"])
    out = {r["doc_id"]: r for r in fingerprints.compare_with_next(df).collect()}
    edited = []
    for i, r in enumerate(rows):
        t, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        n = len(t) // 3
        edited.append((r["doc_id"], t[:len(t) - n] + following[:n]))
        got = out[r["doc_id"]]
        assert got["n_chars"] == len(t)
        assert got["edited_sha256"] == hashlib.sha256(edited[-1][1].encode()).hexdigest()
        assert 0 <= got["near_next"] <= 1 and 0 <= got["near_edited"] <= 1
    direct = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(
        spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    own = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    for i, r in out.items():
        assert r["edited_fingerprint"] == direct[i] and r["fingerprint"] == own[i]
    assert own[8] == own[9] and own[6] != own[7] and own[1] == own[2] == ""
    assert out[7]["near_edited"] > 0.5 and out[7]["near_next"] > 0.9


def test_anchors_do_not_depend_on_chunks_or_context(spark):
    """Code points beyond the basic plane count as one position."""
    rng = np.random.default_rng(8)
    body = "".join(rng.choice(list("abcdeé \n𝄞"), 9_000))
    rows = [(0, body), (1, "x" * 5_000 + body)]
    a, b = (r["a"] for r in spark.createDataFrame(rows, "id int, text string").select(
        "id", fingerprints.anchors(fingerprints.F.col("text")).alias("a")).orderBy("id").collect())
    shifted = {(x >> 32, x & 0xFFFFFFFF) for x in b}
    assert len(a) > 500 and all(((x >> 32) + 5_000, x & 0xFFFFFFFF) in shifted for x in a)
    gaps = np.diff(sorted(x >> 32 for x in a))
    assert gaps.max() < 200


def test_buckets_cover_all_rows_once(spark, nothing):
    ids = [int(x) for x in np.random.default_rng(1).integers(0, 10**6, 700)] + [5, 5, 5]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows, order = fingerprints.bucketed(df, rows_per_bucket=50)
    got = rows.withColumn("n", fingerprints.F.lead("doc_id").over(order)).where("copy = 0").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    distinct = sorted(set(ids), reverse=True)
    after = dict(zip(distinct, distinct[1:] + distinct[:1]))
    assert all(r["n"] in (r["doc_id"], after[r["doc_id"]]) for r in got)
    assert fingerprints.compare_with_next(nothing).count() == 0


# ---- html ------------------------------------------------------------------------------
def test_articles_of_labelled_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(pages)
    out = {r["page_id"]: r for r in html_extract.extract_text(pages, model, keep=["page_id"]).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = re.sub(r"</?(?:p|h1)>", "\0", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in parts.split("\0")]
        want = "\n".join(b for b in blocks if b)
        assert out[r["page_id"]]["text"] == want and out[r["page_id"]]["n_chars"] == len(want)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body>
<header><h1>Site name</h1><a href="/">Home</a></header>
<div class="cookie-notice"><p>We use cookies to make this site better for all of you.</p></div>
<script>var x = "</p><p>not text</p>";</script>
<div id="content"><h1>Head line</h1><p>First para with <a href="x">a link</a> &amp; words that go on and on.
<p>Second&nbsp;one<br>goes on.</p><ul><li>one item</li><li>two items</li></ul>
<div class="ad">Buy this thing now</div><!-- a comment --><p>Last paragraph of the text, long enough to count.</p></div>
<div class="sidebar"><ul><li><a href="m">more</a></li></ul></div>
<section id="comments"><h2>Comments</h2><p>I do not agree at all with what is written here, and I have the time
to write a comment that is longer than the article itself, so that it would win.</p></section>
<form><label>Name</label><input></form><footer>&copy; all</footer></body></html>"""


def test_furniture_without_article_marks():
    want = ("Head line\nFirst para with a link & words that go on and on.\nSecond one goes on.\none item\n"
            "two items\nLast paragraph of the text, long enough to count.")
    assert html_extract.extract(PAGE, {}) == want


def test_furniture_names_on_wrappers():
    text = "First words of the piece that go on and on for a while."
    for head in ("<body class='no-sidebar'>", "<body class='has-comments'><div class='search-enabled'>",
                 "<body class='sidebar'><div class='page-with-sidebar widget'>"):
        page = f"{head}<nav>Home</nav><article class='social-post'><p>{text}</p></article>"
        assert html_extract.extract(page, {}) == text
        if "widget" not in head:
            assert html_extract.extract(page.replace("article", "div").replace("social-post", "x"), {}) == text
    # comments stay out, also as articles of their own and when they are longer
    page = (f"<body class='no-sidebar'><div class='x'><p>{text}</p></div><section id='comments'>"
            f"<article class='comment'><p>{text * 9}</p></article></section>")
    assert html_extract.extract(page, {}) == text


def test_linked_list_items_of_the_article_stay():
    first, last = "The first paragraph has quite a few words in it.", "The last paragraph has quite a few words too."
    items = "<ul><li><a href='a'>Some work</a></li><li><a href='b'>Another work</a></li></ul>"
    want = f"{first}\nSome work\nAnother work\n{last}"
    inner = f"<p>{first}</p>{items}<p>{last}</p>"
    menu = "<div><ul><li><a href='m'>Menu entry</a></li></ul></div>"
    for tag in ("article", "div"):
        assert html_extract.extract(f"<body>{menu}<{tag}>{inner}</{tag}>{menu}</body>", {}) == want
    # sources at the end of a marked article
    assert html_extract.extract(f"<body><article><p>{first}</p>{items}</article>{menu}</body>", {}) == (
        f"{first}\nSome work\nAnother work")


def test_html_edges(spark, nothing):
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>a < b and c > d"), (5, "<div><p>open"),
            (6, "<script>never closed <p>x"), (7, "<nav><a>menu</a></nav>"), (8, "<p>x</p>" * 5000), (8, "<p>twice")]
    pages = spark.createDataFrame([(i, h, "u", "t", 1) for i, h in rows],
                                  "page_id long, html string, url string, text string, n_chars int")
    out = html_extract.extract_text(pages, html_extract.fit(pages), keep=["page_id", "url"])
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"]) for r in out.collect())
    assert got[:7] == [(1, ""), (2, ""), (3, "plain words only"), (4, "a < b and c > d"), (5, "open"), (6, ""), (7, "")]
    assert got[7] == (8, "twice") and got[8][1].count("x") == 5000
    assert html_extract.extract_text(pages.where("false"), {}, keep=["page_id"]).count() == 0


# ---- personal data -------------------------------------------------------------------------
def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns(docs):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab1239.@-+ ()%é\n"), int(n))) for n in rng.integers(0, 40, 5000)]
    texts += [r["text"] or "" for r in docs.collect()]
    texts += ["+4111 1111 1111 1111 ", "4111-1111-1111-1111", "1.2.3.4.5", "999.1.1.1 1.1.1.1", "0001.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.N_SYMBOLS, (3, 12)), rng.integers(0, pii.N_TAGS, (3, 12))
    p = {k: v.astype(np.float64) for k, v in pii.init().items()}
    loss, g = pii.gradient(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-5
        assert abs((pii.gradient(q, x, y)[0] - loss) / 1e-5 - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_model_learns_held_out_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in d.where("doc_id % 5 = 0 and text rlike '[0-9@]'").collect()]
    model = pii.fit(d.where("doc_id % 5 <> 0"))
    base = [pii.base_spans(t) for t in texts]
    found = pii.model_spans(texts, model, [[]] * len(texts))
    known = sum(len(b) for b in base)
    hit = sum(len(set(b) & set(f)) for b, f in zip(base, found))
    assert known > 50 and hit >= 0.6 * known
    assert sum(map(len, found)) <= hit + 0.2 * known


def test_windows_cover_every_digit():
    text = "a" * 500 + "1" + "b" * 70 + "@" + "c" * 31 + "7"
    starts = pii.hot_windows(text)
    for i, c in enumerate(text):
        if c in "1@7":
            assert any(s <= i < s + pii.WINDOW for s in starts)
    assert (starts % pii.STRIDE == 0).all()


def test_pii_edges(edge, nothing):
    found = pii.detect(edge, pii.fit(edge), keep=["doc_id"]).collect()
    assert len(found) == edge.count()
    spans = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in found}
    text = "mail me at a.b@c.de or +1 (234) 555-7975"
    assert spans[12] == [(11, 0, 19), (23, 3, 40)] and not any(v for k, v in spans.items() if k != 12)
    red = pii.redact(edge, None)
    assert red.columns == edge.columns
    kept = {r["doc_id"]: r["text"] for r in red.collect()}
    assert kept[12] == "mail me at <EMAIL> or <PHONE>" and kept[1] is None and kept[2] == ""
    assert pii.fit(nothing) is None and pii.detect(nothing, None, keep=["doc_id"]).count() == 0
    assert pii.masked(text, [(0, 0, 4), (2, 1, 6)]) == "<EMAIL>e at" + text[10:]


def test_pii_long_runs_of_digits():
    zeros = "0" * 5000
    for text, want in ((f"x {zeros}.1.1.1 y", [(2, 1, 2 + 5006)]), (f"{zeros}9999.1.1.1", []), ("9" * 6000, []),
                       (f"{zeros}255.0.{zeros}.1", [(0, 1, len(f"{zeros}255.0.{zeros}.1"))])):
        assert [s for s in pii.base_spans(text) if s[1] == 1] == want


@pytest.mark.parametrize("page, want", [
    ("<article><p title=\"5\" tall\">Hello there.</p><p class=\"x\">second</p></article>", "Hello there.\nsecond"),
    ("<article><p data-x=it's>One.</p><p>Two.</p><p>It's three.</p></article>", "One.\nTwo.\nIt's three."),
    ("<article><p>one two three four five</p><aside>" + "note " * 200 + "</aside><p>the last words</p></article>",
     "one two three four five\nthe last words"),
    ("<article><p>" + "word " * 30 + "</p>" + "<div>" * 9 + "</div>" * 9 + "<p>End.</p></article>",
     ("word " * 30).strip() + "\nEnd."),
])
def test_html_quotes_and_whole_articles(page, want):
    assert html_extract.extract(f"<html><body>{page}</body></html>", {}) == want
