"""WARC archives, page text, embeddings and the pipeline."""

import base64
import gzip
import hashlib
import io
import math

import numpy as np
import pytest

from quillstone.llm import embeddings, html, warc
from quillstone.llm.common import filesystem

PAGES = "page_id long, url string, html string, low string, payload string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, None), (5, "x", ""), (1, "http://a/2", "same"), (None, "http://b", "same"), (None, "u\r\nX: y", "alone"), (9, "z", "é" * 200_000)]
    return spark.createDataFrame([(*r, "l", "p") for r in rows], PAGES)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)


# 3: WARC


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(odd_pages, no_pages, least):
    manifest = warc.write_archives(odd_pages, least)
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()), key=str)
    rows = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    want = []
    for page, data in rows:
        twins = [p for p, d in rows if d == data and p is not None]
        first = min(twins) if len([1 for _, d in rows if d == data]) > 1 and twins and len(data) >= least else None
        revisit = first is not None and page != first
        want.append((page is None, page or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(no_pages)).count() == 0


def test_each_record_is_a_member(odd_pages):
    manifest = warc.write_archives(odd_pages).collect()
    total = 0
    for m in manifest:
        system, path = filesystem(m.path)
        data = system.open_input_file(path).read()
        text = gzip.decompress(data)
        assert text.count(b"WARC/1.1\r\n") == m.records and text.endswith(b"\r\n\r\n")
        assert [f["WARC-Type"] for f, _ in warc.read_records(io.BytesIO(data))]
        total += m.records
    assert total == odd_pages.count()


def test_broken_archives_are_refused():
    good = warc.record_bytes(1, "u", b"payload", None)
    assert [b for _, b in warc.read_records(io.BytesIO(good * 3))][0].endswith(b"payload")
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    bad = gzip.compress(gzip.decompress(good).replace(b"payload", b"Payload"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad)))


# 7: page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="post"><header>Site</header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article class="post"><header><h1>Head&nbsp;line &amp; more</h1></header><p><b>One<br>two<p>Three &#x41;&lt;b&gt;
<script>if (a<b) { "</p>" }</script><ul><li>x<li>y</ul><form>Sign up</form><aside>Aside</aside><div class="share-bar">Share</div><section id="comments"><p>Nice!</p></section></article>
<section class="comments"><article class="comment">First!</article></section><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert html.main_text(html.parse(PAGE)) == "Head line & more\n\nOne two\n\nThree A<b>\n\nx\n\ny"


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a</p><p>b", "a\n\nb"), ("<main><p>in</main><p>out", "in"), ("<div id=content><p>in</div><div>out</div>", "in\n\nout"),
        ("<p>a<!-- > --> b</p><!-- open", "a b"), ("<p>1 < 2 and <3</p>", "1 < 2 and <3"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p hidden>no</p><p>yes", "yes"), ("<article>a</article><article>b</article>", "a\n\nb"),
    ],
)
def test_small_pages(page, want):
    assert html.main_text(html.parse(page)) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class=entry><p>part one</div><div class=ad>no</div><div class=entry><p>two</div><div>out</div>", "part one\n\ntwo\n\nout"),
        ("<main><p>first</main><p>out</p><main><div class=content>second</div></main>", "first\n\nsecond"),
        ("<div class=content><div class=post>in <div class=body>once</div></div></div><td class=story>cell</td>", "in\n\nonce\n\ncell"),
        ("<main> </main><div id=content>a</div><section class=story>b</section>", "a\n\nb"),
    ],
)
def test_all_outermost_blocks(page, want):
    assert html.main_text(html.parse(page)) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>a</p><svg class="i"/><p>rest</p></article>', "a\n\nrest"), ('<article><p>a</p><svg class="i"/><p>rest</p><svg><text>no</text></svg><p>end</article>', "a\n\nrest\n\nend"),
        ('<article><p>a</p><svg class="i"><path d="x"><p>rest</p></article>', "a\n\nrest"), ("<article><p>a <object data='x/y'/>b</p><iframe src=\"q>r\" /><p>c</p></article>", "a b\n\nc"),
        ("<article><div>a<select><option>no</div><p>rest</article>", "a\n\nrest"), ("<article><div>a<object><b>no</b></div><p>rest</article>", "a\n\nrest"),
        ("<article>a<svg><svg>no</svg>no</svg> b<template><div>no</template> c</article>", "a b c"), ("<article>a<iframe src='x'>no</iframe> b<script>no", "a b"),
    ],
)
def test_unclosed_elements_do_not_swallow_the_page(page, want):
    assert html.main_text(html.parse(page)) == want


@pytest.mark.parametrize(
    "block",
    ["<section class='related-work'><p>kept</section>", "<p id='social-history'>kept</p>", "<div class='post-share-price'>kept</div>", "<p class='menu'>kept</p>", "<dialog>kept</dialog>", "<div class='banner-year review'>kept</div>", "<h2 class=nav>kept</h2>"],
)
def test_article_text_with_names_stays(block):
    assert html.main_text(html.parse(f"<nav>no</nav><article><p>a</p>{block}<p>b</article>")) == "a\n\nkept\n\nb"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<main><h1>Title</h1><p>A long text that says all there is to say</p></main><section><article>Teaser</article></section>", "Title\n\nA long text that says all there is to say"),
        ("<main><p>lead</p><article><p>The article itself</p></article></main>", "The article itself"), ("<article>only this</article><div>side</div>", "only this"),
        *((f"<article><p>Text</p><div class='{c}'>Nice!</div></article>", "Text") for c in ("user-comments", "comment-text", "comment-body", "reader-comments", "ad-300x250", "google-ad", "related-posts")),
        ("<article><p>Text</p><div id='reader-comments'>Nice!</div><p class='cookie-notice'>We use cookies</p></article>", "Text"),
        ("<article class='post comments-open'><p>Text</p></article>", "Text"), ("<div class='no-comments'><p>Text</p></div>", "Text"), ("<div class='comments-page'><h1>On comments</h1><p>Text</p></div>", "On comments\n\nText"),
        ("<article><p>They held a <span class='banner'>banner</span> high.</p></article>", "They held a banner high."),
        ("<article><p>Eat</p><table class='menu'><tr><td>Soup<td>3</table><ul class='menu'><li>Fish</ul></article>", "Eat\n\nSoup 3\n\nFish"), ("<article><p>Eat</p><ul class='menu'><li><a>Home</a></ul></article>", "Eat"),
    ],
)
def test_what_names_and_weights_decide(page, want):
    assert html.main_text(html.parse(page)) == want


def test_lines_that_repeat_in_articles_stay(spark):
    rows = [(i, "http://h/p", f"<article><h1>Own {i}</h1><p class=byline>By Jane Doe</p><p>Text {i} of its own</p><div class=note>Prices are in euro.</div><pre>x = 1</pre><div class=k><a>More</a> <a>Less</a></div><div class=s>Letter <button>Go</button></div></article>", "l", "p") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Own {i}\n\nBy Jane Doe\n\nText {i} of its own\n\nPrices are in euro.\n\nx = 1" for i in range(8)}


def test_deep_and_broken_pages():
    import time
    import tracemalloc

    began = time.perf_counter()
    deep = "<div>" * 100_000 + "deep"
    for page, want in (
        (deep, "deep"), ("<b>" * 16_000 + "</i>" * 16_000 + "x", "x"), ("<b></i>" * 150_000 + "x", "x"), ("<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "x", "x"), ("<p>x" * 3 + "<table>" * 100_000, "x\n\nx\n\nx"),
        ("<select>" * 120_000 + "x", ""), ("<svg><p>" * 100_000 + "x", "x"), ("<a '" * 250_000, "<a '" * 250_000),
    ):
        root = html.parse(page)
        assert len(html.styles(root)) and html.main_text(root) == want, page[:20]
        del root
    assert time.perf_counter() - began < 60
    tracemalloc.start()
    html.styles(html.parse(deep[: 5 * 15_000]))
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def slow_trees(pages):
    """(host, node) to (content, presentation, importance): the merged trees with plain strings, a page after the other."""
    from collections import defaultdict

    seen = defaultdict(lambda: defaultdict(list))
    words = lambda says: sum(len(s.split()) if isinstance(s, str) else words(s) for s in says)
    for url, text in pages:
        host = (url or "").split("://")[-1].split("/")[0].lower() if "://" in (url or "") else ""
        nodes = defaultdict(lambda: ([], [], []))

        def walk(node, nodes=nodes):
            looks = " ".join(c.name for c in node.children if not isinstance(c, str))
            own = [w for c in node.children if isinstance(c, str) for w in c.split()]
            says = tuple(" ".join(c.split()) if isinstance(c, str) else walk(c) for c in node.children if not isinstance(c, str) or c.split())
            for part, x in zip(nodes[node.at], (looks, says, own), strict=True):
                part.append(x)
            return says

        whole = walk(html.parse(text or ""))
        for at, (looks, says, own) in nodes.items():
            seen[host][at].append((whole, (tuple(looks), tuple(sorted(map(repr, says))), tuple(w for o in own for w in o)), sum(words(x) for x in says)))
    out = {}
    for host, nodes in seen.items():
        raw = {}
        for at, rows in nodes.items():

            def entropy(k, rows=rows):
                pages, some = defaultdict(list), [r for r in rows if k < 2 or r[1][2]]
                for whole, what, _ in some:
                    pages[what[k]].append(whole)
                n = [len(set(w)) for w in pages.values()]
                return (-sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(sum(n)) if sum(n) > 1 else 0.0), sum(n)

            looks, n = entropy(0)
            if n >= html.LEAST_PAGES:
                once = {r[0]: r for r in rows}.values()  # a page once
                raw[at] = (entropy(1)[0], looks, entropy(1)[0] * sum(r[2] for r in once) / n, entropy(2)[0] * sum(len(r[1][2]) for r in once) / n)
        heaviest = max((x[3] for x in raw.values()), default=0)
        for at, (content, looks, mass, _) in raw.items():
            out[host, at] = (content, looks, content * max(looks, min(1, mass / heaviest) if heaviest > 0 else 1))
    return out


def test_site_trees_equal_slow_ones(spark, small):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.url, r.html) for r in pages.collect()]
    want = slow_trees(rows)
    got = {(r.host, r.node % (1 << 64)): r for r in html.site_trees(pages).collect()}
    assert set(got) == set(want) and len(want) > 50
    for k, (content, presentation, importance) in want.items():
        r = got[k]
        assert (r.content, r.presentation, r.importance) == pytest.approx((content, presentation, importance), abs=1e-9)
        assert bool(r.flags & html.REPEATS) == (r.content < html.LOW) and bool(r.flags & html.UNIMPORTANT) == (r.importance < html.LOW) and bool(r.flags & html.VARIES) == (r.presentation >= html.HIGH)


def test_importance_of_a_small_site(spark):
    """Worked by hand: ten pages with a menu that never changes, an advert that does, and texts of 40 words."""
    rows = [(i, "http://h/p", f"<div class=m>Home News About</div><div class=x>Buy thing {i} now</div><div class=t><p>{' '.join(f't{i}x{j}' for j in range(40))}" + "<p>more" * (i % 5), "l", "p") for i in range(10)]
    rows += [rows[0]] * 7  # copies of a page count once
    found = {r.node % (1 << 64): r for r in html.site_trees(spark.createDataFrame(rows, PAGES)).collect()}
    top = html.parse("<div class=m></div><div class=x></div><div class=t></div>").children
    menu, advert, text = (found[c.at] for c in top)
    assert (menu.content, menu.presentation, menu.importance) == pytest.approx((0, 0, 0), abs=1e-9)
    assert advert.content == pytest.approx(1) and advert.presentation == 0 and advert.importance == pytest.approx(4 / 42, abs=1e-9)  # 40 words and two "more" on average
    assert text.presentation == pytest.approx(math.log(5) / math.log(10)) and text.importance == pytest.approx(1)
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[7] == " ".join(f"t7x{j}" for j in range(40)) + "\n\nmore\n\nmore"


def test_names_yield_to_the_heaviest_text(spark):
    """On judged hosts, too, a named block goes however it changes, but not one that holds what the host is about."""
    side = lambda i: "<div class='sidebar left'>" + "".join(f"<p>teaser {i} {j}" for j in range(i % 7)) + "</div>"
    rows = [(i, "http://a/p", f"<div class=w><div class=t><p>{' '.join(f't{i}x{j}' for j in range(40 + i))}</div>{side(i)}</div>", "l", "p") for i in range(12)]
    rows += [(100 + i, "http://b/p", f"<article><h1>Dishes {i}</h1><div class=menu><p>{' '.join(f'd{i}x{j}' for j in range(40 + i))}</div>{side(i)}<div id=related-items>More {i}</div></article>", "l", "p") for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == " ".join(f"t{i}x{j}" for j in range(40 + i)) for i in range(12))
    assert all(got[100 + i] == f"Dishes {i}\n\n" + " ".join(f"d{i}x{j}" for j in range(40 + i)) for i in range(12))


def test_the_tree_finds_the_article_without_marks(spark):
    """sf0.1's pages with no article element and no class that says advert: on hosts with enough pages the tree takes off
    the adverts, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: r.text for r in html.extract(pages).collect()}
    bare = pages.selectExpr("page_id", "url", """replace(replace(replace(html, '<article>', '<div class="z">'), '</article>', '</div>'), 'class="ad"', 'class="y"') AS html""")
    got = {r.page_id: r.text for r in html.extract(bare).collect()}
    without = {r.page_id: html.main_text(html.parse(r.html)) for r in bare.collect()}
    hosts = {r.page_id: r.host for r in pages.select("page_id", html.host_of(pages.url).alias("host")).collect()}
    sizes = {}
    for h in hosts.values():
        sizes[h] = sizes.get(h, 0) + 1
    large = [i for i, h in hosts.items() if sizes[h] >= 20]
    right = [i for i in large if got[i] == want[i]]
    assert len(large) > 1000 and len(right) >= 0.95 * len(large)
    assert sum(got[i] != without[i] for i in right) > 1000


def test_site_tree_removes_what_repeats(spark, no_pages):
    rows = [(i, "http://h.example/p", f"<div><div class=x>All rights reserved by us</div><div class=y><p>Own text {i}</p></div></div>", "l", "p") for i in range(8)]
    rows += [(100, "http://other/p", rows[0][2], "l", "p"), (101, None, None, "l", "p")]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "Own text 3" and got[100] == "All rights reserved by us\n\nOwn text 0" and got[101] == ""
    old, html.BROADCAST_NODES = html.BROADCAST_NODES, -1
    try:
        assert {r.page_id: r.text for r in html.extract(pages).collect()} == got
    finally:
        html.BROADCAST_NODES = old
    assert html.extract(no_pages).count() == 0


def test_site_tree_removes_what_repeats_in_articles(spark):
    box = "<div class=x12><p>Get our letter every week</p></div>"
    rows = [(i, "http://h.example/p", f"<article><h1>Title {i}</h1><p>Own <em>very</em> text {i}</p>{box}<h2>Sources</h2><ul><li>Book {i}</ul></article>", "l", "p") for i in range(8)]
    rows += [(50 + i, "http://same/p", f"<article><p>One text</p>{box}</article><p>{i}", "l", "p") for i in range(8)]
    rows += [(100, "http://other/p", rows[0][2], "l", "p")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Title 3\n\nOwn very text 3\n\nSources\n\nBook 3"
    assert got[55] == "One text\n\nGet our letter every week"  # the whole article repeats
    assert got[100] == "Title 0\n\nOwn very text 0\n\nGet our letter every week\n\nSources\n\nBook 0"


def test_pages_of_the_table(spark, small):
    import html as markup
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(markup.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


# 8: embeddings

VECTORS = "vec_id long, embedding array<float>, label int, node string, n string"


def brute(rows, threshold=0.98):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    n, linked = len(rows), []
    for i in range(n):
        for j in range(i):
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if p is not None and p == q and ok(x) and ok(y) and len(x) == len(y) and cos(np.array(x, float), np.array(y, float)) >= threshold:
                linked.append((i, j))
    comp = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in range(n):
        for i, j in linked:
            a, b = rows[i][0], rows[j][0]
            if a is not None and b is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    links = [0] * n
    for i, j in linked:
        links[i] += 1
        links[j] += 1
    return sorted((r[0] is None, r[0] or 0, links[i], comp.get(r[0])) for i, r in enumerate(rows))


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0]
    rows = [(1, v, 1), (2, v, 1), (3, w, 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [1.0, None, 3.0, 4.0], 1), (9, [1.0, float("nan"), 3.0, 4.0], 1), (10, [float("inf"), 2.0, 3.0, 4.0], 1), (11, v, 2), (11, v, 2), (12, [1.0, 2.0, 3.0], 1), (13, [], 1), (14, [-x for x in v], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got.collect()) == brute(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_hot_bucket_is_dealt(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * s).astype(np.float32).tolist(), 1) for i, s in enumerate([0.05] * 120 + [0.12] * 60 + [2.0] * 60)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    want = brute(rows)
    # one group; blocks of candidates; a component by its buckets or by pairs of blocks
    for most, block in ((4096, 16384), (4096, 16), (8, 1024), (8, 16)):
        got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame, recall=0.9999, most=most, block=block).collect())
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(want) and sum(r[2] for r in got) >= 0.995 * sum(r[2] for r in want)
        assert sum(r[2] for r in got) <= sum(r[2] for r in want)


def test_recall_against_all_pairs(spark):
    """sf0.1's vectors and near copies of some, in chains and one large cluster: only links are found, 0.99 of them."""
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    m, label = np.stack(pdf.embedding).astype(float), pdf.label.to_numpy()
    rng = np.random.default_rng(6)
    of = np.r_[rng.integers(0, len(m), 1500), np.full(300, 5)]
    m = np.r_[m, m[of] + rng.standard_normal((len(of), m.shape[1])) * rng.uniform(0.005, 0.04, (len(of), 1))].astype(np.float32)
    label = np.r_[label, label[of]]
    unit = m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    frame = spark.createDataFrame([(i, x.tolist(), int(k), "x", "y") for i, (x, k) in enumerate(zip(m, label, strict=True))], VECTORS)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    n = np.array([got[i].n_links for i in range(len(m))])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum() > 10_000
    assert all(got[i].component_id <= i for i in got) and all(got[got[i].component_id].component_id == got[i].component_id for i in got)


def test_verify_counts_and_connects():
    rng = np.random.default_rng(8)
    m = embeddings.unit(np.repeat(rng.standard_normal((30, 8)), 12, axis=0) + rng.standard_normal((360, 8)) * 0.05)
    weight = rng.integers(1, 4, 360)
    near = m @ m.T >= 0.98
    np.fill_diagonal(near, False)

    def connected(links):
        label = np.arange(360)
        for _ in range(360):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label.tolist()

    tile, embeddings.TILE = embeddings.TILE, 1000
    try:
        counts, links = embeddings.verify(m, weight, None, None, 0, 0.98)
        side = rng.integers(0, 2, 360)
        across, _ = embeddings.verify(m, weight, side, None, 0, 0.98)
        signs = rng.integers(0, 2, (360, 2))
        later, _ = embeddings.verify(m, weight, None, signs, 1, 0.98)
    finally:
        embeddings.TILE = tile
    assert counts.tolist() == (near @ weight).tolist() and len(links) < 360
    assert connected(links) == connected(np.argwhere(near).tolist())
    assert across.tolist() == ((near & (side[:, None] != side[None, :])) @ weight).tolist()
    assert later.tolist() == ((near & (signs[:, None, 0] != signs[None, :, 0])) @ weight).tolist()


def test_recall_follows_the_number():
    for n in (100, 10**5, 10**9):
        planes, tables = embeddings.shape_of(n)
        assert 1 - (1 - (1 - math.acos(0.98) / math.pi) ** planes) ** tables >= 0.99


# the pipeline


def test_pipeline_equals_brute_force(spark, small):
    import re
    import zlib

    import corpus_pipeline
    from quillstone.llm import mixing, quality, simhash, tokens

    from .test_documents import brute_hits, slow_components

    docs = spark.read.parquet(f"{small}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        outs.append(sorted(r.doc_id for r in stage(spark, before, small).collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            out = stage(spark, before, small)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]

    # the classifier, one text after the other
    of = quality.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).scorer()
    rows = [r for r in rows if of(r[1].encode()) >= 0.5]
    assert sorted(r[0] for r in rows) == outs[0]

    # near-duplicates, all pairs: sets of five-word shingles alike by 0.8
    def grams(text):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(r[0], grams(r[1])) for r in rows]
    first = slow_components(sets, lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y) > 0)
    rows = [r for r, c in zip(rows, first, strict=True) if r[0] == c]
    assert sorted(r[0] for r in rows) == outs[1]

    # benchmark passages
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute_hits(r[1], bench)[1]]
    assert sorted(r[0] for r in rows) == outs[2]

    # mixing
    def topic(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hits = [sum(w in own for w in words) for own in mixing.TOPICS.values()]
        return list(mixing.TOPICS)[hits.index(max(hits))] if max(hits) >= 2 and max(hits) * 200 >= len(words) else "general"

    def cell(r):
        return tuple(v if v in mixing.WEIGHTS[k] else "other" for k, v in (("source", r[3]), ("lang", r[2]), ("topic", topic(r[1]))))

    weight = {}
    for r in rows:
        weight[cell(r)] = weight.get(cell(r), 0.0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    p = mixing.rake(weight, mixing.targets_of(weight, mixing.WEIGHTS))
    rows = [r for r in rows if int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) / 2**32 < p[cell(r)]]
    assert sorted(r[0] for r in rows) == outs[3] == outs[4]

    # token output of the whole run
    encoder, start, want = tokens.Encoder(tokens.tokenizer_path()), 0, []
    for r in sorted(rows):
        ids = encoder._ids([r[1]])[0] + bytes(4)
        want.append((r[0], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    rows = [(i, q, 0) for i, q in ((1, 1), (2, 1), (3, 0), (3, 1), (5, 0), (None, 1), (7, None), (99, 1))]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 31))), (None, None), (2, ""), (3, "never")], "item_id long, text string")
    for name, docs, own_labels, own_bench in (("odd", odd_docs, labels, bench), ("none", no_docs, labels.limit(0), bench.limit(0))):
        at = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", own_labels), ("benchmark", own_bench)):
            df.write.parquet(f"{at}/{table}.parquet")
        kept = spark.read.parquet(f"{at}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, spark.createDataFrame((out := run(spark, kept, at)).collect(), docs.schema)
            assert out.columns == docs.columns and not {tuple(r) for r in kept.collect()} - {tuple(r) for r in before.collect()}, stage
        got = corpus_pipeline.run(spark, at).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
        assert sum(r.n_tokens for r in got) == max((r.start + r.n_tokens for r in got), default=0)
        ids = [r.doc_id for r in got]
        if docs is no_docs:
            assert not got
        else:
            assert 2 not in ids and 9 not in ids  # copies
            assert not {1, 3} & set(ids)  # they hold a benchmark's words
