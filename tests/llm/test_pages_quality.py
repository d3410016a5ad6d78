import base64
import hashlib
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pytest

from ridgework.llm import common, html_extract, quality, warc

from .edge import documents


def article(html):
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    return "\n\n".join(t for p in parts if (t := " ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split())))


def test_main_text_of_all_pages(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == want


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div role=navigation><a href=/>Home</a></div>
<main><h1>Title &amp; more</h1><p class="lead">First&nbsp;para <b>bold</b>ly.<br>next</p><p>Unclosed one<p>two <a href="x>y">link</a>
<div class="cookie-notice"><p>We use cookies<p>ok</div><ul><li>point one<li>point two</ul><form><label>Mail</label><input></form>
<script>if (a < b) { "</p>" }</script><aside>Side</aside><section id="comments"><p>Great the article of the year, it is what I was looking for and more than that.</p></section><p>last &lt;b&gt;</main><footer>foot</footer>"""


def test_hard_page():
    assert html_extract.main_text(PAGE).split("\n\n") == ["Title & more", "First para boldly. next", "Unclosed one", "two link", "point one", "point two", "last <b>"]


def test_page_without_article():
    good = "This is the text of a page that has no article element and it goes on for a while so that the rules can tell it from the rest of the page, which is what they are for, as you will see in the end of it."
    html = f"<body><div><a href=/>Home</a> <a href=/b>About us</a></div><h2>Heading</h2><div>{good}</div><div>Short one.</div><div>{good}</div><div><a href=x>Next</a></div><div>(c) all</div>"
    assert html_extract.main_text(html).split("\n\n") == ["Heading", good, "Short one.", good]


PROSE = "It was in the spring of that year that the people of the valley first saw what the river could do to them, and they have not been the same since then, as all of them will tell you when you ask for it. "
CHINESE = "那一年的春天,山谷里的人们第一次看到这条河能对他们做什么。从那以后,他们再也不是从前的样子了,只要你去问,每个人都会告诉你。河水漫过了田地,也漫过了房屋,直到夏天才慢慢退去。村里的老人说,这样的水他们只在年轻的时候见过一次,那时候桥还没有修好。"


@pytest.mark.parametrize("name", ["content has-sidebar", "layout-no-sidebar", "post with-banner", "topic-social", "article-body promoted", "entry nofooter"])
def test_names_that_only_mention_a_place(name):
    html = f'<body><div class="site-nav"><a href=/>Home</a></div><div class="{name}"><h1>The river</h1><p>{PROSE}<p>{PROSE}</div><div class="sidebar"><p>{PROSE}</div><div id="page-footer">{PROSE}</div>'
    assert html_extract.main_text(html).split("\n\n") == ["The river", PROSE.strip(), PROSE.strip()]


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "site-footer", "main-nav", "ad_banner", "comment-list", "related-posts", "social share", "nav2", "widget widget-text"])
def test_names_of_places(name):
    html = f'<body><div><p>{PROSE}</div><div class="{name}"><p>Elsewhere. {PROSE}</div><div><p>{PROSE}</div>'
    assert html_extract.main_text(html).split("\n\n") == [PROSE.strip()] * 2


def test_a_teaser_in_an_article_is_not_the_page():
    html = f"<body><div><h1>The river</h1><p>{PROSE * 2}<p>{PROSE}</div><article><h2>Read this</h2><p>A teaser of something else.</article>"
    text = html_extract.main_text(html)
    assert PROSE.strip() in text and (PROSE * 2).strip() in text and "The river" in text


def test_a_long_paragraph_with_a_copyright_sign_stays():
    long = f"{PROSE}The map © of the survey was made for it. {PROSE}"
    assert html_extract.main_text(f"<body><p>{PROSE}<p>{long}<p>{PROSE}<p>© 2020 The Valley").split("\n\n") == [PROSE.strip(), long.strip(), PROSE.strip()]


def test_prose_without_spaces():
    html = f"<body><ul><li><a href=/>首页</a><li><a href=/a>关于</a></ul><div><p>{CHINESE}</p><p>{CHINESE}</p></div><div><a href=/x>{CHINESE[:40]}</a></div>"
    assert html_extract.main_text(html).split("\n\n") == [CHINESE, CHINESE]


def slow_second_pass(found):
    """The second pass with a walk to either side for each undecided block."""
    if any(b.article and not b.away for b in found):
        good = {True: 0, False: 0}
        for b in found:
            good[b.article] += len(b.text) * (html_extract.first_pass(b._replace(article=False)) == "good")
        found = [b if b.article else b._replace(away=True) for b in found] if good[True] >= good[False] else [b._replace(article=False) for b in found]
    labels = [html_extract.first_pass(b) for b in found]
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    out = []
    for i, b in enumerate(found):
        if labels[i] in ("good", "bad"):
            out.append(labels[i] == "good")
            continue
        around = []
        for way in (range(i - 1, -1, -1), range(i + 1, len(found))):
            at = next((j for j in way if labels[j] in ("good", "bad") and not (b.article and found[j].away)), None)
            around.append(labels[at] if at is not None and found[at].article == b.article else None)
        before, after = around
        if b.article:
            out.append("good" in around or None in around or b.tag != "li")
        elif labels[i] == "near":
            out.append("good" in around or set(around) == {None})
        else:
            out.append(set(around) <= {"good"} or b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and after == "good")
    return out


def test_second_pass_equals_walks():
    rng = np.random.default_rng(11)
    texts = [PROSE * 2, PROSE, "Short.", "Some words of it that are here for the sake of it and more of them in a row", "keyword list price sale buy now order cheap shipping deals best offer today"]
    for _ in range(300):
        found = [html_extract.Block(t := texts[rng.integers(5)], int(len(t) * rng.choice([0, 0, 0.5, 1])), str(rng.choice(["p", "li", "h2", "div"])), bool(rng.random() < 0.15), bool(rng.random() < 0.5)) for _ in range(rng.integers(0, 14))]
        assert html_extract.second_pass(found) == slow_second_pass(found)


def test_odd_html(spark):
    odd = {
        "": "", "<": "", "<p": "", "&am": "", "<!-- x": "", "<script>": "", "<" * 50_000: "", "<a title=\"" * 20_000: "", "<article><p>&lt;b&gt; &amp; &#65;&#x42; &nbsp;x</p>": "<b> & AB x", "<article>a\n\t b<p>c": "a b\n\nc",
        "<article><p>one<script>two</script>three</article>": "onethree", "<article>a<br>b<br/>c</article>": "a b c", "</p></div>x": "", "<article hidden>hi": "hi",
    }
    # a few words without an article or prose beside them are no text
    assert {h: html_extract.main_text(h) for h in odd} == odd
    rows = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<article>hi</article>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_extract.extract(rows).collect()) == ["", "", "hi"]
    assert html_extract.extract(rows.limit(0)).collect() == []


def check_warc(spark, pages, least=0):
    out = common.fresh_path(spark, "t")
    m = warc.write_archives(pages, out, least)
    got = sorted(map(tuple, warc.read_archives(spark, out, m).collect()), key=str)
    first, rows = defaultdict(list), pages.collect()
    for r in rows:
        first[r["html"] or ""].append(r["page_id"])
    want = []
    for r in rows:
        raw = (r["html"] or "").encode()
        ids = [i for i in first[r["html"] or ""] if i is not None]
        low = min(ids, default=None)
        again = low is not None and r["page_id"] != low and len(raw) >= least
        want.append((r["page_id"], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low if again else None))
    assert got == sorted(want, key=str)


def test_warc(spark, sf):
    pages = common.table(spark, sf, "pages")
    check_warc(spark, pages)
    twice = pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html"))
    check_warc(spark, common.materialize(twice, "t"))


def test_warc_edge_rows(spark):
    rows = [(3, "http://a b\n", "x", 1), (1, None, "x", 1), (1, None, "x", 1), (None, "u", "x", 1), (5, "u", None, 1), (4, "u", "", 1), (None, None, "ä" * 300_000, 1), (6, "u", "y\r\n\r\nz", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    check_warc(spark, pages)
    check_warc(spark, pages, 1)
    warc.BROADCAST_DIGESTS, kept = 0, warc.BROADCAST_DIGESTS
    check_warc(spark, pages)
    warc.BROADCAST_DIGESTS = kept
    assert warc.write_archives(pages.limit(0), common.fresh_path(spark, "t")).collect() == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op7_quality_scores(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    assert len(rows) == common.table(spark, sf, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.96


def test_quality_edge_rows(spark, sf):
    labels = common.table(spark, sf, "labels")
    assert len(quality.score_documents(documents(spark), labels).collect()) == documents(spark).count()
    assert {r["score"] for r in quality.score_documents(documents(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(documents(spark).limit(0), labels).collect() == []


def test_statistics_read_every_word_of_long_texts():
    at = quality.STATS.index("upper_words")
    for n in (10, 399, 400, 801, 20_000):
        words = ["word", "SHOUT"] * (n // 2) + ["word"] * (n % 2)
        assert quality.statistics(" ".join(words))[at] == pytest.approx(n // 2 / n)


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 0.5, 0.2, 0.9, 0.8]), np.ones(5))
    assert list(np.diff(y) >= 0) == [True] * (len(y) - 1)
    assert y == pytest.approx([0, 0.35, 0.85])


def test_long_pages_and_unclosed_elements():
    """Work grows with the length of a page; unclosed elements end with what they stand in, raw ones with the page."""
    import time

    began = time.time()
    html_extract.main_text("<table>" + "<tr><td>ab cd</td></tr>" * 100_000 + "</table>")
    html_extract.main_text("<p>x" + "<span>" * 30_000 + "</i>" * 30_000 + "<p>y" * 30_000)
    assert time.time() - began < 30
    story = "This is the story of a town and the people who lived in it, and of all that they had done when the river rose over the fields. " * 3
    for name in ("object", "select", "svg", "math", "template"):
        assert html_extract.main_text(f"<body><div><{name}>gone</div><p>{story}</p></body>") == story.strip()
    assert html_extract.main_text(f"<body><svg><svg></svg><text>gone</text></svg><p>{story}</p></body>") == story.strip()
    for name in ("script", "style", "iframe", "textarea"):
        assert html_extract.main_text(f"<body><p>{story}</p><{name}>gone <p>{story}</p></body>") == story.strip()


def test_marked_page_without_article():
    """Blocks of a page by hand: what is text, and what takes its label from its neighbours."""
    story = "It was in the year of the flood that the people of the town had to leave their homes, and they did so with the little that they could carry on their backs. " * 2
    parts = [("a", "Home"), ("h2", "The flood"), ("p", story), ("p", "So it was."), ("p", story), ("p", '<a href="x">Read more of this and of all the other news</a>'), ("p", "Short tail")]
    page = "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts) + "</body>"
    assert html_extract.main_text(page).split("\n\n") == ["The flood", story.strip(), "So it was.", story.strip()]


def test_many_revisits_are_read_in_one_pass():
    import time
    import zlib

    z = zlib.compressobj(1, wbits=31)
    one = z.compress(warc.record("revisit", 1, "http://x", "A" * 32, 10, 2, b"")) + z.flush()
    began = time.time()
    assert sum(1 for _ in warc.records(one * 100_000)) == 100_000
    assert time.time() - began < 30
    z = zlib.compressobj(1, wbits=31)
    payload = bytes(range(256)) * 4000
    large = z.compress(warc.record("response", 1, "http://x", "A" * 32, len(payload), None, payload)) + z.flush()
    assert [p for _, p in warc.records(one + large + one)] == [b"", payload, b""]
    with pytest.raises(ValueError):
        list(warc.records(large[:-9]))


def test_weights_and_calibration_by_plain_algebra(spark, sf):
    """The distributed fit gives the weights of the normal equations over all rows of the training folds, and monotone values."""
    import numpy as np

    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.fit(quality.document_stats(docs), labels, n_features=16)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], quality.statistics(r["text"] or "")) for r in docs.collect() if r["doc_id"] in y]
    import zlib

    fold = {d: zlib.crc32(str(d).encode()) % 4 for d, _ in rows}
    x = np.array([s for d, s in rows if fold[d] != 2], np.float32).astype(float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    train = [(d, s) for d, s in rows if fold[d] not in (2, 3)]
    z = model.features(np.array([s for _, s in train], np.float32).astype(float))
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) / z.shape[1] * np.eye(z.shape[1]), z.T @ np.array([y[d] for d, _ in train], float))
    assert np.allclose(model.weights, want, atol=1e-6)
    assert (np.diff(model.values) >= 0).all()
    for d, s in rows[:50]:
        assert 0 <= model.score(np.array([s]))[0] <= 1
