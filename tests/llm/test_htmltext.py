import math
import time
from itertools import product

import pytest

from tidewatch.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href=b>B</a></li></ul></nav><!-- ad -->
<div class="ad">Buy this thing now, it is good.</div><article><h1>The &amp; title</h1><p><b>First   part&nbsp;of it.<br><p>Second, with <a href=x>a link</a> &lt;here&gt;.</p><ul><li>One<li>Two</ul></article>
<section id="comments"><h3>Comments</h3><p>I liked this text a lot, thanks for it.</p></section><form><p>Your name</p></form><footer>&copy; all of us.</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    m = h.Model()
    for x in h.examples():
        m.learn(h.parse(x, labelled=True), 3.0)
    return m.ready()


def test_main_text(model):
    assert h.main_text(PAGE, model) == "The & title\nFirst part of it.\nSecond, with a link <here>.\nOne\nTwo"


def test_marginals_equal_summing_over_all_labellings(model):
    nodes = h.parse("<body><nav><a href=x>Home</a></nav><article><p>Some text, rather short.</p><div class=ad>Buy</div></article></body>")
    odds = [math.exp(sum(model.unary.get(f, 0.0) for f in h.facts(x))) if i else 1.0 for i, x in enumerate(nodes)]
    total, one = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        p = 0.05 if y[0] else 1.0
        for i, x in enumerate(nodes):
            p *= odds[i] if y[i] and i else 1.0
            if x.parent:
                p *= model.move[h.pair(x)][2 * y[nodes.index(x.parent)] + y[i]]
        total += p
        for i in range(len(nodes)):
            one[i] += p * y[i]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), one))


def judged(page, model):
    """(blocks judged right, blocks) of a page labelled by data-y."""
    nodes = h.parse(page, labelled=True)
    want, blocks = {}, []
    for x in nodes:
        want[id(x)] = x.label if x.label is not None else want[id(x.parent)] if x.parent else 0
    for x, p in zip(nodes, model.marginals(nodes)):
        if x.tag == "#":
            blocks.append(((p >= 0.5) == bool(want[id(x)]), bool(want[id(x)]), x.text))
    return sum(b[0] for b in blocks), len(blocks)


def test_held_out_layouts(model):
    """Labelled pages of another seed: blocks judged right."""
    right = n = 0
    for page in list(h.examples(99))[::5]:
        good, all_ = judged(page, model)
        right, n = right + good, n + all_
    assert right / n > 0.97


def test_odd_pages(spark):
    pages = [(1, "u", PAGE, "a"), (2, None, None, "a"), (3, "u", "", "a"), (None, "u", "<div><p>unclosed <b>text", "a"), (1, "u", PAGE, "a"), (5, "u", "<a" + " x" * 50_000, "a"), (6, "u", "<div>" * 2000 + "deep", "a"), (7, "u", "<article>" + "<p>A long page has many parts, all of them read.</p>" * 20_000 + "</article>", "a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = h.extract(df, h.fit(df)).collect()
    assert len(got) == len(pages) and got[0]["text"] == got[4]["text"] and got[0]["text"].startswith("The & title")
    assert got[1]["text"] == got[2]["text"] == "" and got[7]["text"].count("\n") == 19_999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract(df.limit(0), h.fit(df.limit(0))).count() == 0


LOREM = "The river rose in the night and the people of the lower town moved what they had to the upper floors. By noon the square was under water, and boats went from door to door with bread. Nobody could say how long it would last."
LONG = f"<p>{LOREM}</p><p>{LOREM[40:]} {LOREM}</p>"
#: Page layouts of their own, written by hand and never fitted on; data-y only says what is right.
LAYOUTS = {
    "blog of the look-class kind": f'<body class="flex dark"><div class="px-4 flex"><a href="/">Home</a> <a href="/b">Archive</a> <a href="/c">About us</a></div><div class="container mx-auto"><div class="col-8" data-y=1><h1>High water</h1>{LONG}<h2>What came after</h2><ul><li>Cellars were dried for weeks.</li><li>The bridge stayed shut.</li></ul>{LONG}</div><div class="sidebar col-4"><h4>Popular</h4><ul><li><a href=1>Ten boats</a></li><li><a href=2>Old mills</a></li></ul></div></div><div class="site-footer py-2">Copyright the town paper</div></body>',
    "news with comments": f'<body><header id="masthead"><nav class="main-nav"><ul><li><a href=/>News</a></li><li><a href=/s>Sport</a></li></ul></nav></header><main><div class="story" data-y=1><h1>High water</h1><p class="lead">The town was cut off for a day.</p>{LONG}<blockquote><p>We have seen worse, said the mayor.</p></blockquote><div class="share-buttons" data-y=0><a href=x>Share this</a> <a href=y>Send it</a></div>{LONG}</div><section class="comments-area"><h2>3 comments</h2><ol class="commentlist"><li class="comment"><p>I lived there as a child, and it was the same every spring.</p></li><li class="comment"><p>Thanks for writing this, it helped me.</p></li></ol></section></main><footer><p>All rights reserved.</p></footer></body>',
    "manual in a table": f'<body><table><tr><td class="menu"><a href=1>Start</a><br><a href=2>Install</a><br><a href=3>Use</a></td><td><div id="content" data-y=1><h1>Use</h1>{LONG}<pre>run --fast now</pre><table><tr><td>fast</td><td>Skips all checks.</td></tr></table><p>{LOREM}</p></div></td></tr></table></body>',
    "section tags": f'<body><nav><a href=/>Up</a></nav><section class="hentry" data-y=1><header><h1>High water</h1></header>{LONG}<figure><figcaption>The square at noon.</figcaption></figure>{LONG}</section><aside class="related-posts"><h3>Related</h3><p>Also read our long piece on the old mills.</p></aside><form class="newsletter"><p>Get our letter each week.</p></form></body>',
    "bare paragraphs": f"<html><body><h1>High water</h1>{LONG}{LONG}</body></html>".replace("<body>", "<body data-y=1>"),
    "consent and adverts": f'<body><div id="cookie-consent" role="dialog"><p>We use small files to know you again. Do you agree to this use?</p></div><div class="ad-banner">Buy boats now. They float.</div><article data-y=1><h1>High water</h1>{LONG}<div class="advert" data-y=0><p>Rain coats at half the price, this week only.</p></div>{LONG}</article><div class="pagination"><a href=1>1</a> <a href=2>2</a></div></body>',
}


def test_layouts_that_were_not_fitted(model):
    got = {name: judged(page, model) for name, page in LAYOUTS.items()}
    right, n = (sum(x[i] for x in got.values()) for i in (0, 1))
    print("held-out block accuracy", right / n, got)
    assert right / n >= 0.95
    assert all(g / k >= 0.8 for g, k in got.values())


def test_hostile_markup_takes_linear_time(model):
    n = 100_000
    for page in ("<a" * n, '<a "' * n + ">", "<svg>" * n, "<svg>" + "</svg" * n, "<!--" * n, "<" * n + ">", "<div>" * 10_000 + "x" + "</p>" * 10_000, "<tr><table>" + "<div>" * 5000 + "<tr></tr>" * 5000, "<dt>" + "<div>" * 5000 + "<dd>" * 5000, "<b>" * n + "</i>" * n, "<div class" + " " * n + "x>", "<a " + "=" * n + ">", "<p>&#" + "9" * n + ";</p>"):
        began = time.process_time()
        h.parse(page)
        assert time.process_time() - began < 1.5, page[:20]


def test_depth_attributes_and_many_names(model):
    deep = h.parse("<div>" * 10_000 + "<p>deep</p>" + "</div>" * 9_999 + "<p>back</p></div><p>out</p>")
    leaf = {x.text: x for x in deep if x.tag == "#"}
    depth = lambda x: 0 if x.parent is None else 1 + depth_of(x.parent)

    def depth_of(x):
        k = 0
        while x.parent:
            x, k = x.parent, k + 1
        return k

    assert [depth(leaf[t]) for t in ("deep", "back", "out")] == [10_002, 3, 2]
    assert all(0 <= p <= 1 for p in model.marginals(deep))
    (node,) = (x for x in h.parse('<div data-id="nav menu" data-class="x" title="class=ad" CLASS = "one-two" id=\'three\' data-y="12.5">x</div>') if x.tag == "div")
    assert node.names == ("one", "two", "three") and node.label is None
    many = "<article><div class=\"" + " ".join([*h.WITHIN, *h.AROUND] * 500) + "\"><p>Some text.</p></div></article>"
    assert all(0 <= p <= 1 for p in model.marginals(h.parse(many)))
    assert "Kept text here." in h.main_text(f'<article><h1>T</h1>{LONG}<div data-id="nav menu"><p>Kept text here.</p></div></article>', model)
