import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from tidewell.llm import html_text as h

from . import fixtures


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        (None, ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a\n  b&nbsp;c</p><p>d<br>e", "a b c\n\nd e"),
        ("<html><head><title>t</title><script>var a = '<p>no</p>';</script><style>p{}</style></head><body><nav><ul><li>x</li></ul></nav><article><h1>T</h1><p>one<p><b>two</article><footer>f</footer>", "T\n\none\n\ntwo"),
        ("<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>text</p><aside>no</aside><form><p>no</p></form></main><div class='sidebar'>no</div></body>", "text"),
        ("<article><header><h1>Title</h1></header><p>text</p></article>", "Title\n\ntext"),
        ("<article><p>text</p><section class='comments'><h2>Comments</h2><p>first!</p></section></article>", "text"),
        ("<article><p>long main text here</p></article><article class='comment'><p>a comment that is much longer than the main text</p></article>", "long main text here"),
        ("<article><h2>A</h2><p>one</p></article><article><h2>B</h2><p>two much longer text</p></article>", "A\n\none\n\nB\n\ntwo much longer text"),
        ("<div id='cookie-notice'>We use cookies</div><div class='main-content with-sidebar'><p>body text</p></div>", "body text"),
        ("<div class=ad>buy</div><div role=\"complementary\">x</div><p hidden>x</p><p style='display: none'>x</p><p>y</p>", "y"),
        ("<!-- <p>x</p> --><p>1 < 2 &lt;b&gt; &#233; &eacute;</p>", "1 < 2 <b> é é"),
        ("<p>a<span>b</span> <i>c</i></p><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "ab c\n\nx\n\ny\n\n1 2\n\n3"),
        ("<p title=\"a > b\">q</p><p title='x>q</p>", "q\n\nq"),
        ("<script>unclosed <p>x</p>", ""),
        ("<p>x</p><!-- unclosed <p>y</p>", "x"),
    ],
)
def test_main_text(html, text):
    assert h.read(html or "") == text


def test_long_and_odd_pages_end():
    h.read("<" * 50_000)
    h.read("<p " + "a" * 100_000)
    h.read("<p a=\"" * 3_000)
    assert len(h.read("<div>" * 30_000 + "x")) == 1
    assert len(h.read("<div>" * 30_000 + "</p>" * 30_000 + "x")) == 1
    h.read("<a " * 30_000)
    h.read("<li>" * 30_000 + "<!--" * 1000)
    assert h.read("<p>" + "word " * 200_000).count("word") == 200_000


def page(i, host="a.example", box="Join our club today", para="Licensed text"):
    return (i, f"https://{host}/p{i}", f"<body><div><p>Welcome to the site</p></div><article><h1>Title {i}</h1><p>body {i}</p><div><span>{box}</span></div><p>{para}</p></article><div>bottom</div></body>", "x")


def test_templates_go_and_paragraphs_of_the_article_stay(spark):
    rows = [page(i) for i in range(12)] + [page(100, "b.example"), (200, None, None, None), (201, "no url", "", None), (202, "https://a.example/x", "<p>x</p>", None)]
    rows += [(i, f"http://plain.example/{i}", f"<body><div>Top bar</div><p>story {i}</p><div>Bottom bar</div></body>", None) for i in range(300, 306)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (50_000, 0):
        h.BROADCAST_HASHES, before = limit, h.BROADCAST_HASHES
        got = {r["page_id"]: r["__h_text"] for r in h.extract(df).collect()}
        h.BROADCAST_HASHES = before
        assert all(got[i] == f"Title {i}\n\nbody {i}\n\nLicensed text" for i in range(12))
        assert got[100] == "Title 100\n\nbody 100\n\nJoin our club today\n\nLicensed text"
        assert got[200] == got[201] == "" and got[202] == "x"
        assert all(got[i] == f"story {i}" for i in range(300, 306))
    assert h.extract(df.limit(0)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    html = "<body><div><p>story told once</p></div></body>", "<article><h1>T</h1><section><ul><li>item</ul></section><p>end</p></article>"
    rows = [(i, f"https://copy.example/{i}", html[i % 2]) for i in range(20)]
    rows += [(100 + i, f"https://copy.example/x{i}", f"<div>Site bar</div><p>other {i}</p>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["__h_text"] for r in h.extract(df).collect()}
    assert all(got[i] == ("story told once", "T\n\nitem\n\nend")[i % 2] for i in range(20))
    assert all(got[100 + i] == f"other {i}" for i in range(6))


def test_hosts(spark):
    urls = ["HTTP://A.example:80/x", "https://u:p@b.example?x", "c.example/x", None, "ftp://d.example"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(h.host(df.u)).collect()] == ["a.example", "b.example", "", "", "d.example"]


def neutral(i, r, n=40):
    """A page whose parts have neutral names and whose menus, adverts and footers differ in their words from page to page."""
    w = lambda k: " ".join(fixtures.word(r) for _ in range(k))
    paragraphs = [w(n) for _ in range(3)]
    html = (
        f"<body><div class='x1'><ul>{''.join(f'<li><a href=/{k}>{w(1)}</a></li>' for k in range(r.randint(3, 6)))}</ul></div><div class='x2 n{1000 + i}'>{w(5)}</div>"
        f"<div class='x3'><h1>{w(4)}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class='x4'><a href=/a>{w(2)}</a> <a href=/b>{w(2)}</a></div></div><div class='x5'>{w(6)}</div></body>"
    )
    return html, paragraphs


def test_templates_decide_where_names_say_nothing(spark):
    r = random.Random(1)
    made = [neutral(i, r) for i in range(40)]
    rows = [(i, f"http://n.example/{i}", html) for i, (html, _) in enumerate(made)] + [(100, "http://other.example/", made[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for names in (True, False):
        got = {x["page_id"]: x["__h_text"].split("\n\n") for x in h.extract(df, names=names).collect()}
        assert all(got[i][1:] == made[i][1] and len(got[i]) == 4 for i in range(40))
        assert len(got[100]) > 6
    gone = {x["host"]: (x["pages"], x["changed"]) for x in h.removals(df).collect()}
    assert gone == {"n.example": (40, 40), "other.example": (1, 0)}


def plain_templates(pages):
    """Template of one host's different pages by a plain walk over trees that html.parser builds; for pages whose tags are all closed."""

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = ["", "", []]
            self.at = [self.root]

        def handle_starttag(self, tag, attrs):
            made = [tag, " ".join(sorted({re.sub("[0-9]{2,}", "", c) for c in (dict(attrs).get("class") or "").split()})), []]
            self.at[-1][2].append(made)
            self.at.append(made)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            if data.strip():
                self.at[-1][2].append(" ".join(data.split()))

    def walk(node, path, linked, trees, slots):
        here = path + ((node[0], node[1]),) if node[0] in h.SLOTS else path
        chars = links = 0
        title = node[0] == "h1"
        for x in node[2]:
            if isinstance(x, str):
                chars, links = chars + len(x), links + (len(x) if linked or node[0] == "a" else 0)
            else:
                c, n, t = walk(x, here, linked or node[0] == "a", trees, slots)
                chars, links, title = chars + c, links + n, title or t
        if node[0] in h.BLOCK and node[2] and node[0] not in ("html", "body"):
            trees.add(repr(node))
        if node[0] in h.SLOTS:
            old = slots.setdefault(here, [0, 0, False])
            slots[here] = [old[0] + chars, old[1] + links, old[2] or title]
        return chars, links, title

    n_trees, n_slots, total, whole = Counter(), Counter(), {}, 0
    for html in set(pages):
        tree, trees, slots = Tree(), set(), {}
        tree.feed(html)
        whole += walk(tree.root, (), False, trees, slots)[0]
        n_trees.update(trees)
        n_slots.update(list(slots))
        for k, (c, n, t) in slots.items():
            old = total.get(k, (0, 0, False))
            total[k] = (old[0] + c, old[1] + n, old[2] or t)
    often = lambda n: n >= h.MIN_PAGES and n > h.RATIO * len(set(pages))
    some = {k: v for k, v in total.items() if often(n_slots[k]) and v[0]}
    big = {k for k, v in some.items() if v[0] >= whole / 2}
    dense = {k for k, v in some.items() if 2 * v[1] >= v[0]}
    return {
        "trees": sum(map(often, n_trees.values())), "dense": len(dense - big), "content": min(big, key=lambda k: (some[k][0], -len(k))) if big else (),
        "slots": len([k for k, v in some.items() if k not in dense and v[0] <= 0.15 * whole and not v[2]]),
    }


def test_templates_against_brute_force(spark):
    r = random.Random(4)
    hosts = {f"h{k}.example": [neutral(i % 25, r, 5 + 10 * k)[0] for i in range(30)] for k in range(3)}
    hosts["h3.example"] = [page(i, "h3.example")[2] for i in range(20)] + [page(0, "h3.example")[2]] * 30
    df = spark.createDataFrame([(f"http://{u}/{i}", x) for u, xs in hosts.items() for i, x in enumerate(xs)], "url string, html string")
    got = {x["__h_host"]: x["__h_template"] for x in h.templates(df, "url", "html").collect()}
    for u, xs in hosts.items():
        want, t = plain_templates(xs), got[u]
        assert (len(t["trees"] or []), len(t["dense"]), len(t["slots"])) == (want["trees"], want["dense"], want["slots"])
        content = 0
        for tag, names in want["content"]:
            content = h._slot(content, tag, names)
        assert (t["content"] or [0]) == [content]
