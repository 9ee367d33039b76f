from __future__ import annotations

import html
import json
import re

from tests.llm import cases
from tidecast.llm import queries, wrappers
from tidecast.llm.wrappers import Node, expression, merge, page_tree, ready

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, host string, wrapper string, page int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 1) for r in rows], SCHEMA)


def read(*pages):
    """The last page, read with the wrapper of all."""
    root = page_tree(pages[0])
    for page in pages[1:]:
        root = merge(root, page_tree(page))
    return ready(json.dumps(root.to_list())).read(pages[-1])


def test_query_against_the_known_markup(spark, folder):
    """The test pages have one markup, so that two patterns give their article."""
    want = []
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in re.split("</?(?:h1|p)>", article)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        want.append((r["page_id"], r["url"], text, len(text)))
    assert cases.as_rows(queries.op6_html_extraction(spark, folder)) == sorted(want, key=str)


def test_expressions():
    one = "<ul><li>a</li><li>b</li></ul><p>x</p>"
    two = "<ul><li>c</li></ul><h2>t</h2><p>y</p><p>z</p>"
    root = merge(page_tree(one), page_tree(two))
    assert expression(root) == "<ul>(<li>#text</li>)+</ul>(<h2>text</h2>)?(<p>#text</p>)+"
    same = merge(page_tree(one), page_tree(one))
    assert expression(same) == "<ul>(<li>#text</li>)+</ul><p>text</p>"
    copy = Node.from_list(json.loads(json.dumps(root.to_list())))
    assert expression(copy) == expression(root)


def test_template_parts():
    page = (
        '<html><head><title>t</title></head><body><div class="cookie-notice">C</div><header>H<nav>N</nav></header>'
        "<article><header><h1>Head &amp; <i>l</i>ine</h1></header>one<p>two<br>three\n  four<p>five <b>six</b>!"
        '<div class="ad">AD</div><aside>S</aside><form>F<input></form><script>if (a<b) "</p>"</script>'
        '<ul><li>x<li>y</ul><section id="comments"><article class="comment">no</article></section>'
        "<table><tr><td>1<td>2</table></article><article class='related'>R</article><footer>&copy; Z</footer>"
    )
    assert read(page) == "Head & line\n\none\n\ntwo three four\n\nfive six!\n\nx\n\ny\n\n1\n\n2"
    assert read("<div role=main><p>in</p></div><p>out</p>") == "in"
    assert read("plain text &lt; a < b") == "plain text < a < b"
    assert read("<p hidden>h</p><p>v</p><!-- <p>c</p> --><p>a&nbsp;&#65;&amp</p>") == "v\n\na A&"


def test_constant_slots_are_template_without_an_article():
    pages = [f"<div><p>Site name</p></div><section><p>text {i}</p></section>" for i in range(4)]
    assert read(*pages) == "text 3"
    # copies of one page: nothing changes, so nothing can be told apart, and all is kept
    assert read(*[pages[0]] * 4) == "Site name\n\ntext 0"


def test_broken_and_huge_markup():
    assert read("") == "" and read("<") == "<" and read("<p") == "" and read("</p>x</div>") == "x"
    assert read("<div>" * 20_000 + "deep") == "deep"
    assert read("<b>" * 5_000 + "bold" + "<p>next") == "bold\n\nnext"
    many = "".join(f"<p class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>{i}</p><i>j</i>" for i in range(5_000))
    assert read(many, many).count("\n\n") == 9_999
    assert len(json.dumps(merge(page_tree(many), page_tree(many)).to_list())) < 100_000
    assert read("<a href=\"x>y\">link</a> <a title='it\"s'>q</a>") == "link q"


def test_tricky_rows(spark):
    rows = [(1, "http://a.b/1", "<article>x &amp; y</article>"), (1, "http://a.b/1", "<article>x &amp; y</article>"), (2, None, None),
            (3, "http://a.b/2", None), (None, "no host", "<p>p"), (4, "http://c.d", "")]
    found = cases.as_rows(wrappers.extract(frame(spark, rows)))
    texts = {1: "x & y", None: "p"}
    assert found == sorted(((i, u, texts.get(i, ""), len(texts.get(i, ""))) for i, u, _ in rows), key=str)
    assert wrappers.extract(frame(spark, rows).limit(0)).count() == 0


def test_mixed_layouts_of_a_host_and_of_pages_without_one(spark):
    rows, want = [], {}
    for k, url in enumerate(["http://a.b/{}", "no host {}"]):
        for i in range(12):
            body, text = [
                (f"<article><p>card {i}</p></article><div>more</div>", f"card {i}"),
                (f"<div class=post><p>post {i}</p></div>", f"post {i}"),
                (f"<main><p>page {i}</p></main><div>more</div>", f"page {i}"),
            ][i % 3]
            rows.append((100 * k + i, url.format(i), f"<body><nav>N</nav><div>Site name</div>{body}</body>"))
            want[100 * k + i] = text
    found = {r["page_id"]: r["text"] for r in wrappers.extract(frame(spark, rows)).collect()}
    assert found == want
