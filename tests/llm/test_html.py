import html
import re

import duckdb

from sparkloom.llm import html as h


def reference(page):
    """The article of the tables' pages, by plain patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", " ", inside).replace("<b>", ""))
    blocks = [" ".join(html.unescape(x).split()) for x in parts]
    return "\n\n".join(b for b in blocks if b)


def test_tables(spark):
    at = "/root/testdata/sf0.01"
    pages = {i: p for i, p in duckdb.sql(f"select page_id, html from '{at}/pages.parquet'").fetchall()}
    got = h.op3_html_text(spark, at).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == reference(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body class="page">
<header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
{open}<h2>Title &eacute;&nbsp;x</h2><p>First <b>bold</b>
  line<br>more &lt;b&gt; <!-- hidden > --><script>if (a < b) document.write("</p>")</script></p><p>Second {n}
<ul><li>one<li>two</ul><div class="ad">buy</div><table><tr><td>a</td><td>b</td></tr></table>{close}
<div class='sidebar widget'><p>Related</p></div><section id="comments"><article><p>I disagree {n}</p></article></section>
<form><label>Mail</label><input value="x"></form><div>All rights reserved here</div><footer>foot</footer></body></html>"""
WANT = "Title é x\n\nFirst bold line more <b>\n\nSecond {n}\n\none\n\ntwo\n\na b"


def test_zones_blocks_and_references():
    page = PAGE.format(open="<article>", close="</article>", n=1)
    assert h.extract(page, set()) == WANT.format(n=1)


def test_template_text_is_found_where_nothing_marks_the_article(spark):
    rows = [(n, f"http://Host.example/{n}", PAGE.format(open="<div>", close="</div>", n=n), "x") for n in range(6)]
    rows += [(100, "http://other.example/", PAGE.format(open="<div>", close="</div>", n=100), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in h.extract_text(df).collect()}
    for n in range(6):
        assert f"Second {n}" in got[n] and "All rights reserved" not in got[n] and "disagree" not in got[n]
    assert got[100] == WANT.format(n=100) + "\n\nAll rights reserved here"
    levels = {r["level"] for r in h.templates(h._hosted(df)).collect()}
    assert 0 in levels


def test_deep_pages_keep_their_roles_apart():
    deep = "<html><body>" + "<div>" * 3000 + "<p>a</p><div><p>b</p></div>"
    blocks, roles, _ = h.parse(deep)
    assert [x[3] for x in blocks] == ["a", "b"] and blocks[0][0] != blocks[1][0]
    assert len(set(roles)) == len(roles) and max(map(len, roles)) <= h.LONG_PATH


def test_small_cases(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://a/", "<p>x"), (4, "http://a/", "plain < text & more"), (4, "http://a/", "plain < text & more"), (5, "http://a/", "<p>" + "y " * 50_000), (6, "http://a/", "<nav><p>m</p></nav></article></b><p>ok</div> z<script>var")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = sorted((str(r["page_id"]), r["text"]) for r in h.extract_text(df).collect())
    assert len(got) == len(rows)
    by = dict(got)
    assert by["1"] == "" == by["2"] and by["None"] == "x" and by["4"] == "plain < text & more" and by["5"] == ("y " * 50_000).strip() and by["6"] == "ok\n\nz"
    assert h.extract_text(df.limit(0)).count() == 0


def test_the_template_decides_inside_articles_and_for_each_layout(spark):
    page = '<html><body class="{kind}"><nav>menu</nav><{box}><h1>Title {n}</h1><p>Text {n}</p>{more}<div class="x">Read our other {kind} pages</div><div class="share">Like {n}</div></{box}><p>All rights reserved</p></body></html>'
    rows = [(n, f"http://a/{n}", page.format(kind="post", box="article", n=n, more="")) for n in range(7)]
    rows += [(n, f"http://a/{n}", page.format(kind="event", box="div", n=n, more="")) for n in range(7, 10)]
    more = '<h2 id="social-history">Social history</h2><section id="related-work"><p>Earlier work</p></section>'
    rows += [(10, "http://a/10", page.format(kind="post", box="article", n=10, more=more))]
    rows += [(11, "http://b/11", page.format(kind="post", box="article", n=11, more=""))]
    rows += [(n, "http://c/", page.format(kind="post", box="article", n=12, more="")) for n in range(12, 15)]
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(10):
        assert got[n] == f"Title {n}\n\nText {n}"
    assert got[10] == "Title 10\n\nText 10\n\nSocial history\n\nEarlier work"
    assert got[11] == "Title 11\n\nText 11\n\nRead our other post pages"
    assert got[12].startswith("Title 12\n\nText 12")
