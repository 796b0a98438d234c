import pytest
from pyspark.sql import functions as F

from echoset.llm.html_text import extract_text, host_templates, main_text, subtree_hashes, template_rows

from .fixtures import CLASHING

ARTICLE = "<article><h1>Title {i}</h1><p><b>First {i} &amp; more.<br><p>Second\n  line {i}</p><ul><li>one<li>two {i}</ul></article>"
WANT = "Title {i}\n\nFirst {i} & more.\n\nSecond line {i}\n\none\n\ntwo {i}"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div>"
    + ARTICLE + "<footer>&copy; site</footer></body></html>")


def test_semantic_page():
    assert main_text(PAGE.format(i=1)) == WANT.format(i=1)


def test_parts_that_are_not_the_article():
    page = """<body><header>Site</header><div id="cookie-notice">We use cookies</div><aside>Side</aside>
    <main><article><header><h1>Head</h1></header><p>Text <a href=x>link</a> goes on&hellip;</p>
    <form><input><p>Sign up</p></form><table><tr><td>a<td>b<tr><td>c</table><noscript>no</noscript><p hidden>hid</p>
    <pre>x
      y</pre><section class="comments"><p>First!</p></section><div class="share">Share</div></article></main>
    <div class="sidebar">More</div><div role="contentinfo">Foot</div></body>"""
    assert main_text(page) == "Head\n\nText link goes on…\n\na b\n\nc\n\nx y"


def test_awkward_markup():
    assert main_text(None) == main_text("") == main_text("   ") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>a < b && c &lt;d&gt; &#233; &am") == "a < b && c <d> é &am"
    assert main_text("<div>a<p>b<div>c</div>d</p>e</div></div></p>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert main_text('<p title="a > b" x=\'">\'>quoted</p><p broken="x>y') .startswith("quoted")
    assert main_text("<p>open <script>never closed") == "open"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def divs(i, host):
    """A page without semantic markup: only its recurrence tells the template."""
    return (f"<body><div><p>Welcome to {host}</p><a href=/>Home</a></div><div><h2>News {i}</h2><p>Story number {i} of {host}.</p></div>"
            f"<div><p>All rights reserved by {host}.</p></div></body>")


@pytest.mark.parametrize("broadcast_hashes", [200_000, 0])
def test_templates_are_found_by_host(spark, broadcast_hashes):
    rows = [(i, f"http://big.example.com/{i}?q=1#x", divs(i, "big")) for i in range(30)]
    rows += [(100 + i, f"https://user@Small.example.com:80/{i}", divs(i, "small")) for i in range(3)]  # too few to tell
    rows += [(200 + i, f"http://art.example.com/{i}", PAGE.format(i=i % 2)) for i in range(20)]  # mirrored articles stay
    rows += [(300, None, divs(0, "big")), (301, "no url", divs(0, "big")), (302, "http://big.example.com/", None), (303, "http://big.example.com", "")]
    rows += [(None, "http://big.example.com/n", divs(77, "big")), (0, rows[0][1], rows[0][2])]
    got = {}
    for r in extract_text(pages(spark, rows), broadcast_hashes=broadcast_hashes).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[0] == ["News 0\n\nStory number 0 of big."] * 2 and got[7] == ["News 7\n\nStory number 7 of big."]
    assert got[None] == ["News 77\n\nStory number 77 of big."]
    assert got[100][0].startswith("Welcome to small") and "All rights" in got[100][0]
    assert got[205] == [WANT.format(i=1)]
    assert got[300] == got[301] and "Welcome" in got[300][0] and got[302] == got[303] == [""]
    assert sum(map(len, got.values())) == len(rows)


def test_templates_equal_brute_force(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", divs(i // 4, f"h{i % 3}")) for i in range(60)]
    got = {r["host"]: set(r["templates"]) for r in host_templates(
        pages(spark, rows).select(F.split("url", "/")[2].alias("host"), "html"), 5, 0.1).collect()}
    for host in ("h0.org", "h1.org", "h2.org"):
        own = [subtree_hashes(h) for _, u, h in rows if host in u]
        every = {x for h in own for x in h}
        assert got[host] == {x for x in every if sum(x in h for h in own) >= max(5, 0.1 * len(own))}


def test_empty_table(spark):
    assert extract_text(pages(spark, [])).collect() == []


def test_only_templates_are_gathered(spark):
    rows = [(i, f"http://h.org/{i}", divs(i // 6, "h")) for i in range(120)]  # groups of 6 copies are no template at a share of 0.1
    src = pages(spark, rows).select(F.lit("h.org").alias("host"), "html")
    own = [subtree_hashes(h) for _, _, h in rows]
    want = {x for h in own for x in h if sum(x in g for g in own) >= 12}
    found = template_rows(src, 5, 0.1)
    assert {r["hash"] for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_text_around_a_nested_article_stays():
    assert main_text("<main><h1>Title</h1><p>body</p><article>related teaser</article></main>") == "Title\n\nbody\n\nrelated teaser"
    assert main_text("<body><h1>Head</h1><main><p>lead</p><article><p>a</p></article><article><p>b</p></article></main><p>tail</p><nav>menu</nav>"
                     ) == "Head\n\nlead\n\na\n\nb\n\ntail"


@pytest.mark.parametrize("broadcast_hashes", [200_000, 0])
def test_template_on_two_percent_of_a_large_host(spark, broadcast_hashes):
    rows = [(i, f"http://large.org/{i}", f"<body>{'<div><p>Maintenance on Sunday.</p></div>' if i % 50 == 0 else ''}"
             f"<div><p>Story number {i}, group {i // 30} of many.</p></div><div><p>Topic {i // 30}</p></div></body>") for i in range(10_000)]
    rows.append((10_000, "http://large.org/0", rows[0][2]))
    got = {r["page_id"]: r["text"] for r in extract_text(pages(spark, rows), broadcast_hashes=broadcast_hashes).collect()}
    assert len(got) == len(rows) and not any("Maintenance" in t for t in got.values())
    assert got[50] == "Story number 50, group 1 of many.\n\nTopic 1"  # 30 of 10,000 pages are too few


@pytest.mark.parametrize("page", [
    '<div class="wrapper has-sidebar"><article><p>Body text.</p></article></div>',
    '<div class="post comments-open"><p>Body text.</p></div><div class="sidebar">x</div>',
    '<div id="page-with-nav"><nav>Menu</nav><p>Body text.</p></div>',
    '<form id="aspnetForm"><div class="menu">Menu</div><p>Body text.</p><input></form>',
    '<form id="aspnetForm"><article><p>Body text.</p></article><fieldset><p>Sign in.</p></fieldset></form>',
    '<main><section id="related-work"><p>Body text.</p></section></main>',
    '<main><div id="copyright-law">Body text.</div></main>',
    '<nav><a href="/">Home</a><main><p>Body text.</p></main>',
    '<nav><ul><li><a href="/">Home</a><article><p>Body text.</p></article>',
    '<p>Body <span class="advert">Buy now, <span>cheap</span></span>text.</p>',
    '<a class="skip-link" href="#c">Skip to content</a><p>Body <span hidden>not</span> text.</p>',
    '<article><p>Body text.</p><div class="comments"><p>A much longer comment than all of the article, by a reader.</p></div></article>',
    '<article><p>Body text.</p></article><div class="related-posts"><article><p>Teaser</p></article></div>',
    '<article class="comment"><p>A long comment that a reader wrote below.</p></article><article><p>Body text.</p></article>',
])
def test_layout_names_do_not_drop_the_article(page):
    assert main_text(page) == "Body text."
    assert main_text(f"<html><body>{page}</body></html>") == "Body text."


@pytest.mark.parametrize("piece", ["<a ", 'a <b "', "<b '\">", "<!", "<script ", "</x", "<div>", "</div>", "<x><p>", "<li>", "</script ", "<p '>\""])
def test_hostile_markup_in_linear_time(piece):
    import time

    took = []
    for size in (250_000, 1_000_000):
        for tail in ("", ">"):
            began = time.process_time()
            main_text(piece * (size // len(piece)) + tail)
            took.append(time.process_time() - began)
    assert max(took) < 12 and max(took[2:]) < 9 * max(0.1, *took[:2])  # a quadratic scan takes 16 times as long


def test_unmatched_end_tags_under_deep_nesting():
    assert main_text("<x>" * 50_000 + "</y>" * 50_000 + "<p>end") == "end"
