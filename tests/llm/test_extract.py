from __future__ import annotations

from tidemark.llm.extract import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><a href=x>Home</a></header><div id="sideBar"><p>Side text, with punctuation.</p></div>
<div class="content"><h2>Title of it</h2><p>First paragraph, long enough to be text, &amp; has
 commas &#8212; more.</p><p>Short one.</p><div class="share-buttons">Share this</div>
<p>Another paragraph with <a href=y>a link</a> in it, of decent length. Yes.</p></div>
<div class="cookie-notice">We use cookies, ok?</div><section id="comments"><p>Great article, I loved it, thanks.</p></section>
<form><p>Enter your name, please.</p></form><div style="display:none">Hidden, but long enough to count.</div><footer>foot</footer></body></html>"""


def test_content_stays_and_the_rest_goes():
    assert main_text(PAGE) == (
        "Title of it\n\nFirst paragraph, long enough to be text, & has commas — more.\n\nShort one.\n\n"
        "Another paragraph with a link in it, of decent length. Yes."
    )


def test_article_with_broken_markup():
    page = '<nav><ul><li><a href="/a">a</a></ul></nav><div class="ad">Buy now, cheap.</div><article><h1>Head</h1><p><b>One, two.<br><p>Three<p>fo'
    assert main_text(page) == "Head\n\nOne, two.\n\nThree\n\nfo"


def test_names_of_neighbours_and_deep_markup():
    page = '<body class="no-ads"><div class="layout has-sidebar"><div class="text"><p>Here is the text, long enough.</p><p>More of it, here.</p></div><div class="sidebar"><p>Beside, not text.</p></div></div>'
    assert main_text(page) == "Here is the text, long enough.\n\nMore of it, here."
    deep = "<div>" * 60000 + "deep, deep text" + "</span>" * 60000
    assert main_text(deep) == "deep, deep text"


def test_edge_cases(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "v", "plain, text", 2), (2, "v", "plain, text", 2), (3, "w", "<p>a < b &lt; c</p><p x", 3), (4, "x", "<div>" * 3000 + "deep, deep text", 4)]
    got = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text bigint")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted([("", 0), ("", 0), ("plain, text", 11), ("plain, text", 11), ("a < b < c", 9), ("deep, deep text", 15)])
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def plain_choice(blocks, texts):
    """The ratios and the threshold, block by block, with plain arithmetic."""
    import math

    def of_path(path):
        own = [(b, t) for b, t in zip(blocks, texts, strict=True) if b.path == path]
        length = sum(len(t) for _, t in own)
        marks = sum(sum(c in ".,;:!?…。、！？；，" for c in t) for _, t in own)
        return length / len(own), marks / len(own), sum(min(b.linked, len(t)) for b, t in own) / length

    found = [of_path(b.path) for b in blocks]
    ratios = []
    for k in range(len(blocks)):
        near = [(j, math.exp(-((j - k) ** 2) / 2)) for j in (k - 1, k, k + 1) if 0 <= j < len(blocks)]
        whole = sum(w for _, w in near)
        linked = found[k][2]
        length, marks = ((1 - linked) * sum(found[j][part] * w for j, w in near) / whole + linked * found[k][part] for part in (0, 1))
        ratios.append(math.sqrt(length / (length + 100) * (marks + 0.05) / (marks + 1)) * (1 - 0.95 * found[k][2]))
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    limit = max(min(max(0.6 * spread, 0.1 * max(ratios)), 0.5 * max(ratios)), 0.02)
    within = any(b.inside for b in blocks)
    weighted = [x * (50 if b.inside else 0.25 if within else 1) for b, x in zip(blocks, ratios, strict=True)]
    keep = []
    for b in blocks:
        own = [x for c, x in zip(blocks, weighted, strict=True) if c.path == b.path]
        keep.append(sum(own) / len(own) >= limit)
    return ratios, keep


BARE = """<body><div class="top"><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Contact us</a></ul></div>
<div class="text"><h2>A heading</h2><p>The text of it, long enough; with marks. And one more sentence.</p><p>Short.</p>
<ul><li>one item, here<li>another</ul></div><div class="bottom"><a href=d>Imprint</a> <a href=e>Privacy</a></div></body>"""


def test_ratios_against_brute_force():
    import duckdb
    import pytest

    from tidemark.llm.extract import blocks_of, content, fused

    pages = [x for (x,) in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()] + [PAGE, BARE, LISTS]
    for page in pages:
        pairs = [(b, " ".join("".join(b.parts).split())) for b in blocks_of(page)]
        blocks, texts = [b for b, t in pairs if t], [t for _, t in pairs if t]
        if blocks:
            ratios, keep = plain_choice(blocks, texts)
            assert fused(blocks, texts) == pytest.approx(ratios, abs=1e-9)
            assert content(blocks, fused(blocks, texts)) == keep


def test_ratios_find_menus_without_names():
    assert main_text(BARE) == "A heading\n\nThe text of it, long enough; with marks. And one more sentence.\n\nShort.\n\none item, here\n\nanother"


LISTS = """<article><h1><a href=x>A linked heading of the text</a></h1><p>First paragraph, with a comma. It goes on for a while.</p>
<ul class="jump"><li><a href=a>top</a><li><a href=b>next</a><li><a href=c>print</a></ul><div class="related-work"><p>Related work, kept.</p></div>
<p>Second paragraph, with more. It goes on, too.</p><ol><li><a href=d>Smith, J.: On pages, their parts and ratios, 1999.</a>
<li><a href=e>Miller, K.: More on pages, and even more of it, 2001.</a></ol><p>End.</p></article>"""


def test_inside_an_article_short_links_go_and_linked_text_stays():
    assert main_text(LISTS).split("\n\n") == [
        "A linked heading of the text", "First paragraph, with a comma. It goes on for a while.", "Related work, kept.", "Second paragraph, with more. It goes on, too.",
        "Smith, J.: On pages, their parts and ratios, 1999.", "Miller, K.: More on pages, and even more of it, 2001.", "End.",
    ]


def test_unfinished_and_inline_elements_lose_nothing_else():
    tail = "<p>What follows, stays.</p></article>"
    for name in ("svg", "object", "noscript", "template", "title", "iframe", "xmp"):
        assert main_text(f"<article><p>Before it, text. <{name}></p>{tail}").endswith("What follows, stays."), name
    assert main_text(f"<article><p>For <math><mi>x</mi></math> we have, so far, nothing.</p>{tail}").startswith("For x we have, so far, nothing.")
    assert main_text("<article><p>One, two.</p><script>var a; <p>never</p>") == "One, two."


def test_an_empty_article_has_no_text():
    assert main_text("<nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><article></article><footer>Foot, here.</footer>") == ""
