import html as entities
import os
import random
import re

import pytest
from quillspark.llm import mainhtml

LONG = "Some running text that goes on for a while, long enough to be an article's sentence."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f"<nav><a href=x>m</a></nav><article><h1>Head</h1><p>{LONG}</p></article><footer>f</footer>", f"Head\n\n{LONG}"),
        (f"<article><p>{LONG}<p>Two &amp; &lt;three&gt; &eacute;&#233;&nbsp; x</article>", f"{LONG}\n\nTwo & <three> éé x"),
        (f"<article><p><b>{LONG}<br>more<p>Short.</article>", f"{LONG} more\n\nShort."),
        (f"<div class='sidebar-2'><p>{LONG}</p></div><div id=content><p>{LONG}</p><ul><li>a</li><li>b<li>c</ul></div>", f"{LONG}\n\na\n\nb\n\nc"),
        (f"<main><article><header><h2>Title</h2><p>by me</p></header><p>{LONG}</p><section class=comments><p>{LONG}</p></section></article></main>", f"Title\n\n{LONG}"),
        (f"<article class='post has-comments'><p>{LONG}</p></article><article class=comment><p>{LONG} {LONG}</p></article>", LONG),
        (f"<div><div class=ad>{LONG}</div><div role=navigation>{LONG}</div><div class=text><p>{LONG}</p></div></div>", LONG),
        (f"<article>{LONG}<!-- <p>x</p> --><form><p>{LONG}</p></form><div class='cookie-notice'>{LONG}</div></article>", LONG),
        (f"<article><p>1 < 2 and a<b {LONG}</p></article>", None),
        (f"<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><p>{LONG}</p></article>", f"a b\n\nc\n\n{LONG}"),
        ("", ""),
        (f"<form id=aspnetForm><nav>{LONG}</nav><main><article><h1>Head</h1><p>{LONG}</p></article></main><input value=x></form>", f"Head\n\n{LONG}"),
        (f"<div class=search-layout><form><p>Your name</p></form><div class=widget-text><p>{LONG} {LONG}</p></div><div class=related><a href=x>{LONG}</a></div></div>", f"{LONG} {LONG}"),
        (f"<form><p>Name</p><p>Your message, please, in no more than a hundred words.</p></form><div><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<div class=post><h1>A heading of its own</h1><div class=body><p>{LONG}</p></div></div><div class=list><a href=x>{LONG}</a></div>", f"A heading of its own\n\n{LONG}"),
        (f"<div class=comments><p>{LONG} {LONG} {LONG}</p></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(body, expected):
    text = mainhtml.main_text(page(body), ())
    if expected is not None:
        assert text == expected


def test_odd_sources():
    for source in (None, "", "plain text only", "<", "<p", "<script>", "<!--", "</div>" * 50, "<div>" * 3000, '<a href="x' * 200, "<p class=\"a'>x</p>", "<b>" * 500):
        assert isinstance(mainhtml.main_text(source, ("/html/body",)), str)
    assert mainhtml.main_text("plain  text\nonly", ()) == "plain text only"


def test_hosts_agree_on_a_path(spark):
    good = page(f"<div class='box-1'><p>{LONG} {LONG}</p></div><div class=rest><p><a href=x>{LONG}</a></p></div>")
    odd = page(f"<div class='box-7'><p>Short.</p></div><div class=rest><p>{LONG} {LONG} {LONG}</p></div>")
    less = page(f"<div class='box-7'><p>{LONG}</p></div><div class=rest><p>{LONG} {LONG} {LONG}</p></div>")
    rows = [(i, "http://h.org/a", good, 1) for i in range(12)] + [(98, "http://h.org/b", less, 1), (99, "http://h.org/b", odd, 1), (100, None, None, 1), (101, "http://x.org", odd, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    out = {r.page_id: r for r in mainhtml.extract(pages).collect()}
    assert len(out) == 16 and out[0].host == 1
    assert out[98].main_text == LONG  # the host's path, not the page's own best
    assert out[99].main_text == f"{LONG} {LONG} {LONG}"  # next to nothing is at the host's path
    assert out[101].main_text == f"{LONG} {LONG} {LONG}"
    assert out[100].main_text == ""
    assert mainhtml.extract(pages.limit(0)).count() == 0


def test_hosts_agree_on_suspects(spark):
    """A class word says clutter; where it holds the text of most pages of a host, it is content on all of them."""
    usual = page(f"<div class=widget><p>{LONG} {LONG}</p></div><div class=foot-links><a href=x>{LONG}</a></div>")
    short = page(f"<div class=widget><p>Few words, but in one line of some length at least.</p></div><div class=aside-list><p>{LONG}</p></div>")
    other = page(f"<div class=widget><p>Buy now, and save a lot of money.</p></div><div class=story><p>{LONG}</p></div>")
    rows = [(i, "http://h.org/a", usual) for i in range(5)] + [(5, "http://h.org/b", short)] + [(i, "http://o.org/", other) for i in range(6, 9)]
    out = {r.page_id: r.main_text for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == f"{LONG} {LONG}" and out[5] == "Few words, but in one line of some length at least." and out[7] == LONG


TEMPLATES = (  # without article or main tags; the text's place is marked by @
    "<div id=top class=navbar><a href=x>Home</a> <a href=y>More of it</a></div><div class=wrap><div class='c-{n}'>@</div><div class=sidebar><ul><li><a href=z>{t}</a></ul></div></div><div class=footer>f {n}</div>",
    "<form><table><tr><td class=menu><a href=x>a</a></td><td>x</td></tr></table><div class=story>@</div><div class='share social'><p>Share this with all of your many friends.</p></div></form>",
    "<div class=banner><p>{t}</p></div><section class=post>@</section><section class=comments><p>{t} {t}</p><p>{t}</p></section>",
)


def test_templates_without_article_tags(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(9, 25))).capitalize() + "."
    rows, wanted = [], {}
    for i in range(90):
        blocks = [" ".join(word() for _ in range(4)).title()] + [" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 6))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        filled = TEMPLATES[i % 3].format(n=i, t=sentence()).replace("@", body)
        rows.append((i, f"https://host{i % 3}.org/{i}", page(filled)))
        wanted[i] = "\n\n".join(blocks)
    out = {r.page_id: r.main_text for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == wanted


def test_very_long_page_and_clashing_names(spark):
    rows = [(1, "http://a.org", page("<article>" + f"<p>{LONG}</p>" * 30_000 + "</article>"), "x", "y", 1), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Main_Text string, paths string, content int")
    out = {r.page_id: r for r in mainhtml.extract(df).collect()}
    assert out[1].__fields__ == ["page_id", "url", "html", "paths", "content", "main_text"]
    assert len(out[1].main_text) == 30_000 * (len(LONG) + 2) - 2 and out[1].paths == "y" and out[2].main_text == ""


def test_whole_table_against_the_articles(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test data")
    from quillspark.llm.queries import op7_main_text

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    for r in op7_main_text(spark, path).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", sources[r.page_id], re.S)[1]
        blocks = [entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert r.n_chars == len(r.text)


def real(i, middle, names="post"):
    return page(f"<div id=wrap><div class='site-header'><a href=/>home</a></div><div class='{names}'><h1>Head {i}</h1><p>{LONG} {i}</p>{middle}<p>{LONG} End {i}.</p></div><div class=footer><a href=x>link</a></div></div>")


@pytest.mark.parametrize(
    "middle",
    [
        "<section class=discussion><p>{} We discuss.</p></section>", "<div id='official-reply'><p>{} They reply.</p></div>", "<p>{} <span class='code-comment'>so it says</span></p>",
        "<section class='related-work'><p>{} Others did.</p></section>", "<div class='search-tips'><p>{} Try this.</p></div>",
    ],
)
def test_names_that_hold_a_suspect_word_among_others(spark, middle):
    """Real class names, on twenty pages of a host each."""
    inside = [middle.format(f"{LONG} {i}") for i in range(20)]
    rows = [(i, "http://h.org/a", real(i, inside[i], "post comments-open")) for i in range(20)]
    rows += [(100 + i, "http://g.org/a", page(f"<article><h1>Head {i}</h1><p>{LONG} {i}</p>{inside[i]}<p>{LONG} End {i}.</p></article>")) for i in range(20)]
    out = {r.page_id: r.main_text for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in out.items():
        kept = re.sub(r"<[^>]*>", "", inside[i % 100])
        assert text == f"Head {i % 100}\n\n{LONG} {i % 100}\n\n{kept}\n\n{LONG} End {i % 100}."


def test_what_stays_the_same_and_what_is_clutter_goes(spark):
    extra = (
        f"<div class='newsletter-fancy'><p>{LONG} Join us now.</p></div><div class='comments-area'><article class=comment><p>{LONG} I think.</p></article></div>"
        f"<div class='related-posts'><a href=x>{LONG}</a></div><div class='promo-summer'><p><a href=y>{LONG}</a></p></div>"
    )
    rows = [(i, "http://h.org/a", real(i, extra)) for i in range(20)]
    out = mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.main_text for r in out} == {f"Head {i}\n\n{LONG} {i}\n\n{LONG} End {i}." for i in range(20)}


def test_depth_costs_no_more_than_length():
    import resource
    import time

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sources = [
        "<div>" * 200_000 + LONG, "<div class=ad>" * 60_000 + f"<p>{LONG}</p>", "<div>" * 100_000 + "</p></section>" * 100_000 + LONG, "<span class=ad>x " * 60_000,
        "".join(f"<div class=c{'x' * (i % 7)}><p>{LONG}</p>" for i in range(20_000)),
    ]
    for source in sources:
        began = time.time()
        assert mainhtml.main_text(source, ())
        assert time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
