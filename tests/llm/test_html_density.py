import html
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.html_density import extract_pages, main_text
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def article(page):
    """The fixture pages mark their article; its blocks end at h1 and p tags."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|br)>", " ", p))).strip() for p in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op3_html_density"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text)


BODY = "<p>Many words in this paragraph, it goes on and on, and on further still.</p><p>And a second one, with many words too.</p>"
WANT = "Many words in this paragraph, it goes on and on, and on further still.\nAnd a second one, with many words too."


def test_unmarked_layout_by_density():
    page = f"""<html><body><div id=w><div class=top><a href=1>aa</a> <a href=2>bb</a> <a href=3>cc</a></div>
      <div class=col><h1>Head</h1><div class=txt>{BODY}</div></div>
      <div class=x><a href=1>one link</a><a href=1>two link</a><a>three</a></div></div></body></html>"""
    assert main_text(page) == "Head\n" + WANT


def test_marked_parts_are_left_out():
    page = f"""<body><header><h1>Site</h1></header><nav>Menu</nav><div class="cookie-notice">We use cookies and want you to know all of it</div>
      <div role="banner">Banner</div><main><h2>Title</h2>{BODY}<aside>aside</aside><div class="ad">Buy a lot of things now</div>
      <form>Name <input><button>Go</button></form><script>var a = "</p>";</script><style>p {{}}</style><p hidden>secret</p>
      <section id="readerComments"><p>I am a reader and I comment at some length on this.</p></section></main>
      <div class="sidebar">side</div><footer>&copy; me</footer>"""
    assert main_text(page) == "Title\n" + WANT


def test_unmarked_article_in_several_sections():
    part = lambda name, n: f"<div class={name}>" + "".join(f"<p>{name}{i} {'x' * 400}</p>" for i in range(n)) + "</div>"
    links = "<div class=x>" + "<a href=1>one link</a>" * 5 + "</div>"
    text = lambda name, n: [f"{name}{i} {'x' * 400}" for i in range(n)]
    for first, second in (("s1", "s2"), ("s2", "s1")):
        sizes = {"s1": 10, "s2": 9}
        page = f"<body><div id=content>{part(first, sizes[first])}{links}{part(second, sizes[second])}</div></body>"
        assert main_text(page) == "\n".join(text(first, sizes[first]) + text(second, sizes[second]))
        titled = page.replace("<div class=s", "<h2>Part</h2><div class=s")
        assert main_text(titled) == "\n".join(["Part", *text(first, sizes[first]), "Part", *text(second, sizes[second])])


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "class=no-sidebar", "class='post comments-open'", "class=js-nav-ready",
                                     "id=search-page", "class=widget", "class=bodyWithSidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_wrappers_lose_no_article(wrapper, tag):
    page = f"""<body><div class=menu><a href=1>aa</a> menu</div><div {wrapper}><{tag}>{BODY}</{tag}><div class="sidebar">side words</div>
      <div id="comments"><article><p>A reader's comment of some length.</p></article></div></div><div class=cookies>We use some</div></body>"""
    assert main_text(page) == WANT


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input name=v>{BODY}</form></body>", f"<body><form id=aspnetForm><article>{BODY}</article></form></body>",
    f"<body><aside class=wrap><main>{BODY}</main></aside><footer>me</footer></body>", f"<body><nav><a href=1>one</a><a href=2>two</a><article>{BODY}</article>",
    f"<body><nav><a href=1>one</a></nav><div><dialog open><div>{BODY}</div></dialog></div>"])
def test_wrappers_by_tag_lose_no_article(page):
    assert main_text(page) == WANT


def test_sections_of_an_article_with_words_as_anchors():
    text = "This part says quite a lot about its matter. It is as long as any other part of the article, and it has no links in it at all. "
    page = "<body><article><h1>Guide</h1>" + "".join(
        f"<section id={i}><h2>{i}</h2><p>{text}{i}</p></section>" for i in ("start", "search", "reply", "share")) + """
      <section id="related"><h2>Related</h2><a href=1>some other page of ours with a long title</a><a href=2>and one more of them, as long as it</a></section>
      <section id="newsletter"><p>Sign up now!</p></section>
      <section id="comments"><h2>Comments</h2><p>I have read all of it with great interest and would like to add a few words of my own to it here,
      since nobody else did so far, and I hope you like them.</p></section></article></body>"""
    assert main_text(page) == "\n".join(["Guide"] + [x for i in ("start", "search", "reply", "share") for x in (i, text + i)])


def test_hostile_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<b>" * 5000 + "</i>" * 50_000, "<i><div>" + "<b>" * 5000 + "</i>" * 50_000, "<b>" * 5000 + "<hr>" * 50_000, "<table><b>" * 3000 + "<td>" * 30_000,
                 "<p>" + "<b>" * 5000 + "</div>" * 50_000, "<li>" + "<b>" * 20_000 + "<h1>" * 20_000):
        assert main_text(page + "end").endswith("end")
    assert time.time() - began < 12


def _plain_density(node):
    """Counts and densities of a tree by recursion straight from the formulas."""
    from docweave.llm.html_density import Node

    def counts(n, in_link):
        link = in_link or n.tag == "a"
        c = t = lc = lt = 0
        for child in n.children:
            if isinstance(child, str):
                k = len(re.sub(r"\s", "", child))
                c, lc = c + k, lc + k * link
            elif not child.skip:
                a = counts(child, link)
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (child.tag == "a")
        out[id(n)] = (c, t, lc, lt)
        return out[id(n)]

    out = {}
    counts(node, False)
    ratio = out[id(node)][2] / max(out[id(node)][0], 1)
    density = {}
    for key, (c, t, lc, lt) in out.items():
        if c:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            first = c / max(t, 1)
            density[key] = first * math.log(max(first * (c / max(lc, 1)) * (max(t, 1) / max(lt, 1)), 1.0)) / max(math.log(base), 1.0) if base > 1 else first
    return out, density, Node


PIECES = st.recursive(st.text("ab c\n", max_size=30), lambda inner: st.builds(
    lambda tag, parts: f"<{tag}>{''.join(parts)}</{tag}>", st.sampled_from(["div", "p", "a", "b", "ul", "nav", "span", "h2"]), st.lists(inner, max_size=4)), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_densities_and_sums_by_brute_force(page):
    from docweave.llm.html_density import _body, _densities, _measure, parse

    body = _body(parse("<body>" + page))
    order = _measure(body)
    _densities(order)
    counts, density, Node = _plain_density(body)
    for node, _ in order:
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == counts[id(node)]
        assert node.density == pytest.approx(density.get(id(node), 0.0))
        assert node.total == pytest.approx(sum(density.get(id(c), 0.0) for c in node.children if isinstance(c, Node) and not c.skip))


def test_odd_markup():
    assert main_text("") == main_text("</p></div>") == main_text("<script>x") == ""
    assert main_text("plain &amp; text &#233;&nbsp;x") == "plain & text é x"
    assert main_text("<html><head><title>x</title><body><h1>H</h1><p>hello<p>you<br>there") == "H\nhello\nyou there"
    assert main_text("<div><ul><li>one<li>two</ul></div>") == "one\ntwo"
    assert main_text("<p>a <b>b<i>c</b> d</i>\n\n e</p><!-- no --><p></p>") == "a bc d e"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>x</p>", 2), (2, "u", "", 3), (2, "u", "", 3), (3, "v", "<p>" + "long " * 200_000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").selectExpr("*", "1 as c0", "2 as n_chars")
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in extract_pages(df).collect()), key=repr)
    assert got == sorted([(0, None, 1), (1, "u", 0), (2, "u", 0), (2, "u", 0), (3, "v", 999_999)], key=repr)
    assert extract_pages(df.limit(0)).count() == 0
