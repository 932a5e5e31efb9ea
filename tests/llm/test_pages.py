"""Main text of pages."""

from collections import Counter

import pytest

from fovea.llm import html_extract
from fovea.llm.html_extract import page_blocks


def text_of(source):
    return "\n".join(page_blocks(source)[1])


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain &amp; text\n here", "plain & text here"),
        ("<p>a<p>b", "a\nb"),
        ("<p>one <b>tw</b>o<br>three&nbsp;&#233;</p>", "one two three é"),
        ("<article><p><b>x<br><p>y</p></article><footer>f</footer>", "x\ny"),
        ("<nav><a href='/'>n</a></nav><main><h1>T</h1><aside>s</aside><p>m</p></main>", "T\nm"),
        ("<div class='cookie-notice'>c</div><p>m</p><div id=comments><p>r</p></div>", "m"),
        ("<p>a</p><script>var t = '</p><p>no';</script><style>p{}</style><p>b", "a\nb"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><th>3</table>", "x\ny\n1 2\n3"),
        ("<header>h</header><article><header><h1>T</h1></header><p>p</p><form>f<input></form></article>", "T\np"),
        ("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>end", "1 < 2 and 3 > 2\nend"),
        ("<div><a>1</a> <a>2</a></div><p>body</p>", "body"),
        ("<p title='a>b'>q</p></div></p><p>z", "q\nz"),
        ("<!DOCTYPE html><p>a</p><!-- open", "a"),
    ],
)
def test_blocks(source, want):
    assert text_of(source) == want


def page(k, body, extra=""):
    return f"<html><body><div>Site title</div>{extra}<div><p>{body}</p></div><div><p>All rights kept</p></div></body></html>"


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_template_is_what_recurs_on_a_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", broadcast)
    rows = [(k, f"https://A.example.org/{k}", page(k, f"own text {k}")) for k in range(8)]
    rows += [(k, f"https://b.example.org/{k}", page(k, "the same article", "<p>once</p>")) for k in range(20, 30)]  # copies of one page
    rows += [(40, None, page(1, "no host")), (41, "https://c.example.org/", None), (42, "::bad[", ""), (None, "https://c.example.org/x", "<p>q</p>"), (40, None, page(1, "no host"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(pages).collect())
    full = lambda t: f"Site title\n{t}\nAll rights kept"
    want = [(k, f"own text {k}") for k in range(8)]
    want += [(k, full("once\nthe same article")) for k in range(20, 30)]
    want += [(40, full("no host"))] * 2 + [(41, ""), (42, ""), (None, "q")]
    assert got == Counter((k, t, len(t)) for k, t in want)
    assert html_extract.main_text(pages.where("false")).count() == 0


def test_article_text_is_not_template(spark):
    shared = "<p>a passage that many articles quote</p>"
    rows = [(k, f"https://d.example.org/{k}", f"<article>{shared}<p>own {k}</p></article><div class=ad>buy {k}</div>") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == {k: f"a passage that many articles quote\nown {k}" for k in range(5)}


STORY = "A story of some length that is the text of this page and not of its cards."


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<article><section id='discussion'><h2 id='social-effects'>S</h2><p class='notice'>{STORY}</p></section><div class='related-work'>w</div></article>", f"S\n{STORY}\nw"),
        (f"<article><p>{STORY}</p><div class='share wide'>s</div><div class=ad>a</div></article>", STORY),
        (f"<main><h2 id='search'>S</h2><p>{STORY}</p></main>", f"S\n{STORY}"),
        (f"<main><h1>T</h1><p>lead</p><article><p>{STORY}</p></article></main>", f"T\nlead\n{STORY}"),
        (f"<main><p>{STORY}</p></main><article class='card'>c</article>", STORY),
        (f"<div><p>{STORY}</p></div><article class='card'>c</article>", f"{STORY}\nc"),
        (f"<form><div><p>{STORY}</p></div><input></form><form>f</form>", STORY),
        (f"<p>{STORY}</p><article class='comment'>r</article>", STORY),
    ],
)
def test_the_story_stays(source, want):
    assert text_of(source) == want


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.main_text(pages).collect()}


@pytest.mark.parametrize("folders", [True, False])
def test_a_section_has_its_own_template(spark, folders):
    """A box on a fifth of a host's pages is template, whether URLs tell the section or not; a few quotes are none."""
    own = lambda k: f"own text of page {k}, longer than any of the boxes around it"
    quote = lambda k: "<p>a quoted paragraph</p>" if k in (1, 2, 3) else ""
    rows = []
    for k in range(100):
        section = k // 20
        url = f"https://e.example.org/{f's{section}/' if folders else ''}{k}"
        rows.append((k, url, f"<div><p>box of layout {section}</p></div><div><p>{own(k)}</p>{quote(k)}</div>"))
    want = {k: own(k) + ("\na quoted paragraph" if quote(k) else "") for k in range(100)}
    assert texts_of(spark, rows) == want


def test_boxes_in_articles_go_and_near_copies_stay(spark):
    own = lambda k: f"own text of article {k}, longer than any of the boxes around it"
    rows = [(k, f"https://f.example.org/{k}", f"<article><p>{own(k)}</p>{'<div><p>read on in the shop</p></div>' if k < 30 else ''}</article>") for k in range(100)]
    assert texts_of(spark, rows) == {k: own(k) for k in range(100)}
    near = "a long paragraph that all the near copies of one article have in common"
    short = [(k, f"https://g.example.org/{k}", f"<article><p>{near}</p><p>the second paragraph of the article</p><p>tail {k}</p></article>") for k in range(20)]
    rows = short + [(k, f"https://g.example.org/{k}", f"<article><h1>A common heading</h1><p>{own(k)}</p></article>") for k in range(20, 40)]
    rows += [(k, f"https://g.example.org/{k}", f"<article><p>{own(k)}</p></article>") for k in range(40, 60)]
    assert texts_of(spark, rows) == {k: f"{near}\nthe second paragraph of the article\ntail {k}" if k < 20 else f"A common heading\n{own(k)}" if k < 40 else own(k) for k in range(60)}


def test_badly_nested_pages_stay_cheap_and_whole():
    """Unclosed elements: deeper ones become siblings, no text is lost."""
    import time

    from fovea.llm import html_extract

    start = time.time()
    _, blocks = html_extract._blocks("".join(f"<div>word{i} text" for i in range(5000)))
    nodes = html_extract._nodes(blocks)
    assert time.time() - start < 5
    assert [text for text, _ in blocks] == [f"word{i} text" for i in range(5000)]
    assert max(len(path) for _, path in blocks) <= html_extract.MAX_DEPTH
    assert len(nodes) == len({n.hash for _, path in blocks for n in path})


def test_longest_block_outside_a_subtree_by_definition():
    from fovea.llm import html_extract

    box = "<div><p>same box</p></div>"
    page = f"<body>{box}<div><p>one long first text here</p>{box}</div><section>{box}<p>second</p><p>zz</p></section><div>{box * 3}<p>one long first text hero</p></div></body>"
    _, blocks = html_extract._blocks(page)
    want = set()
    for _, path in blocks:
        for node in path:
            outside = [t for t, around in blocks if all(n.hash != node.hash for n in around)]
            want.add((node.hash, html_extract._short(min(outside, key=lambda t: (-len(t), t), default=""))))
    assert {(h, rest) for h, _, rest, _ in html_extract._nodes(blocks)} == want
