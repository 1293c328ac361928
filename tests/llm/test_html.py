import html
import re
import time

import pytest

from tallyloom.llm.htmltext import extract, extract_pages

LONG = "Some words of the article that go on for a while, as prose does, and then some more. "
CASES = [
    ("", ""),
    ("plain words only", "plain words only"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    (f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><footer>foot</footer></body>", f"Head\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>{LONG}<p>un&amp;closed &eacute;&#233;<br>next &nbsp; line</article><div class='comments'><p>{LONG}</p></div>", f"{LONG.strip()}\nun&closed éé next line"),
    (f"<div><script>var a='<p>x</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></div>", LONG.strip()),
    (f"<main><div class='cookie-notice'>We use cookies</div><section><p>{LONG}</p></section><aside>side</aside><section><p>{LONG}</p></section><form><p>send</p></form></main>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<div id=sidebar>{LONG}</div><div><p>{LONG * 3}</p></div>", (LONG * 3).strip()),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{LONG}", f"one\ntwo\na\nb\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><p>ends in the mid", f"{LONG.strip()}\nends in the mid"),
    (f"<article><p>a < b and c > d {LONG}</p></article>", f"a < b and c > d {LONG.strip()}"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert extract(page) == want


ARTICLE = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
TWO = f"{LONG.strip()}\n{LONG.strip()}"
WHOLE = [
    *[(f"<body><div {a}><nav>menu</nav>{x}<div class='comments'>no</div></div><div class=sidebar>side</div></body>", TWO) for a in ("class='site has-sidebar'", "class='content no-sidebar'", "class=layout-sidebar-right", "class=widget-page", "class='share-enabled'", "id=search") for x in (ARTICLE, f"<div><p>{LONG}</p><p>{LONG}</p></div>")],
    (f"<body><form action=x>{ARTICLE}<input name=q></form></body>", TWO),
    (f"<body><form action=x><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", TWO),
    (f"<article><div class='share-enabled'><p>{LONG}</p><p>{LONG}</p></div></article>", TWO),
    (f"<body><div>A lead that stands<br>in bare text.<div><p>{LONG}</p><p>{LONG}</p></div></div></body>", f"A lead that stands in bare text.\n{TWO}"),
    (f"<noscript>Enable scripts</noscript><article><p>{LONG}<math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><noscript><p>kept</p></noscript></article>", f"{LONG}x+1\nkept"),
    (f"<body><form><p>{LONG}</p></form><div><p>{LONG}</p><p>{LONG}</p></div></body>", TWO),
]


@pytest.mark.parametrize("page,want", WHOLE)
def test_whole_articles(page, want):
    assert extract(page) == want


NAMES = [
    ("<h2 id='related-work'>Related work</h2><section id='search-algorithms'><p>Binary search halves the range.</p></section><p class='legal'>The court ruled.</p><h3 class=share>Share</h3><div class='social-science'>kept</div>", "Related work\nBinary search halves the range.\nThe court ruled.\nShare\nkept"),
    ("<div class='share-buttons'>no</div><div id='related-posts'>no</div><div class='x ad-slot-3'>no</div><section class='comment-list'>no</section><div class='newsletter'>no</div>", ""),
    ("<p title='a hidden gem' data-class='ad'>kept</p><p hidden>no</p><div style='display: none'>no</div>", "kept"),
]


@pytest.mark.parametrize("inner,want", NAMES)
def test_names_of_boilerplate_inside_an_article(inner, want):
    assert extract(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>") == "\n".join(x for x in (LONG.strip(), want, LONG.strip()) if x)


PROSE = "Prose with <a href=x>a link</a> &amp; an  entity, <b>bold</b>\n words and so on, as long as paragraphs tend to be in articles. "
PLAIN = "Prose with a link & an entity, bold words and so on, as long as paragraphs tend to be in articles."
MENU = "<ul>" + "<li><a href=x>Menu item</a></li>" * 12 + "</ul>"
NO_ARTICLE = [
    f"<body><div class=header>{MENU}</div><div class=story><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p><blockquote>{PROSE}</blockquote><p>{PROSE}</p></div><div>{MENU}</div></body>",
    f"<body><table><tr><td>{MENU}</td><td><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></td></tr></table><div id=comments><p>{PROSE}</p></div></body>",
    f"<body>{MENU}<h1>Title of it</h1><p>{PROSE}<p>{PROSE}<p>{PROSE}<p>{PROSE}<div>{MENU}</div></body>",
    f"<body><div><div>{MENU}</div><div><div><h1>Title of it</h1><p>{PROSE}</p></div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></div></div><div class=footer>{PROSE}</div></body>",
]


@pytest.mark.parametrize("page", NO_ARTICLE)
def test_pages_without_an_article_element(page):
    assert extract(page) == "\n".join(["Title of it", *[PLAIN] * 4])


@pytest.mark.parametrize("junk", ["<a ", '<a "', '<a x="', "<p a='", '<a b="c" ', 'a="1" ', "<script ", "<!", "<!-- ", '<div class="', '="', "&", "<div></section>", "<ul><div>", "<li>"])
def test_broken_markup_is_read_in_linear_time(junk):
    start = time.time()
    got = extract("<article><p>text</p><img " * (junk == 'a="1" ') + "<article><p>text</p>" + junk * 20_000)
    assert got.startswith("text") and time.time() - start < 2


def test_pages_of_the_corpus(spark):
    """Against regular expressions, with every blank in its place: the article's blocks by their tags, inline tags being nothing."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1)
        body = re.sub(r"</?b>", "", body.replace("<br>", " "))
        parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_awkward_pages(spark):
    big = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>hi</p>", "x"), (3, "u", big, "x"), (3, "u", big, "x"), (4, "u", "<" * 5000, "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<p a='" + "x" * 3000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[None].text == "hi" and by[5].text == "deep"
    assert by[3].n_chars == 30_000 * 5 - 1
    assert extract_pages(df.limit(0)).count() == 0
