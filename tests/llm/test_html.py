"""HTML extraction against a parser-based version on the driver's pages, and on pages of other builds."""

from html.parser import HTMLParser

import pytest

pytest.importorskip("textloom.llm")

from textloom.llm import html_extract, queries  # noqa: E402

BLOCKS = {"p", "br", "h1", "h2", "li", "ul", "div", "article", "nav", "footer", "body", "html", "head", "title"}


class Article(HTMLParser):
    """The blocks inside <article>, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op4_html_extract(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: "\n".join(Article(r.html).blocks) for r in pages}
    assert got == {k: (t, len(t)) for k, t in want.items()}


PROSE = ["The first paragraph of the article tells what the town decided about its bridge last week.", "The second one says who voted for it, who against, and what the bridge will cost & when.", "The third closes the article with what the mayor said to the people after the vote."]
BODY = "".join(f"<p>{x.replace('&', '&amp;')}</p>" for x in PROSE)
FURNITURE = '<nav><a href="/">Home</a> <a href="/x">News</a></nav>'
FOOT = '<footer>&copy; 2024 <a href="/l">Legal</a></footer>'


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("plain text &amp; no markup", "plain text & no markup"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body>{FURNITURE}<article>{BODY}</article>{FOOT}</body></html>", "\n".join(PROSE)),
        (f"<body>{FURNITURE}<main>{BODY}<aside>Read this too</aside></main>{FOOT}", "\n".join(PROSE)),
        (f'<body>{FURNITURE}<div class="content">{BODY}</div><div id="sidebar">Other stories</div><section class="comments"><p>{PROSE[0]} I disagree with all of it.</p></section>{FOOT}', "\n".join(PROSE)),
        (f'<body><div class="cookie-notice">We use cookies, accept them.</div>{BODY}<form><label>Mail</label><input></form><script>var a = "<p>x</p>";</script>', "\n".join(PROSE)),
        (f"<article><header><h1>A title</h1></header>{BODY}</article>", "\n".join(["A title", *PROSE])),
        (f"<article>{BODY.replace('</p>', '')}</article>", "\n".join(PROSE)),
        ("<article><p>one\n  two&nbsp;three &#233; <b>bold</b> <i>and</i>\tmore</p><!-- <p>no</p> --><p>four</p></article>", "one two three é bold and more\nfour"),
        (f"<article>{BODY[:-4]}", "\n".join(PROSE)),
    ],
)
def test_builds(page, expected):
    assert html_extract.main_text(page) == expected


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, f"<article>{BODY}", "y")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html_extract.extracted(df).collect()), key=repr)
    whole = "\n".join(PROSE)
    assert out == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, whole, len(whole))], key=repr)
    assert html_extract.extracted(df.where("false")).count() == 0


def test_very_long_page():
    assert html_extract.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert html_extract.main_text("<div>" * 20_000 + "deep") == "deep"


AD = '<div class="ad"><p>Buy</p><p>this</p><p>now</p></div>'


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<div><div><h1>Title</h1></div><div>{BODY}</div></div>", ["Title", *PROSE]),
        (f"<body>{BODY}{AD}<p>Short.</p>{AD}{AD}{AD}<div><div><h2>Last</h2></div></div><div><div><p>End.</p></div></div>", [*PROSE, "Short.", "Last", "End."]),
        (f"<div><h1>Title</h1></div>{AD}{AD}{AD}{BODY * 20}", ["Title", *PROSE * 20]),
    ],
)
def test_unmarked_pages_keep_short_blocks(page, expected):
    assert html_extract.main_text(page).split("\n") == expected


def test_only_text_and_furniture_are_lines():
    assert html_extract.page_lines(f"<div><div><h1>T</h1></div><div>{AD}<p>x</p></div></div>")[0] == ["T", "", "x"]


STRAY = "<div>Subscribe</div><div>12:30</div><div>Menu</div><div>Search</div>"
LINKS = "".join(f'<div><a href="/{i}">Another story of the week, number {i}</a></div>' for i in range(5))


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<body>{STRAY}<p>{PROSE[0]}</p><p>Short.</p><p>{PROSE[1]}</p>{LINKS}<div>Imprint</div>", ["Menu", "Search", PROSE[0], "Short.", PROSE[1]]),  # a block before the surge is in it
        (f"<body>{LINKS}{BODY}{LINKS}<p>{PROSE[0]}</p>{LINKS}", [*PROSE, *(f"Another story of the week, number {i}" for i in range(5)), PROSE[0]]),
        (f'<body>{LINKS}<h1><a href="/">A title that links</a></h1>{BODY}', ["A title that links", *PROSE]),
        (f"<body>{STRAY}{LINKS}<article><p>Short.</p>{LINKS}<p>End.</p></article>{STRAY}{LINKS}", ["Short.", *(f"Another story of the week, number {i}" for i in range(5)), "End."]),
        (f"<body>{LINKS}", [f"Another story of the week, number {i}" for i in range(5)]),
    ],
)
def test_the_distribution_decides(page, expected):
    """Surge and dive choose the lines; without them, all that is no furniture would stay."""
    assert html_extract.main_text(page).split("\n") == expected
    texts, inside = html_extract.page_lines(page)
    assert "".join(texts) != "".join(expected) or page == f"<body>{LINKS}"


def test_regions():
    assert html_extract.blocks([1, 2, 3, 4]) == [6, 9, 7, 4]
    assert html_extract.regions([5, 5, 5, 5, 90, 10, 0, 1, 0, 0, 0, 3, 200]) == [(2, 8), (11, 13)]
    assert html_extract.regions([9, 0, 0, 0, 2]) == [(0, 1)] and html_extract.regions([0, 0]) == [] and html_extract.regions([]) == []


def test_driver_pages_without_any_marks(spark):
    """Tags and classes that tell article from furniture taken away: the distribution alone keeps the article and drops the menu."""
    kept = lost = menu = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = r.html.replace(' class="ad"', "")
        for tag in ("article", "nav", "footer"):
            page = page.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        found = set(html_extract.main_text(page).split("\n"))
        blocks = Article(r.html).blocks
        kept += len([x for x in blocks if x in found])
        lost += len([x for x in blocks if x not in found])
        links = r.html.split("<nav>")[1].split("</nav>")[0].split("</a>")[:-1]
        menu += len([x for x in links if x.rsplit(">", 1)[1] in found - set(blocks)])
    assert lost == 0 and kept > 1000 and menu == 0


COMMENTS = f'<section class="comments"><article><p>{PROSE[0]} I disagree with all of it.</p></article></section>'


@pytest.mark.parametrize(
    "page, expected",
    [
        *[(f'<body>{FURNITURE}<div class="{c}"><article>{BODY}{COMMENTS}</article>{AD}</div>{FOOT}', PROSE) for c in ("has-sidebar", "no-sidebar", "with-sidebar wide", "header", "sidebar", "page sidebar_left")],
        *[(f'<body>{FURNITURE}<div id="content-sidebar-wrap"><{t}>{BODY}</{t}><div class="sidebar">Others</div></div>{FOOT}', PROSE) for t in ("article", "main", "div")],
        *[(f'<body><form id="f" action="/">{FURNITURE}<{t}>{BODY}{COMMENTS}</{t}>{AD}</form><p>Skip</p>', want) for t, want in (("article", PROSE), ("main", PROSE), ("div", [*PROSE, "Skip"]))],
        (f'<main><form>{BODY}</form></main>', PROSE),
        (f'<form><article>{BODY}</article>{AD}<article><p>{PROSE[0]}</p></article></form>', [*PROSE, PROSE[0]]),
        (f'<form><div>{BODY}{COMMENTS}</div><div class="sidebar"><article>A card</article></div></form>', PROSE),
        (f'<div class="sidebar"><article>A card</article></div><form>{BODY}</form>', PROSE),
        (f'<body><div class="search"><div class="menu"><div>{BODY}</div></div></div>', PROSE),
        (f"<body>{BODY}{COMMENTS}", PROSE),
        (f'<body>{BODY}<div class="sidebar"><article>A card</article><p>Other stories</p></div>', PROSE),
        (f"<article>{BODY}</article>{COMMENTS * 5}", PROSE),
        (f'<p>One <span class="share">Share it</span> two</p><div class="site-footer">Foot</div><div class="comment-list">Me</div>', ["One two"]),
        ('<div id="app"></div><div class="cookie-notice">We use cookies, accept them.</div>', [""]),
    ],
)
def test_wrappers_of_the_article(page, expected):
    assert html_extract.main_text(page).split("\n") == expected


def test_many_wrapped_articles():
    page = f"<div>{BODY}</div>" + f'<div class="comment"><article><p>{PROSE[0]}</p></article></div>' * 3000
    assert html_extract.main_text(page).split("\n") == PROSE
