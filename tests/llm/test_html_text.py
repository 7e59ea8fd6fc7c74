import random

import pytest

from linewright.llm import html_text

LONG = " ".join(["The paragraph of this page goes on for some time."] * 8)

CASES = [
    (None, ""),
    ("", ""),
    ("plain   text\n here", "plain text here"),
    ("<nav>x", ""),
    ("<p>Hello <b>w</b>orld&nbsp;&amp; co&#33;<p>second<br>line", "Hello world & co!\nsecond line"),
    ("<article><h1>T</h1><p><b>Open<br><p>Next</article><footer>&copy; us</footer>", "T\nOpen\nNext"),
    (
        "<div class='sidebar'><a href=x>menu</a></div><div id=content><p>Long text of the page, that goes on and on until "
        "it is long enough to matter.</p><p>Be.</p></div><div class='cookie-notice'>We use cookies</div><form>Name <input></form>",
        "Long text of the page, that goes on and on until it is long enough to matter.\nBe.",
    ),
    (
        "<form id=aspnet><nav>a b</nav><article><header><h1>T</h1></header><p>x</p><div class=ad>Buy</div><p>y</p>"
        "<section id=comments><article class=comment>bad</article></section></article></form>",
        "T\nx\ny",
    ),
    ("<header><h1>Site</h1></header><article>kept</article>", "kept"),
    ("<script>if (a<b) {'</p>'}</script><style>p{}</style><!-- <p>no --><p>ok", "ok"),
    ("<body><nav><ul><li>a</li></ul><article><p>kept</p></article>", "kept"),
    ("<main class='has-sidebar'><p>Q</p></main><aside>no</aside>", "Q"),
    ("<p title='a>b'>in</p>", "in"),
    ("<p title='broken>text</p><p>next</p>", "text\nnext"),
    ("x < y and z > w", "x < y and z > w"),
    ("<article><p>Erinst resh.</p></article><div>Some other text that is much longer than the article itself.</div>", "Erinst resh."),
    ("<ARTICLE><P>Upper</P></ARTICLE><DIV ROLE='navigation'>menu</DIV>", "Upper"),
    ("<article><p>a</p><p hidden>b</p><p style='display: none'>c</p><p>d</p></article>", "a\nd"),
    ("<article>cut &am", "cut &am"),
    ("<div class='post-content'><p>Long enough to be most of the page.</p><div class=ad>Buy</div><p>Be.</p></div><div>(c) us</div>", "Long enough to be most of the page.\nBe."),
    ("<div class=entry>a</div><div>" + "The text stands elsewhere on this page. " * 3 + "</div>", "a\n" + ("The text stands elsewhere on this page. " * 3).strip()),
    ("<div role=main><header><h1>T</h1></header>x</div><div>other</div>", "T\nx"),
    # a mark on what wraps the article
    (f"<div class='layout sidebar-right'><div id=content><p>{LONG}</p></div></div>", LONG),
    (f"<div class=no-sidebar><p>{LONG}</p></div><div class=promo>Buy</div>", LONG),
    (f"<form id=aspnetForm><p>{LONG}</p></form>", LONG),
    (f"<div class=commentary><p>{LONG}</p></div>", LONG),
    (f"<main><div class=no-sidebar><div id=content><p>{LONG}</p></div></div></main><div class=sidebar>{LONG * 4}</div>", LONG),
    # which container holds the article
    (f"<main><h1>Head</h1><p>{LONG}</p><article><p>teaser</p></article></main>", f"Head\n{LONG}\nteaser"),
    (f"<article><p>{LONG}</p></article><div class=related-posts><article><p>teaser</p></article></div>", LONG),
    # linked lines of an article
    (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f"<article><p>{LONG}</p><ul>" + "<li><a href=x>ref</a>" * 5 + "</ul></article>", "\n".join([LONG] + ["ref"] * 5)),
    # ids made from headings
    (
        "<article><h2 id=search-methods>Search methods</h2><p>a</p><section id=related-work><h2>R</h2><p>b</p></section>"
        "<section id=social-impact><p id=notice-of-change>c</p></section></article>",
        "Search methods\na\nR\nb\nc",
    ),
    # marks that hold more than the article, beside it
    (f"<main><p>short one</p><section class=comments><p>{LONG * 3}</p></section></main>", "short one"),
    (f"<div class=entry><p>{LONG[:90]}</p></div><div class=sidebar><p>{LONG * 3}</p></div>", LONG[:90].strip()),
    (f"<p>{LONG[:90]}</p><div class=comments-area><p>{LONG * 3}</p></div><section id=comments><p>{LONG}</p></section>", LONG[:90].strip()),
    (f"<article><p>{LONG[:90]}</p><section class=related-posts><p>{LONG}</p></section><p class=advert>Buy</p></article>", LONG[:90].strip()),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_article_comes_back_whole():
    draw = random.Random(3)
    for _ in range(50):
        lines = [" ".join("word" * draw.randint(1, 3) for _ in range(draw.randint(1, 30))) for _ in range(draw.randint(1, 12))]
        article = "".join(draw.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}</b></p>"]).format(x) for x in lines)
        page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=a>b</a></ul></nav><div class='ad'>buy</div><article>{article}</article><footer>f</footer>"
        assert html_text.main_text(page) == "\n".join(lines)


WRAPPERS = [
    ("<div class='layout sidebar-right'>", "</div>"),
    ("<div class=no-sidebar>", "</div>"),
    ("<form id=aspnetForm>", "</form>"),
    ("<div class=header-offset>", "</div>"),
    ("<div id=page><div class='has-cookie-notice'>", "</div></div>"),
    ("<main class=comments-enabled>", "</main>"),
    ("<article>", "</article>"),
    ("<div id=content>", "</div>"),
]
NOISE = [
    "<nav><ul><li><a href=a>b</a></ul></nav>",
    "<div class=ad>buy this now</div>",
    "<aside><p>a few words at the side</p></aside>",
    "<div class=cookie-notice><p>we use cookies here</p></div>",
    "<section id=comments><p>I do not agree with any of this at all, and I say so.</p></section>",
    "<footer>all rights reserved</footer>",
    "<script>var a = '<p>no</p>';</script>",
]


def test_wrapped_articles_come_back_whole():
    draw = random.Random(5)
    for _ in range(300):
        lines = [" ".join("word" * draw.randint(1, 3) for _ in range(draw.randint(30, 60))) for _ in range(draw.randint(3, 10))]
        page = "".join(f"<p>{x}</p>" for x in lines)
        for start, end in draw.sample(WRAPPERS, draw.randint(1, 4)):
            page = start + page + end
        page = "".join(draw.sample(NOISE, 3)) + page + "".join(draw.sample(NOISE, 3))
        assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n".join(lines), page


def test_very_long_page():
    lines = [f"line {i} of a very long page that has no end in sight" for i in range(60_000)]
    page = "<div class=no-sidebar>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"
    assert html_text.main_text(page) == "\n".join(lines)


def test_broken_markup_stays_linear():
    for part in ("<div class=\"a'", "<p><b>", "<div class=sidebar>", "<title>", "<a", "<!", "<nav><article>", "<a href=x>y", "&", "<"):
        html_text.main_text(part * 20_000)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", "<p>some text</p>", "clash"), (1, "u", "<p>some text</p>", "clash"), (None, None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "u", "some text", 9)] * 2 + [(None, None, "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
