import pytest

from wordwood.llm import html
from wordwood.llm.html import main_text

P1 = "First paragraph, with a comma, and some more words to make it long enough to score."
P2 = "Second paragraph that goes on, and on, for quite a while until the sentence is over."


def page(body, head="<title>Title</title><style>p{}</style><script>var t='</p><p>no</p>';</script>"):
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">{head}</head><body>{body}</body></html>'


CASES = {
    "plain article": (page(f"<article><h1>Head</h1><p>{P1}</p><p>{P2}</p></article>"), f"Head\n{P1}\n{P2}"),
    "what is around it": (
        page(
            '<header><p>Site, name</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x -->'
            f'<div class="ad">Buy, now, please</div><article><p>{P1}</p><p>{P2}</p></article>'
            '<aside>Other, things</aside><form><p>Your mail</p><input name="q"></form>'
            '<div class="cookie-notice"><p>We use, many, cookies</p></div>'
            '<section id="comments"><p>Nice, really nice, article, thanks</p></section>'
            "<footer>&copy; all &middot; rights</footer>"
        ),
        f"{P1}\n{P2}",
    ),
    "open tags": (
        page(f"<article><p><b>{P1}<br><p>{P2}</p><p><b>Third.<br><p>Fourth</p></article><footer>x"),
        f"{P1}\n{P2}\nThird.\nFourth",
    ),
    "no article element": (
        page(f'<div id="menu">M</div><div class="content"><p>{P1}</p><p>{P2}</p></div><div>short</div>'),
        f"{P1}\n{P2}",
    ),
    "sections of an article": (
        page(f"<article><section><p>{P1}</p></section><section><p>{P2}</p><p>Z.</p></section></article>"),
        f"{P1}\n{P2}\nZ.",
    ),
    "inside the article": (
        page(
            f'<article><p>{P1}</p><div class="share-buttons"><a href="x">Tweet</a></div>'
            f'<ul><li>one</li><li>two<li>three</ul><div class="comments"><p>Hi</p></div><p>{P2}</p></article>'
        ),
        f"{P1}\none\ntwo\nthree\n{P2}",
    ),
    "references and white space": (
        page("<article><p>a &amp; b &lt;c&gt;\n\t d&nbsp;e &#233;&#x20AC; &unknown; x&lt</p></article>"),
        "a & b <c> d e é€ &unknown; x<",
    ),
    "headings beside it": (
        page(f'<h1>Head</h1><div class="post"><p>{P1}</p><p>{P2}</p></div>'), f"Head\n{P1}\n{P2}",
    ),
    "class names that only sound so": (
        page(f'<div class="post-with-sidebar"><div class="radius gradient heading"><p>{P1}</p></div></div>'),
        P1,
    ),
    "table": (page(f"<article><p>{P1}</p><table><tr><td>a<td>b<tr><td>c</table></article>"), f"{P1}\na\nb\nc"),
    "hidden": (page(f'<article><p>{P1}</p><p hidden>no</p><p style="display: none">no</p></article>'), P1),
    "quotes in tags": (page(f'<article><p title="a > b" data-x=\'<p>\'>{P1}</p></article>'), P1),
    "cut off": (f"<html><body><article><p>{P1}</p><p>{P2} and <a hre", f"{P1}\n{P2} and"),
    "script to the end": (f"<article><p>{P1}</p><script>var a = '<p>no</p>';", P1),
    "comment to the end": (f"<article><p>{P1}</p><!-- <p>no</p>", P1),
    "text only": ("just, some text < 5 & more", "just, some text < 5 & more"),
    "menus only": (page("<nav><a href='x'>x</a></nav><footer>y</footer>"), ""),
    "nothing": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html_, want = CASES[name]
    assert main_text(html_) == want


@pytest.mark.parametrize("bad", ["<a \"" * 3000, "<" * 50_000, "<p " * 20_000, "<div>" * 5000, "&" * 50_000])
def test_odd_markup_takes_no_long(bad):
    main_text(bad)


def test_long_pages_are_read_whole():
    paragraphs = [f"Paragraph {i}, with words." for i in range(3000)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    assert main_text(page(f"<article>{body}</article>")) == "\n".join(paragraphs)


def test_extract_pages(spark):
    rows = [(1, "u", CASES["plain article"][0]), (1, "u", CASES["plain article"][0]), (None, None, None)]
    rows += [(2, "v", ""), (3, None, "<p>\U0001f600 é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.selectExpr("*", "'clash' AS text", "0 AS n_chars")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html.extract_pages(df).collect())
    want = CASES["plain article"][1]
    assert got == [
        ("1", "u", want, len(want)), ("1", "u", want, len(want)), ("2", "v", "", 0),
        ("3", "None", "\U0001f600 é", 3), ("None", "None", "", 0),
    ]
    assert html.extract_pages(df.limit(0)).collect() == []


def test_the_given_pages(spark, sf_dir):
    """The pages of the tables hold their article in paragraphs that can be found plainly."""
    import re
    from html import unescape

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html.extract_pages(df).join(df.select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split("</?(?:p|h1)>", inside)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)


NAMES = [
    "social-science", "product-related", "widget-content", "hidden-xs", "notice-of-award", "header-image-post",
    "comment-policy-article", "article-header",
]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_does_not_lose_the_only_text(name):
    text = "A sentence of the article, long enough to be one, with commas. " * 5
    page = f"<html><body><nav>Home</nav><div class='{name}'><p>{text}</p></div><footer>End</footer></body></html>"
    assert html.main_text(page) == text.strip()


@pytest.mark.parametrize("size", [8_000, 8_193, 1_000_000])
def test_long_attributes_do_not_leak(size):
    page = f'<div><p title="{"a" * size} > LEAK, leak">Some text, here.</p><p>More text, there.</p></div>'
    assert html.main_text(page) == "Some text, here.\nMore text, there."


def test_quotes_that_are_none():
    assert html.main_text("<p class=a'b>It's one, \"two\".</p><p x = 'q > r'>Three.</p>") == "It's one, \"two\".\nThree."
    assert html.main_text("<p title='open>Text, more.</p>") == "Text, more."
    assert html.main_text("<p>a < b and c <d or e.</p><p>two</p>").startswith("a < b and c")
    assert html.main_text("<p>Text, all of it.</p><b unfinished") == "Text, all of it."


def test_many_open_quotes_take_linear_time():
    page = "<p>Text, here.</p>" + "<a href='x " * 20_000
    assert html.main_text(page).startswith("Text, here.")
