import html
import re

import pytest

from answerloom.llm.html_extract import extract, main_text, page_lines, smoothed
from cases import PROSE, SMALL


def plain_article(page):
    """The article element of the given pages, by pattern."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    body = re.sub(r"<[^>]*$", "", found[1]) if found else ""
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"] or "") for r in pages.collect()}
    got = extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


SITE = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
<header><h1>Site name</h1><p>{PROSE}</p></header><ul class="main-menu"><li><a href=/a>Home</a><li><a href=/b>News &amp; more</a></ul>
<div class="cookie-notice"><p>We use cookies. {PROSE}</p></div>
<div id="content"><h2>A&nbsp;title &lt;here&gt;</h2><p>{PROSE}<p>Short.<table><tr><td>cell one<td>cell two</table><pre>two
  lines</pre><script>var x = "<p>no</p>";</script><form><p>Name</p><input></form><p>Last {PROSE}</div>
<aside><p>{PROSE}</p></aside><section id=comments><p>{PROSE} says a reader</p></section><div class="sidebar">{PROSE}</div><footer><p>{PROSE}</p></footer></body></html>"""


def test_page_without_article_element():
    text = main_text(SITE)[0]
    assert text.split("\n")[0] == "A title <here>" and text.endswith(f"Last {PROSE}") and "\nShort.\n" in text and "two lines" in text
    assert not re.search("cookies|reader|Home|Name|Site|var x", text) and text.count(PROSE) == 2


def test_table_cells_and_sibling_divs_are_kept():
    assert "\ncell one\ncell two\n" in main_text(SITE)[0]
    parts = [f"Part {i}. {PROSE}" for i in range(10)]
    menu, foot = "<div><a href=/a>Home</a> <a href=/b>News</a></div>", "<div><a href=/c>Imprint of the site</a></div>"
    divs = "".join(f"<div>{p}</div>" for p in parts)
    for page in (divs, f"<body>{divs}</body>", f"<body>{menu}<div id=content>{divs}</div>{foot}</body>", f"<body>{menu}{divs}{foot}</body>"):
        assert main_text(page)[0] == "\n".join(parts)
    short = f"<div id=content><h2><a href=/t>A title</a></h2><div><p>{PROSE}<p>{PROSE}</div><div>Short one.</div><div><p>{PROSE}<p>{PROSE}</div><div>The end.</div></div>"
    assert main_text(f"<body>{menu}{short}{foot}</body>")[0] == "\n".join(["A title", PROSE, PROSE, "Short one.", PROSE, PROSE, "The end."])
    table = f"<div id=content><p>{PROSE}</p><table><tr><th>Head<th>Row<tr><td>1<td><a href=/x>x</a><tr><td>2<td>y</table></div>"
    assert main_text(f"<body>{menu}{table}{foot}</body>")[0] == "\n".join([PROSE, *"Head Row 1 x 2 y".split()])
    assert main_text("<article><p>one</p></article><article><p>two two two</p></article>" * 4)[0] == "\n".join(["one", "two two two"] * 4)


def test_wrappers_named_like_boilerplate_do_not_empty_the_page():
    body = f"<article><h1>A title</h1><p>{PROSE}</p><p>Short.</p></article>"
    rest = f'<div class="sidebar"><p>{PROSE}</p></div><section id="comments"><article><p>{PROSE} says a reader</p></article></section>'
    want = f"A title\n{PROSE}\nShort."
    wrappers = ["class='has-sidebar'", "class='content with-sidebar'", "class='page no-banner'", "class='wrapper social-share-on'", "id='main_menu'", "class='banner'"]
    for start, end in [*((f"<div {w}>", "</div>") for w in wrappers), ("<form>", "</form>"), ("<form><div class='page-widget'>", "</div></form>")]:
        assert main_text(f"<body>{start}{body}{rest}{end}</body>")[0] == want, start
        assert main_text(f"<body>{start}{body}{end}{rest}</body>")[0] == want, start
        assert main_text(f"<body><p>Name of the site</p>{start}{body.replace('article', 'div')}{rest}{end}</body>")[0].endswith(want), start
    assert main_text(f"<body>{body}<form><p>{PROSE}</p><p>{PROSE}</p></form>{rest * 9}</body>")[0] == want
    assert main_text("<div class='cookie-notice'>We use cookies.</div><div class='ad'>Buy now.</div>")[0] == ""


def test_inline_markup_and_breaks_stay_in_their_block():
    assert main_text("<article><p>a<b>b</b> c <i>d\n e</i><br>f</p>g</article>")[0] == "ab c d e f\ng"


def test_cut_pages():
    assert main_text("<article><p>one two &am")[0] == "one two &am"
    assert main_text("<article><p>one two &amp")[0] == "one two &"
    assert main_text("<article><p>one two</p><p cla")[0] == "one two"
    assert main_text("<article><p>one two</p")[0] == "one two"
    assert main_text("<article><p>a < b and 3 <4 end</p>")[0] == "a < b and 3 <4 end"
    assert main_text("<script>never closed <p>x</p>")[0] == ""


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x</p>"), (3, None, "no tags at all"), (4, "u", "<nav><a>menu</a></nav>"), (4, "u", "<nav><a>menu</a></nav>"),
            (5, "u", "<article><p>" + "word " * 60_000 + "</article>"), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "u", "</p></div></b><p>late</a></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "'z' AS n_chars", "'z' AS Lines")
    got = sorted((r["page_id"] or 0, r["text"][:20], r["n_chars"]) for r in extract(pages).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "no tags at all", 14), (4, "", 0), (4, "", 0), (5, "word " * 4, 299_999), (6, "deep", 4), (7, "late", 4)]
    assert extract(pages.limit(0)).count() == 0


def test_ratios_and_smoothing():
    import numpy as np

    lines = page_lines("<p>one <a>two</a></p><p>three</p>")
    assert [line.text() for line in lines] == ["one two", "three"] and [line.linked for line in lines] == [3, 0]
    flat = smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4.0) and smoothed(np.array([0, 0, 9.0, 0, 0]))[1] > 1 and len(smoothed(np.array([1.0]))) == 1


@pytest.mark.parametrize("wrap", ['<ol class="commentlist">{}</ol>', '<div id="commentsArea">{}</div>', '<div class="commentlist">{}</div>', '<section id="CommentSection">{}</section>',
                                  '<div class="leftSidebar">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<div itemprop="comment">{}</div>',
                                  '<div itemscope itemtype="https://schema.org/Comment">{}</div>'])
@pytest.mark.parametrize("inside", [True, False])
def test_comments_and_adverts_under_any_name_go(wrap, inside):
    extra = wrap.format("".join(f"<div><b>reader {i}</b><p>I think remark number {i} is quite wrong, if you ask me.</p></div>" for i in range(3)))
    body = "".join(f"<p>{PROSE} Part {i}.</p>" for i in range(4))
    page = f"<html><body><article><h1>Title</h1>{body}{extra if inside else ''}</article>{'' if inside else extra}</body></html>"
    text = main_text(page)[0]
    assert "remark number" not in text and all(f"Part {i}." in text for i in range(4))


@pytest.mark.parametrize("piece", ["<i>|</b>", "<!--|", "<b><div><i>|</b>", "<a |", "<|", "<!|", "&|", "</|", "<a href='|", "<p>|</p>", "<![CDATA[|", "<?|", "<!-- x -|>", "<td>|", "<a>|</a>", "<script>|", "<form><div class=menu>|"])
def test_any_markup_takes_linear_time(piece):
    import time

    head, tail = piece.split("|")
    page = f"<article><p>{PROSE}</p></article>" + head * (500_000 // len(head)) + tail * (500_000 // max(1, len(tail)))
    start = time.process_time()
    assert PROSE.split()[0] in main_text(page)[0]
    assert time.process_time() - start < 8


@pytest.mark.parametrize("tail", ["<!-- secret <p>hidden text", "<!-- secret", "<a href='secret", "<p class=secret <b secret", "<"])
def test_what_the_cut_left_open_is_no_text(tail):
    text = main_text(f"<article><p>{PROSE}</p><script>var x = '<!--';</script><p>last words of it</p>{tail}")[0]
    assert text == f"{' '.join(PROSE.split())}\nlast words of it"
