"""Extraction on hand-written layouts, odd markup and a host's consensus."""

import pytest

from meshscope.llm import html_extract as h
from pyspark.sql import types as T

PAGES = "page_id long, url string, html string, row string, winners string"


def text(source, winners=()):
    return h.Page(source).text(list(winners))


LONG = "Enough running text to make this the article of the page, said the author."


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<article><h1>T&amp;T &#233;</h1><p>a \n b&nbsp;c<p>{LONG}</article>", f"T&T é\n\na b c\n\n{LONG}"),
        (f"<nav>menu</nav><header>top</header><article><p>{LONG}</p></article><footer>end</footer>", LONG),
        (f"<body><div class='cookie-notice'>we use cookies</div><main><p>{LONG}</main><aside>more</aside>", LONG),
        (f"<article><p>{LONG}</p><form><p>subscribe</p></form><script>'<p>x</p>'</script><style>p{{}}</style></article>", LONG),
        (f"<article><p>{LONG}</p><div class='ad'>Buy</div><section id=comments><p>{LONG} {LONG} {LONG}</p></section></article>", LONG),
        (f"<article><p>{LONG}</p><!-- <p>no</p> --><article class='comment'><p>{LONG * 3}</p></article></article>", LONG),
        (f"<article><p><b>{LONG}<br><p>next</p></article></body>", f"{LONG}\n\nnext"),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{LONG}", f"one\n\ntwo\n\na\n\nb\n\n{LONG}"),
        (f"<div class='has-sidebar'><div class='post-body'><p>{LONG}</p></div></div>", LONG),
        (f"<p>{LONG} 1 < 2 &lt;b&gt; <i>x</i>y</p>", f"{LONG} 1 < 2 <b> xy"),
        (f"<article><p title='a > b'>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></article>", LONG),
        (f"<article><p>{LONG}</p><textarea>no</textarea><iframe>no</iframe><noscript>no</noscript></article>", LONG),
        (f"<div class='sidebar'><p>{LONG}</p></div>", LONG),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<p", ""),
        ("<script>never closed <p>x</p>", ""),
        ("plain", "plain"),
    ],
)
def test_page(source, want):
    assert text(source) == want


def test_deep_nesting_ends():
    source = "<div>" * 3000 + LONG + "</div>" * 10
    assert text(source) == LONG


def test_host_consensus(spark):
    def page(body, extra):
        return f"<html><body><div class='story-1'><p>{body}</p></div><div class='x7 teaserlist'>{extra}</div></body></html>"

    rows = [(k, "http://A.example/x", page(f"{LONG} {k}", "<p>see also</p>"), "r", "w") for k in range(8)]
    # on one page the other container has more text; the host's path wins
    rows.append((100, "https://a.example?q", page(f"{LONG} 100", f"<p>{LONG} {LONG}</p>"), "r", "w"))
    rows += [
        (200, None, None, None, None),
        (201, "no scheme", "", None, None),
        (None, "http://b.example", f"<article>{LONG}</article>", None, None),
        (0, "http://A.example/x", page(f"{LONG} 0", "<p>see also</p>"), "r", "w"),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    found = {(r["row"]["page_id"]): r for r in h.extract(pages).collect()}
    assert found[100]["text"] == f"{LONG} 100"
    assert found[3]["text"] == f"{LONG} 3" and found[3]["n_chars"] == len(found[3]["text"])
    assert found[200]["text"] == found[201]["text"] == "" and found[None]["text"] == LONG
    assert h.extract(pages).count() == len(rows)
    assert h.extract(pages).schema["row"].dataType == T.StructType(pages.schema.fields)
    best = {r["host"]: r["path"] for r in h.host_paths(pages).filter("place = 1").collect()}
    assert best["a.example"] == "html>body>div.story-#"


@pytest.mark.parametrize("parts", [2, 3, 4, 7])
def test_split_article_on_a_host_of_whole_ones(parts):
    whole = f"<body><main><article class='body-1'><p>{LONG}</p></article></main></body>"
    votes = h.Page(whole).votes()
    winners = sorted(votes, key=lambda p: -votes[p])
    assert winners[0].endswith("article.body-#")
    chapters = [f"{LONG} Chapter {k}." for k in range(parts)]
    split = "<div class='ad'>Buy</div>".join(f"<article class='body-{k}'><p>{c}</p></article>" for k, c in enumerate(chapters))
    source = f"<body><main>{split}</main></body>"
    assert text(source, winners) == "\n\n".join(chapters)
    assert text(source) == "\n\n".join(chapters)


def test_split_article_without_main():
    source = f"<body><article><p>{LONG} {LONG}</p></article><p>x</p><article><p>{LONG}</p></article></body>"
    assert text(source) == f"{LONG} {LONG}\n\n{LONG}"


def test_menu_on_the_path_of_the_article():
    source = f"<body><div><a href=/a>One</a> <a href=/b>Two</a></div><div><p>{LONG}</p></div><div><p>{LONG} 2</p></div></body>"
    assert text(source, ["html>body>div"]) == f"{LONG}\n\n{LONG} 2"


BOOKS = [f"A long title of a book, number {k}" for k in range(9)]
LINKED = "".join(f"<p><a href='/b{k}'>{b}</a></p>" for k, b in enumerate(BOOKS))


@pytest.mark.parametrize("after", ["<div></div>", "<div>Contact us</div>", ""])
def test_article_of_links(after):
    source = f"<body><article>{LINKED}</article>{after}</body>"
    assert text(source, ["html>body>article"]) == "\n\n".join(BOOKS)
    assert text(source) == "\n\n".join(BOOKS)


def test_anchors_are_no_links():
    named = f"<body><article><p><a name=top>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><div>Contact us today</div></body>"
    assert text(named) == "\n\n".join([LONG] * 3)
    unclosed = f"<body><article><p><a href=/x>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><div>Contact us today</div></body>"
    assert text(unclosed) == "\n\n".join([LONG] * 3)
    around = h.Page(f"<body><a href=/x><div><h3>A title</h3><p>{LONG}</p></div></a><p>{LONG}</p></body>")
    assert around.containers[0][2] == len("A title") + len(LONG)


@pytest.mark.parametrize(
    "part",
    [
        "<section id='discussion'><p>part</p></section>",
        "<section id='related-work' class='level2'><p>part</p></section>",
        "<div id='tags'><p>part</p></div>",
        "<p id='notice'>part</p>",
        "<p><span id='disclaimer'>part</span></p>",
        "<h2 id='share-prices'>part</h2>",
        "<h2><span id='Search'>part</span></h2>",
        "<h3 id='comments'>part</h3>",
        "<h3><span id='Comments'>part</span></h3>",
    ],
)
def test_topics_as_ids(part):
    assert text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n\npart\n\n{LONG}"
    if not part.startswith("<div"):
        assert text(f"<body><p>{LONG}</p>{part}<p>{LONG}</p></body>") == f"{LONG}\n\npart\n\n{LONG}"


@pytest.mark.parametrize(
    "part",
    [
        "<section id='comments'><p>no</p></section>",
        "<ol><li id='comment-12'>no</ol>",
        "<div id='Related_Posts'><p>no</p></div>",
        "<section class='discussion'><p>no</p></section>",
        "<div role='search'><p>no</p></div>",
    ],
)
def test_known_parts_are_left_out(part):
    assert text(f"<article><p>{LONG}</p>{part}</article>") == LONG
    assert text(f"<body><div id='share'>no</div><article><p>{LONG}</p></article></body>") == LONG


def test_topic_id_of_a_div_section():
    part = "<div class='section' id='related-work'><p>part</p></div>"
    assert text(f"<body><div><p>{LONG}</p>{part}</div></body>") == f"{LONG}\n\npart"


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0
