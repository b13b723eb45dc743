"""Main text: page structure and repeated runs, against plain forms of both."""

import html
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from lanelytics.llm import main_text
from lanelytics.llm.common import table


def test_pages_of_the_tables(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in main_text.main_text(pages).collect()}
    for page_id, url, page in pages.select("page_id", "url", "html").collect():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(p for p in parts if p)
        assert got.pop(page_id) == (url, text, len(text))
    assert not got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=5), st.sampled_from([2, 4, 8]))
def test_repeated_runs(pages, run):
    words = np.array([w for p in pages for w in p], int)
    page = np.array([n for n, p in enumerate(pages) for _ in p], int)
    runs = {}
    for n, p in enumerate(pages):
        for i in range(len(p) - run + 1):
            runs.setdefault(tuple(p[i : i + run]), set()).add(n)
    expected = []
    for p in pages:
        marks = [False] * len(p)
        for i in range(len(p) - run + 1):
            if len(runs[tuple(p[i : i + run])]) > 1:
                marks[i : i + run] = [True] * run
        expected += marks
    assert main_text.repeated_runs(words, page, run).tolist() == expected


def texts(page):
    return [text for zone, text in main_text.blocks(page) if zone]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body class="with-sidebar"><header>Site</header><nav><a>Home</a></nav><!-- <p>no</p> -->
    <main><article class="post"><header><h1>Head &amp; line</h1></header><p>One<br>two <b>th</b>ree<p>Four &lt;b&gt; &eacute;
    <ul><li>item 1<li>item 2</ul><div class="share-buttons">Share</div><aside>side</aside>
    <table><tr><td>a<td>b</table><section id="comments"><p>nice!</p></section><p class='Notice'>cookies</p>
    <form><input value="x > y"><button>Send</button></form><div hidden>gone</div></article></main>
    <div class="ad">Buy</div><footer>&copy; site</footer></body></html>"""
    assert texts(page) == ["Head & line", "One two three", "Four <b> é", "item 1", "item 2", "a", "b"]
    assert [z for z, _ in main_text.blocks(page) if z] == [main_text.ARTICLE] * 7


def test_broken_pages():
    assert texts("") == [] and texts("<p") == [] and texts("a < b & c") == ["a < b & c"]
    assert texts("<p>cut <b>off &am") == ["cut off &am"]
    assert texts('<p title="never closed>text') == ["text"]
    assert texts("<script>never closed") == [] and texts("<!-- never closed") == []
    assert texts("</div></p>x</article>y") == ["x", "y"]
    assert texts("<div><p>a</div>b") == ["a", "b"]
    assert len(texts("<p>x" * 20_000)) == 20_000


BOILER = "Welcome to our site where you find all the news of the day"


def test_repeats_go_and_unique_runs_stay():
    page = lambda n: [(1, BOILER), (1, "Menu"), (1, f"{BOILER} with number{n} alone at{n} the{n} end{n}"), (1, f"Story {n} told")]
    got = main_text.unique_text([page(n) for n in range(4)])
    assert got == [f"number{n} alone at{n} the{n} end{n}\nStory {n} told" for n in range(4)]
    assert main_text.unique_text([page(0)] * 3) == ["\n".join(t for _, t in page(0))] * 3  # copies are one page
    quoted = [[(2, BOILER), (1, f"x{n}")] for n in range(3)]
    assert main_text.unique_text(quoted) == [BOILER] * 3


def test_rows_of_any_kind(spark, monkeypatch):
    article = f"<article><p>{'long text here ' * 20_000}</p></article>"
    rows = [(1, "http://a.example/x", None), (2, None, article), (None, "http://a.example/x", "<p>ü&nbsp;x</p>"), (None, "http://a.example/x", "<p>ü&nbsp;x</p>"), (3, "no url", ""), (4, "HTTP://A.example/y?q", "<p> \n </p>")]
    schema = "page_id long, url string, html string, host string, shard int, text string, zones string"
    frame = spark.createDataFrame([(*r, "x", 1, "x", "x") for r in rows], schema)
    got = sorted(map(tuple, main_text.main_text(frame).collect()), key=str)
    long_text = ("long text here " * 20_000).strip()
    wanted = [(1, rows[0][1], "", 0), (2, None, long_text, len(long_text)), (3, "no url", "", 0), (4, rows[5][1], "", 0)]
    assert got == sorted(wanted + [(None, rows[2][1], "ü x", 3)] * 2, key=str)
    assert main_text.main_text(frame.limit(0)).count() == 0
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    whole = main_text.main_text(pages).collect()
    monkeypatch.setattr(main_text, "PAGES", 2)
    for hosts in (50_000, 0):
        monkeypatch.setattr(main_text, "BROADCAST_HOSTS", hosts)
        assert sorted(map(tuple, main_text.main_text(pages).collect())) == sorted(map(tuple, whole))


LINKS = "More stories of the week that other readers also liked today"


def test_repeats_decide_beside_and_inside_articles():
    page = lambda n: [
        (main_text.OPEN, f"An opening written for page number{n} alone and only here"),
        (main_text.ARTICLE, f"Story {n}"),
        (main_text.ARTICLE, BOILER),
        (main_text.ARTICLE_LINKS, LINKS),
        (main_text.ARTICLE_LINKS, f"unique{n} link"),
        (main_text.OPEN, BOILER),
    ]
    opening = lambda n: f"An opening written for page number{n} alone and only here"
    got = main_text.unique_text([page(n) for n in range(3)])
    assert got == [f"{opening(n)}\nStory {n}\n{BOILER}\nunique{n} link" for n in range(3)]
    assert main_text.unique_text([page(0)]) == [f"Story 0\n{BOILER}\n{LINKS}\nunique0 link"]  # nothing to compare with


def test_pages_without_article():
    quoted = " ".join(f"q{k}" for k in range(main_text.PASSAGE))
    text = lambda n, part: " ".join(f"{part}{n}x{k}" for k in range(12))
    page = lambda n: f"""<body><p>{quoted}<p>{text(n, "a")}<p>{quoted}<div><a href=1>Go on</a></div>
        <p>{text(n, "b")}<div>{"Twice" if n < 2 else f"Once {n}"}</div><p>{text(n, "c")}<div>{BOILER}</div></body>"""  # noqa: E731
    got = main_text.unique_text([main_text.blocks(page(n)) for n in range(3)])
    assert got == ["\n".join([text(n, "a"), quoted, text(n, "b"), "Twice" if n < 2 else f"Once {n}", text(n, "c")]) for n in range(3)]
    two = main_text.unique_text([main_text.blocks(page(n)) for n in range(2)])
    assert all("Go on" not in t and "Twice" in t for t in two)


def test_links_are_told_apart():
    page = "<article><p>See <a href=x>this</a> for a longer account of it</p><ul><li><a>One &amp; two</a></ul></article><p><a>x</a>"
    assert main_text.blocks(page) == [(2, "See this for a longer account of it"), (4, "One & two"), (3, "x")]


def test_a_text_does_not_depend_on_the_size_of_its_host(spark, monkeypatch):
    part = lambda n, name, words: " ".join(f"{name}{n}x{k}" for k in range(words))
    page = lambda n: f"""<p>{part(n, "a", 12)}<div>Menu</div><p>{part(n // 2, "twice", 9)}<p>{part(n, "b", 12)}
        <div>{"Thrice" if n < 3 else f"Once {n}"}</div><p>{part(n, "c", 12)}<div>{"Two" if n < 2 else f"One {n}"}</div>"""  # noqa: E731
    rows = [(n, f"http://a.example/{n}", page(n)) for n in range(40)] + [(100 + n, "http://a.example/copy", page(0)) for n in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(main_text, "HASHES", 100)
    whole = sorted(map(tuple, main_text.main_text(frame).collect()))
    texts = {r[0]: r[2].split("\n") for r in whole}
    assert texts[1] == [part(1, "a", 12), part(1, "b", 12), part(1, "c", 12), "Two"] and texts[39][2] == "Once 39"
    monkeypatch.setattr(main_text, "PAGES", 2)
    assert sorted(map(tuple, main_text.main_text(frame).collect())) == whole


def test_names_within_an_article():
    """A name drops a part of an article only if all it says is what no article holds."""
    page = (
        '<article><p>Start of it.</p><div class="share-price">Shares rose.</div><div id="search-results-study">A study.</div>'
        '<div class="notice-of-award">Awarded to them.</div><div class="share-bar">Share this</div><div class="adBox">Buy it</div>'
        '<div class="post comment-list">Reader says</div><div class=related>More</div><p class="lead text">End of it.</p></article>'
        '<div class="share-price">Outside</div>'
    )
    texts = [text for zone, text in main_text.blocks(page) if zone == main_text.ARTICLE]
    assert texts == ["Start of it.", "Shares rose.", "A study.", "Awarded to them.", "End of it."]
    assert (main_text.DROPPED, "Outside") in main_text.blocks(page)
