import re
from html.parser import HTMLParser

import pytest

from loomstead.llm.html_text import BLOCK, CLASSES, DROPPED, FRAME, RAW, VOID, extract, main_text

SF = "/root/testdata/sf0.01"
PAGES = [
    ("<p>One <b>bold</b>er.<br>two</p><p>Next\n line &amp; &eacute;&#33;&nbsp;x", "One bolder. two\nNext line & é! x"),
    ("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Title</h1><p>A</p><aside>no</aside><p>B</article><footer>f</footer>", "Title\nA\nB"),
    ("<main><div class='ad'>buy</div><h1>T</h1><p>x<script>var a='<p>';</script>y</p><form><p>in</p></form><div class=comments><p>me</p></div>end</main>", "T\nxy\nend"),
    ("<body class='with-sidebar'><div id='page-wrapper'><div class='cookie-notice'>We use cookies on this site for many reasons, and you should say yes to all.</div><div class='post'><h1>A heading</h1><p>" + "word " * 40 + "</p></div></div></body>", "A heading\n" + ("word " * 40).strip()),
    ("<div><ul><li><a href=1>Home page of this site</a><li><a href=2>About the whole of it and more</a></ul></div><div><p>" + "text " * 30 + "</p><p>short</p></div>", ("text " * 30).strip() + "\nshort"),
    ("<article><h1>T</h1><p>cut &am", "T\ncut &am"),
    ("<article><h1>T</h1><p>cut</p><fo", "T\ncut"),
    ("<article><header><h1>T</h1></header><!-- <p>no</p> --><p title='a > b'>x</p><p>1 < 2 & 3</p></article>", "T\nx\n1 < 2 & 3"),
    ("<article><p>a</p></article><section class='comment-list'><article><p>Reader</p></article></section>", "a"),
    ("", ""), (None, ""), ("<script>x", ""), ("plain text", "plain text"), ("<style>a{}</style>", ""), ("<", "<"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert main_text(page) == text


def test_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    got = extract(df).collect()
    assert len(got) == len(html)
    for r in got:
        body = re.split("</article>|<footer", html[r.page_id].split("<article>", 1)[1])[0] if "<article>" in html[r.page_id] else ""
        assert r.n_chars == len(r.text) and len(r.text) > 0
        assert len(re.sub(r"\s+|&[^;\s]*;?", "", r.text)) >= 0.9 * len(re.sub(r"<[^>]*>|\s+|&[a-z]+;?", "", body)) - 20
        assert "track(" not in r.text and "©" not in r.text


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert extract(df.limit(0)).collect() == []


def test_long_page_takes_time_in_proportion():
    page = "<article>" + "<div><p>text <b>more</b></p>" * 40_000
    assert main_text(page).count("\n") == 39_999


@pytest.mark.parametrize("rows", [3, 99, 100, 5000])
@pytest.mark.parametrize("part", ["<table>{}</table>|<tr><td>x<th>y", "<dl>{}</dl>|<dt>x<dd>y", "<table>{}</table>|<tbody><tr><td>x", "<div>{}</div>|<b><i>x"])
def test_elements_end_at_any_depth(part, rows):
    frame, row = part.split("|")
    inner = frame.format(row * rows)
    assert main_text(f"<nav>{inner}</nav><article><p>A</p></article><footer>{inner}</footer>") == "A"
    text = main_text(f"<article><p>A</p>{inner}</article><p>after it, and not of the article</p>")
    assert text.startswith("A\n") and "after" not in text


@pytest.mark.parametrize("tag", ["TITLE", "Script", "style"])
def test_raw_elements_end_whatever_letters_the_page_has(tag):
    raw = f"<{tag}>no</{tag}>"
    assert main_text(f"<HTML><HEAD>{raw}</HEAD><ARTICLE><P>\u0130stanbul</P>{raw}<P>B</P></ARTICLE>") == "\u0130stanbul\nB"


LONG = "word " * 20
AD = "<div class=ad><div><p>Buy this now</p></div></div>"
UNNAMED = [
    (f"<p>{LONG}</p>{AD}<p>A short paragraph.</p>{AD}<h2>Head</h2><form><p>mail</p></form><p>{LONG}</p>", "A short paragraph.\nHead"),
    (f"<p>{LONG}</p>{AD}<aside>no</aside><ul><li>one<li>two</ul><nav><a href=1>x</a></nav><p>{LONG}</p>", "one\ntwo"),
    (f"<p>{LONG}</p><p><a href=1>A link paragraph of the article, which is long enough</a></p><p>{LONG}</p>", "A link paragraph of the article, which is long enough"),
]


@pytest.mark.parametrize(("inner", "kept"), UNNAMED)
def test_nothing_between_accepted_runs_is_lost(inner, kept):
    frame = "<div><ul><li><a href=1>Home page of this site</a><li><a href=2>All about it and more</a></ul></div><div>{}</div><footer>(c) us</footer>"
    assert main_text(frame.format(inner)) == f"{LONG.strip()}\n{kept}\n{LONG.strip()}"


def test_an_advert_at_the_edge_parts_nothing():
    assert main_text(f"<h2>Head</h2>{AD}<p>{LONG}</p>{AD}<p>The end.</p><footer>(c) us</footer>") == f"Head\n{LONG.strip()}\nThe end."
    assert main_text("<article><p>one<span class=ad>buy</span>two</p></article>") == "one two"


class Slow(HTMLParser):
    """A plain reading of a well-formed page: what stands in its article, without the named parts."""

    def __init__(self, holders=("article", "main")):
        super().__init__(convert_charrefs=True)
        self.holders, self.open, self.lines = holders, [], [""]

    def handle_starttag(self, tag, attrs):
        words = {w.lower() for k in ("class", "id") for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", dict(attrs).get(k) or "")}
        away = tag in DROPPED | RAW or tag not in self.holders and bool(words & CLASSES) and not words & FRAME
        if tag in BLOCK:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "
        if tag not in VOID:
            self.open.append((tag, away))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.lines.append("")
        while self.open and any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t in self.holders for t, _ in self.open) and not any(away for _, away in self.open):
            self.lines[-1] += data


def slow(page):
    parser = Slow()
    parser.feed(page)
    parser.close()
    return "\n".join(filter(None, (" ".join(x.split()) for x in parser.lines)))


def test_table_against_a_plain_reading(spark):
    html = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    same = [main_text(x) == slow(x) for x in html]
    assert sum(same) >= 0.95 * len(same)


def test_the_distribution_finds_the_text_without_article_elements(spark):
    html = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect()]
    bare = [re.sub(r"</?(article|main)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", x) for x in html]
    assert sum(main_text(a) == main_text(b) for a, b in zip(html, bare)) >= 0.97 * len(html)


def test_window_sums_choose_among_articles():
    cards = "".join(f"<article><h2>Card {i}</h2></article>" for i in range(3))
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p><p>end</p></article><div>{cards}</div>") == f"T\n{LONG.strip()}\nend"
    assert main_text("<article><p>A</p></article>") == "A"
