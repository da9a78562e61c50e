import html as H
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import page_text


def lines(source):
    """Lines that are not chrome by markup."""
    return [(x.text, x.state) for x in page_text.page_lines(source) if x.state != page_text.MARKED]


def test_what_markup_says():
    got = [(x.text, x.state) for x in page_text.page_lines("<nav>a</nav>b<article>c<div class='related-work'>d</div><aside>e</aside><div class=comments>f</div><p class=notice>g</p></article><p class=notice>h</p>")]
    assert got == [("a", 2), ("b", 0), ("c", 1), ("d", 3), ("e", 2), ("f", 2), ("g", 3), ("h", 2)]
    deep = page_text.page_lines("<div>" * 50_000 + "x" + "</div>" * 50_000)
    assert [x.text for x in deep] == ["x"]


@pytest.mark.parametrize(
    "source,want",
    [
        (None, []),
        ("", []),
        ("plain &amp; text", [("plain & text", 0)]),
        ("<article><h1>A\n b</h1><p>one<br>two <b>bold</b>ly<p>three</article><footer>x</footer>", [("A b", 1), ("one", 1), ("two boldly", 1), ("three", 1)]),
        ("<nav>menu</nav><main><header><h1>T</h1></header><p>t</p><form>f</form><div class='comments'>no</div></main><p>out", [("T", 1), ("t", 1), ("out", 0)]),
        ("<script>var a='</p>';</script><style>p{}</style><!-- <p>no --><p>yes", [("yes", 0)]),
        ("<div class=ad>buy</div><div class='header-text'>kept</div><div role=navigation>n</div>", [("kept", 0)]),
        ("<article><p>a<script>unclosed <p>b", [("a", 1)]),
        ("<article>a &lt;b&gt; &copy &am <i", [("a <b> © &am", 1)]),
        ("</p></div>stray<ul><li>x<li>y</ul>", [("stray", 0), ("x", 0), ("y", 0)]),
        ("<p title='a > b'>t</p>", [("t", 0)]),
    ],
)
def test_lines(source, want):
    assert lines(source) == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a ' \" ", "<a<a", "<!", '<a" ', "<div>", "<div></p></span>", "</p><b "])
@pytest.mark.parametrize("end", ["", ">", '/ ">', "' x>", "<!--"])
def test_hostile_pages_take_linear_time(piece, end):
    source = piece * (500_000 // len(piece)) + end
    began = time.perf_counter()
    page_text.page_lines(source)
    assert time.perf_counter() - began < 5


def test_tags_after_one_that_never_ends():
    assert lines('<p>a<a title="x <b>c</b> <p>d') == [("a<a title=\"x c", 0), ("d", 0)]
    assert lines("<p>a <a <!-- > --> b") == [("a --> b", 0)]  # a tag that does end, as a browser reads it
    assert lines("<p>a <b 'x <i \" <u>c") == [("a <b 'x <i \" c", 0)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_longest_common_subsequence(a, b):
    got = page_text.common(a, b)
    assert len(got) == lcs(a, b)
    it = iter(b)
    assert all(a[i] in it for i in sorted(got))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<div class=ad>", "</div>", "<nav>", "</nav>", "x", " y ", "&amp", "<", '"', "'", "<br/>", "<script>", "</script>", "<!--", "-->", "<a href='q>'>", "</a>", "<table><tr><td>"]), max_size=25).map("".join))
def test_any_markup_is_read(source):
    page_text.page_lines(source)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string, row int")
    return sorted(((r.page_id, r.text, r.n_chars) for r in page_text.main_text(df).collect()), key=str)


def test_pages_of_a_host_are_differenced(spark):
    def page(i, body):
        return f"<div>Welcome to the site</div><p>{body}</p><div>All rights reserved</div>"

    rows = [(i, f"http://h.example/a/{i}", page(i, f"body number {i}"), 0, "t", 0) for i in range(8)]
    rows += [(20, "http://alone.example/", page(20, "b"), 0, "t", 0), (21, None, page(21, "c"), 0, "t", 0), (22, "http://h.example/a/9", None, 0, "t", 0), (None, "", "", 0, "t", 0), (3, "http://h.example/a/3", page(3, "body number 3"), 0, "t", 0)]
    got = run(spark, rows)
    want = [(i, f"body number {i}", 13) for i in [*range(8), 3]]
    alone = ["Welcome to the site b All rights reserved", "Welcome to the site c All rights reserved"]
    want += [(20, alone[0], len(alone[0])), (21, alone[1], len(alone[1])), (22, "", 0), (None, "", 0)]
    assert got == sorted(want, key=str)
    assert run(spark, []) == []


def test_article_text_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in page_text.main_text(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        want = " ".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, want, len(want))


def test_plain_markup_goes_by_the_difference(spark):
    """No article, no telling names: menus, a notice, a footer with the page's own date."""

    def page(i):
        menu = "".join(f"<li>{x}</li>" for x in ("Home", "News", "About us"))
        body = "".join(f"<p>Page {i} tells part {j} of its story, which no other page tells.</p>" for j in range(5))
        return f"<div><ul>{menu}</ul></div><div>Read our terms before you go on.</div><div>{body}</div><div>Made with care</div>"

    rows = [(i, f"http://plain.example/{i:03}", page(i), 0, "t", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string, row int")
    for r in page_text.main_text(df).collect():
        assert r.text == " ".join(f"Page {r.page_id} tells part {j} of its story, which no other page tells." for j in range(5))


    assert {(r.n_shared, r.n_marked) for r in page_text.deleted_lines(df).collect()} == {(5, 0)}


def test_sections_inside_an_article(spark):
    """What the neighbour has too is a notice; the author's own section stays; so does a repeated line of the article."""
    page = "<article><p>Same line.</p><p>Own {0}.</p><p class='notice'>Cookies!</p><section class='related-work'>Work like {0}.</section></article>"
    rows = [(i, f"http://s.example/{i}", page.format(i), 0, "t", 0) for i in range(4)]
    assert run(spark, rows) == [(i, f"Same line. Own {i}. Work like {i}.", 30) for i in range(4)]


def test_the_difference_decides_on_the_table(spark, sf_dir):
    rows = page_text.deleted_lines(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    shared, marked = sum(r.n_shared for r in rows), sum(r.n_marked for r in rows)
    print("lines that went because the neighbour has them", shared, "by markup alone", marked)
    assert shared > 0
