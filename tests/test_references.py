"""Character references that a page holds whole, cut or without their semicolon."""

import duckdb
import pytest

from loomspan.functions import text as T
from loomspan.operators import dom
from loomspan.plans import registry

from .oracle import rows_of_query

TITLES = ["a &quot", "&quotb&quot; &amp c&amp;d &ampquot;", "&copy;&middot &lt z &quo &am &a &", "say &quot;x&quot;", "&amp;quot; &amplt; &ampampamp;"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("references")
    rows = [(i, f"https://h{i % 2}.example/p/{i}?a=1&b={i}", f'<html><head><title>{t}</title><script>var a = 1 && 2;</script></head><body><nav>x &copy y</nav><article><h1>{t}</h1><p>Words &quot<b>of</b> the {t}<br>{t}</p></article></body></html>') for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["visible_text", "host_summary", "article_words"])
def test_references_without_semicolon_as_in_the_sql(spark, pages, name):
    names, got = rows_of_query(registry.queries()[name](spark, pages))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{pages}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)


def test_old_names_without_semicolon_are_references_unless_told(spark):
    rows = spark.createDataFrame([("&quota &copy &eacute; &#233; &nosuch; &quot",)], "x string")
    assert rows.select(T.visible_text("x"), T.visible_text("x", bare=False)).collect()[0] == ('"a © é é &nosuch; "', "&quota &copy é é &nosuch; &quot")


def test_a_parse_may_leave_names_without_semicolon():
    page = '<a title="&copy &lt;" href="/?a=1&lt=2">x &quot y&amp z &eacute;</a><script type="application/ld+json">{"a": "&copy && &amp;"}</script>'
    link = dom.tree(page, bare=False).find("a")[0]
    assert (link.attrs["title"], link.attrs["href"], link.text()) == ("&copy <", "/?a=1&lt=2", "x &quot y& z é")
    assert dom.tree(page).find("a")[0].text() == 'x " y& z é'
    assert dom.parse(page, bare=False)["json_ld"] == dom.parse(page)["json_ld"] == ['{"a":"&copy && &amp;"}']
