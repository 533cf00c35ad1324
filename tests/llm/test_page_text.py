"""Page texts: known pages, agreement of hosts, odd pages."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cutline.llm.page_text import Page, other_paths, page_paths, page_texts
from cutline.session import written


def best_text(html: str) -> str:
    page = Page(html)
    return page.text(page.best())[0]


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("<p>a &amp; b &am</p><p>&eacute;&nbsp; x\n y&#33;", "a & b &am\né x y!"),
    ("<div><p>one<p>two <b>bold<br>after</div>", "one\ntwo bold after"),
    ("<script>if (a<b) x('</p>')</script><style>p{}</style><article><p>kept</p><!-- <p>gone</p> --> tail</article>", "kept\ntail"),
    ("<body><nav><p>menu menu menu menu menu</p></nav><main>Text<footer>end of it all</footer></main>", "Text"),
    ("<article><p>long enough text here</p><div class='share-bar'>share</div><ul><li>x<li>y</ul></article><div class=comments><p>" + "c " * 99, "long enough text here\nx\ny"),
    ("<div class='with-sidebar'><p>body text</p></div><div id=sideBar-ad>buy</div><form><p>name name name</p></form>", "body text"),
    ("<div hidden><p>" + "h " * 50 + "</p></div><div style='display: none'>x</div><p>seen", "seen"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<title>t</title><textarea><p>draft</textarea>", ""),
    ("a < b and <3", "a < b and <3"),
    ("<ul><li><a href=x>only<li><a>links</ul>", ""),
    ("<p>unclosed <!-- comment <p>gone", "unclosed"),
    ("<div>" * 3000 + "deep" + "</span>" * 3000, "deep"),
])
def test_blocks(html, text):
    assert best_text(html) == text


def page(style: str, body: str, side: str) -> str:
    return f"<html><body><div class='{style}'><p>{body}</p></div><div class='extra'><p>{side}</p></div></body></html>"


def test_hosts_overrule_odd_pages_like_a_plain_count(spark):
    rows = []
    for i in range(40):  # ten pages whose side text is longer than their body; every page has its own digits
        body, side = ("short body", "side " * 40) if i % 4 == 0 else ("body words " * 30, "side")
        rows.append((i, f"http://a.example/{i}", page(f"post-{i} x", body, side)))
    rows += [(100, "http://b.example/", page("post-1 x", "short body", "side " * 40)), (101, None, page("q", "text", "t")), (102, "odd", None), (102, "odd", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("key", F.lit("k"))
    got = {(r.page_id, r.text) for r in page_texts(pages).collect()}
    want = {(i, "short body" if i % 4 == 0 else ("body words " * 30).strip()) for i in range(40)}
    want |= {(100, ("side " * 40).strip()), (101, "text"), (102, "")}  # a lone page follows itself
    assert got == want
    assert page_texts(pages).columns == ["page_id", "url", "key", "text", "path"]
    assert page_texts(pages).where("page_id = 0").first()["path"] == "html>body>div.post-#.x"
    assert page_texts(pages.limit(0)).count() == 0

    # decisions against a count on the driver
    keyed = pages.select("url", "html", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("key"))
    read = written(page_paths(keyed), "read")
    seen = [r for r in read.collect() if r.best is not None]
    on, won = Counter((r.host, p) for r in seen for p in r.paths), Counter((r.host, r.best) for r in seen)
    pick = {r.key: max(r.paths, key=lambda p: (won[r.host, p] / (on[r.host, p] + 1), p == r.best, p)) for r in seen}
    assert {(r.key, r.path) for r in other_paths(read).collect()} == {(r.key, pick[r.key]) for r in seen if pick[r.key] != r.best}


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    from cutline.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert {tuple(r) for r in QUERIES["op12_page_text"](spark, sf_dir).collect()} == set(con.execute(ORACLES["op12_page_text"]).fetchall())
