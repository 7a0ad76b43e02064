"""Main text of pages made from known parts, templates counted plainly, and what browsers make of broken markup."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

from tests.llm.test_operators import prose
from tracemend.llm import pages


def text(source, gone=frozenset()):
    return pages.main_text(pages.parse(source), gone)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("just  text", "just text"),
        ("<p>one<p>two &amp; <b>th</b>ree<br>four", "one\ntwo & three four"),
        ("<article><h1>T&eacute;</h1>a&nbsp;b<p><b>x.<br><p>y</article>z", "Té\na b\nx.\ny"),
        ("<body><nav>menu</nav><div class='ad'>buy</div><article><p>a</p></article><footer>f</footer>", "a"),
        ("<article><p>a<script>var t='</p>';</script> b</p><style>p{}</style><form>name <input></form></article>", "a b"),
        ("<article><p>a</p><aside>x</aside><footer>by me</footer><section id=comments><p>me too</p></section></article>", "a"),
        ("<article><p>a</p><article><p>first!</p></article></article><article class=comment>no</article><article class='post comment-count'>b</article>", "a"),
        ("<article class='post share-bar'>mine</article>", "mine"),
        ("<header>site</header><main><header><h1>T</h1></header><p>a</p><div role='complementary'>side</div></main>", "a"),
        ("<article><header><h1>T</h1></header><p>a</p></article>", "T\na"),
        ("<div id=header>site</div><div><p>a</p></div><div class=cookieNotice>we use</div><ul class='main-menu'><li>x</ul>", "a"),
        ("<div class='sidebar-layout'><article>a</article><div class=sidebar>b</div></div>", "a"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y<ul><li>z</ul></ul></article>", "1\n2\n3\nx\ny\nz"),
        ("<article>&lt;p&gt; &#65;&#x42; &amp;lt; &copy &unknown; &am</article>", "<p> AB &lt; © &unknown; &am"),
        ("<article><p title='a>b' data-x=\"<p>\">q</p><!-- <p>no</p> --><![CDATA[c & d]]></article>", "q\nc & d"),
        ("<article><p title=it's>q</p></article>", "q"),
        ("<article><p>a <button>press<b>me</b></button>b <span class=ad>buy <i>it</i></span>c</p></article>", "a b c"),
        ("<article><p>a <button>never closed</p><p>b</p></article>", "a\nb"),
        ("<HTML><BODY><ARTICLE><P>a</P></ARTICLE></BODY></HTML>", "a"),
        ("<article></article><p>out</p>", ""),
        ("<form id=all><nav>n</nav><main><p>a</p><form>name</form></main></form>", "a"),
        ("<div class=cookiebar>c</div><p>a <ins class=adsbygoogle>buy</ins>b</p><div class='advertBox'>c</div>", "a b"),
        ("<title>t</title><noscript>on!</noscript><p>a", "a"),
        ("<div><p>a</div></section>b", "a\nb"),
        ("a < b <3 <p>c", "a < b <3\nc"),
        ("<div " * 3, ""),
        ("<div>" * 3000 + "deep" + "</p>" * 3000, "deep"),
    ],
)
def test_markup(source, want):
    assert text(source) == want


def site():
    """(page_id, url, html, main text): hosts with unnamed templates, copies, quotations, one-page hosts, a host with a third of all pages."""
    draw = random.Random(2)
    quoted, copied = prose(draw, 40), [prose(draw, 30), prose(draw, 12)]
    out = []
    for k in range(60):
        host = "big.example.com" if k % 3 else f"h{k % 4}.example.org"
        menu = f"<div><a href=/>{host} start</a><a href=/x>{host} list</a></div>"
        notice = f"<p>{host} keeps your data for <b>ever</b>.</p>"
        paragraphs = [prose(draw, draw.randrange(5, 90)) for _ in range(draw.randrange(1, 5))]
        if k % 10 == 5:
            paragraphs.append(quoted)
        if k % 10 == 4:
            paragraphs = copied
        inside = "".join(f"<p>{p}</p>" for p in paragraphs)
        if k % 2:
            body, want = f"{menu}{notice}<article>{inside}<div>Share {host}</div></article><div>Made by {host}</div>", paragraphs
        else:
            body, want = f"{menu}{notice}<div>{inside}</div><div>Made by {host}</div>", paragraphs
        out.append((k, f"https://u@{host}:80/{k}?q", f"<html><head><title>{k}</title></head><body>{body}</body></html>", "\n".join(want)))
    out += [(100, "http://one.example.net/", "<body><nav>x</nav><article><p>Only.</p></article>", "Only."), (101, "http://one.example.net/", None, ""), (102, None, "<p>no host</p>", "no host"), (103, "http://e/", "", "")]
    out += [out[7], out[7], (None, *out[8][1:])]
    out += [(200 + k, out[1][1], out[1][2], out[1][3]) for k in range(5)]  # copies of a page
    return out


def test_query(spark, tmp_path):
    rows = site()
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS page", "'t' AS text", "3 AS gone")
    frame.repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.op13_page_text(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, u, t, len(t)) for i, u, _, t in rows), key=str)


def test_templates_are_those_of_a_plain_count(spark):
    """Subtrees by their own text on pages whose longest other block differs, on three pages and more."""
    rows = site()
    seen = pages.subtrees(spark.createDataFrame([(u.split("@")[1].split(":")[0], str(i).encode(), h) for i, u, h, _ in rows[:60]], "host string, page binary, html string").repartition(5))
    got = {tuple(r) for r in pages.templates(seen, spark.createDataFrame([("big.example.com", 40)], "host string, total long")).collect()}
    beside = defaultdict(set)
    for _, u, source, _ in rows[:60]:
        page = pages.parse(source)
        for e, h in enumerate(pages.hashes(page)):
            rest = [t for b, t in enumerate(page.blocks) if not page.begins[e] <= b < page.ends[e]]
            if pages.roots_of(page)[1][e] and rest and page.begins[e] < page.ends[e]:
                beside[u.split("@")[1].split(":")[0], h].add(max(rest, key=len))
    assert got == {k for k, v in beside.items() if len(v) >= 3} and len(got) >= 10
    few = pages.templates(seen, spark.createDataFrame([("big.example.com", 100_000)], "host string, total long"))
    assert {r["host"] for r in few.collect()} == {h for h, _ in got} - {"big.example.com"}  # a hundredth of its pages is more than it has


def test_other_columns_stay_and_nothing_is_fine(spark):
    frame = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "t")], "host int, url string, html string, `odd name` string")
    out = pages.extract_main_text(frame)
    assert out.columns == ["host", "url", "html", "odd name", "text"] and [tuple(r) for r in out.collect()] == [(1, "http://a/", "<p>x</p>", "t", "x")]
    assert pages.extract_main_text(frame.limit(0)).count() == 0


def test_sql_on_given_pages():
    """The article of the tables' pages, read by SQL and by the parser."""
    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}'")
    want = {r[0]: r[2] for r in con.execute(pages.ORACLE).fetchall()}
    assert {i: text(h or "") for i, h in con.execute("SELECT page_id, html FROM pages").fetchall()} == want
