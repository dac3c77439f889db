from __future__ import annotations

import html as entities
import random
import re

from sensorloom.llm import html

from .data import SF

PAGES = "page_id long, url string, html string, row long, lines string, mate long"


def _texts(page):
    return [t for t, _ in html.page_lines(page)]


def test_zones():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav>menu</nav>"
        "<div class='cookie-notice'>We use</div><div id=content><h2>Head &amp; tail</h2><p>One <b>two</b><br>three<p>Four&nbsp;x"
        "<ul><li>a<li>b</ul><form><input>Search</form><div class='comments'><p>me too</div></div><aside>side</aside>"
        "<p style='display: none'>hidden</p><div role=navigation>go</div><footer>&copy;"
    )
    assert _texts(page) == ["Head & tail", "One two three", "Four x", "a", "b"]
    page = "<body><div>x</div><article><header><h1>A</h1></header><p>te<i>x</i>t<div class=ad>buy</div>more<section id='comments'>c</section></article>"
    assert _texts(page) == ["A", "text", "more"]
    assert _texts(None) == _texts("") == _texts(" <p> </p>") == []
    assert _texts("just text &#233;&lt;") == ["just text é<"]
    assert _texts("<!-- c --><p>a<!-- b -->c</p><![CDATA[x]]><p>d") == ["ac", "d"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html.shared_lines(a, b)
        picked = [a[i] for i in sorted(got)]
        assert len(got) == table[-1][-1]
        it = iter(b)
        assert all(x in it for x in picked)


def test_site_lines_go_where_no_article_is_marked(spark):
    page = "<body><div>Welcome to our site</div><div>{}</div><div>Second {}</div><div>All rights reserved</div>"
    rows = [(n, f"http://Host/a/b/{n}", page.format(f"Story {n}", n)) for n in range(7)]
    rows += [(10, "http://other/x", page.format("Only", "one")), (11, None, page.format("No", "url")), (12, "http://h2/1", "<p>same"), (13, "http://h2/2", "<p>same")]
    rows += [(14, "http://h3/1", None), (14, "http://h3/1", "<p>again"), (None, "http://[bad", "<p>x"), (15, "http://h4/a", "<article><p>kept"), (16, "http://h4/b", "<article><p>kept")]
    df = spark.createDataFrame([(*r, 1, "l", 2) for r in rows], PAGES).repartition(3)
    out = html.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    got = {r.page_id: r.text for r in out.where("page_id <> 14").collect()}
    assert all(got[n] == f"Story {n} Second {n}" for n in range(7))
    assert got[10].startswith("Welcome") and got[11].endswith("reserved") and got[12] == got[13] == "same" and got[15] == got[16] == "kept"
    assert html.main_text(df.limit(0)).count() == 0


def test_pages_with_articles_are_held_against_their_neighbours(spark):
    prose = "<p>A passage that both articles hold.</p>"
    rows = [
        # The site's line stands in the article of one page and outside that of the other.
        (1, "http://h/a/1", f"<article><h1>One</h1>{prose}<p>Read more on our site</p><p>End one</p></article>"),
        (2, "http://h/a/2", f"<article><h1>Two</h1>{prose}<p>End two</p></article><div>Read more on our site</div>"),
        # A print version marks no article: the article of the other stays whole.
        (3, "http://k/a/3", "<div>Site</div><article><p>Story</p><p>Body</p></article>"),
        (4, "http://k/a/3/print", "<div>Site</div><div>Story</div><div>Body</div>"),
        # Whole copies keep everything.
        (5, "http://l/1", f"<article>{prose}</article>"),
        (6, "http://l/2", f"<article>{prose}</article>"),
    ]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = "A passage that both articles hold."
    assert got == {1: f"One {both} End one", 2: f"Two {both} End two", 3: "Story Body", 4: "Story Body", 5: both, 6: both}


def test_long_pages_are_aligned_without_a_table_of_all_pairs():
    import tracemalloc

    rng = random.Random(4)
    a, b = ([rng.randrange(1500) for _ in range(3000)] for _ in range(2))
    tracemalloc.start()
    assert len(html.shared_lines(a, b)) > 100
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # a table of all pairs takes 18 MB here


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    places = [(n, rng.choice(("h", "h", "h", "k", None)), "/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(4)))) for n in range(120)]
    df = spark.createDataFrame(places, "row long, host string, path string")
    ordered = sorted((p for p in places if p[1]), key=lambda p: (p[1], p[2], p[0]))
    want = {}
    for i, p in enumerate(ordered):
        near = [q for q in ordered[max(0, i - 1) : i] + ordered[i + 1 : i + 2] if q[1] == p[1]]
        if near:
            want[p[0]] = max(near, key=lambda q: html._common(q[2], p[2]))[0]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.row: r.mate for r in html.nearest_pages(df).collect()}
            assert got.keys() == want.keys()
            path = {p[0]: p[2] for p in places}
            assert all(html._common(path[m], path[r]) == html._common(path[want[r]], path[r]) for r, m in got.items())
            if parts == "1":
                assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pages_against_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        inner = re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")
        assert got[p.page_id].text == " ".join(entities.unescape(inner).split())
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
