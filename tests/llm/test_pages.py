"""Page text: markup, differencing, and pairs against plain Python."""

import random
import re
from html import unescape
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from growthcast.llm import pages as P, queries as Q

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Caf&eacute; &amp; tea</h1><p>By someone</p></header><p>First <b>bold</b>
 line&nbsp;here.<br>Still it.<p>Second &#8212; one.<ul><li>item a<li>item b</ul><div class="ad">Buy!</div><blockquote>Quoted</blockquote>
<form><label>Mail</label><input></form><aside>Related</aside><pre>  code
 x</pre></article><section id="comments"><article class="comment"><p>Nice post</p></article></section></main>
<div id="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).repartition(3)
    return {r.page_id: (r.text, r.n_chars) for r in P.extract(df).collect()}


def test_article_markup(spark):
    want = "Café & tea\nFirst bold line here. Still it.\nSecond — one.\nitem a\nitem b\nQuoted\ncode x"
    assert texts(spark, [(1, "http://a.example/x", ARTICLE)])[1] == (want, len(want))


def test_differencing_deletes_shared_open_lines(spark):
    page = "<html><body><div>Top line</div><div>{}</div><div>Read on</div><div>{}</div><table><tr><td>Bottom</table></body>"
    rows = [(1, "http://a.example/x/1", page.format("own one", "more")), (2, "http://A.example:80/x/2?q=1", page.format("own two", "Top line")),
            (3, "http://b.example/x/1", page.format("alone", "here"))]
    got = texts(spark, rows)
    assert got[1][0] == "own one\nmore" and got[2][0] == "own two\nTop line"
    assert got[3][0] == "Top line\nalone\nRead on\nhere\nBottom"


def test_shared_article_lines_stay(spark):
    page = "<nav>m</nav><article><p>Licence line</p><p>{}</p></article>"
    got = texts(spark, [(i, f"http://a.example/{i}", page.format(i)) for i in range(3)])
    assert got == {i: (f"Licence line\n{i}", 14) for i in range(3)}


def test_open_lines_beside_article_lines_are_differenced(spark):
    page = ('<body><h1 class="entry-title">Title {0}</h1><div>Site line</div><div>Body {0}</div><p>More {0}</p>'
            '<article><p>Card</p></article><div class="post"><p>Licence</p><p>Post {0}</p></div></body>')
    got = texts(spark, [(i, f"http://a.example/{i}", page.format(i)) for i in range(3)])
    assert {i: t for i, (t, _) in got.items()} == {i: f"Title {i}\nBody {i}\nMore {i}\nCard\nPost {i}" for i in range(3)}


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_are_not_neighbours(spark, parts):
    """Equal and nearly equal copies lose the template's lines alone; so do pages beside them; a host of copies loses nothing."""
    body = "A long paragraph of the page that was captured more than once. " * 5
    page = "<div>Top line of the site</div><div>{}</div><div>{}</div>"
    rows = [(i, f"http://a.example/x/p?page={i}", page.format(body, "seen")) for i in range(20)]
    rows += [(20 + i, "http://a.example/x/q", page.format(body, f"seen {i} times")) for i in range(20)]
    rows += [(90, "http://a.example/x/a", page.format("First page of its own", "one")), (91, "http://a.example/x/z", page.format("Last page of its own", "two"))]
    rows += [(100 + i, f"http://b.example/{i}", page.format(body, "only")) for i in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {i: t for i, (t, _) in texts(spark, rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    body = body.strip()
    assert all(got[i] == f"{body}\nseen" for i in range(20)) and all(got[20 + i] == f"{body}\nseen {i} times" for i in range(20))
    assert got[90] == "First page of its own\none" and got[91] == "Last page of its own\ntwo"
    assert {got[100 + i] for i in range(3)} == {f"Top line of the site\n{body}\nonly"}


def test_edges(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/", "<p>plain"), (None, "http://h/a", "<p>no id"), (4, "http://h/b", "text only &lt;p&gt; &#x1F600;"),
            (5, "http://h/c", "<article>" + "<p>w w</p>" * 20_000), (6, "http://k/", "<script>never closed"), (7, "http://k2/", "<article><!-- open"), (9, "http://same/1", "<p>s"), (9, "http://same/1", "<p>s")]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[6] == got[7] == ("", 0)
    assert got[3][0] == "plain" and got[None][0] == "no id" and got[4][0] == "text only <p> 😀" and got[5][0] == "\n".join(["w w"] * 20_000) and got[9][0] == "s"
    assert texts(spark, []) == {}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.sample(range(12), rng.randrange(10)) for _ in "ab")
        mark = P.shared(a, b)
        it = iter(b)
        assert mark.sum() == lcs(a, b) and all(x in it for x, m in zip(a, mark) if m)


@pytest.mark.parametrize("parts", [1, 7])
def test_nearest_against_python(spark, monkeypatch, parts):
    rng = random.Random(parts)
    rows = [(i, f"http://{rng.choice('abc')}.example/{rng.choice(['en', 'de'])}/{rng.randrange(30)}/{rng.randrange(3)}") for i in range(200)] + [(900, None), (901, "mailto:x")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.near for r in P._nearest(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    keys = sorted((urlsplit(u).netloc, urlsplit(u).path, i) for i, u in rows[:-2])
    want = {}
    for k, (host, path, i) in enumerate(keys):
        score = {}
        for j in (k - 1, k + 1):
            if 0 <= j < len(keys) and keys[j][0] == host:
                n, parts_ = 0, list(zip(path.split("/"), keys[j][1].split("/")))
                while n < len(parts_) and parts_[n][0] == parts_[n][1]:
                    n += 1
                score[j] = n
        if score:
            want[i] = keys[max(score, key=lambda j: (score[j], -j))][2]
    assert got == want


def test_query_gives_the_whole_articles(spark, sf):
    docs = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in Q.QUERIES["op2_page_text"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, html in docs.items():
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[i].text == "\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize("bad", ["<![foo[bar]]>", "<![ b", "<![>", "<![1[x]]>", "<![CDATA[x]]>", "<![if !IE]>"])
def test_malformed_sections(bad):
    assert P.Lines().of(f"<article><p>one</p>{bad}<p>two</p></article>")[0] == ("one", P.MAIN)
    if ">" in bad:
        assert [t for t, _ in P.Lines().of(f"<article><p>one</p>{bad}<p>two</p></article>") if t in ("one", "two")] == ["one", "two"]
