import pytest

from layoutcheck.llm.html import extract_main_text, host_of, walk

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain <b>t</b>ext &amp; &lt;more&gt; &#65;&#x42; &copy 5 < 6", "plain text & <more> AB © 5 < 6"),
        ("<p>one\n two</p><p>three<br>four</p><div>five</div>six", "one two three four five six"),
        ("<html><head><title>no</title></head><body><article><h1>H</h1><p><b>B<br><p>C</p></article><footer>f</footer></body></html>", "H B C"),
        ("<div>out</div><main>in<header>kept</header></main><div>out</div>", "in kept"),
        ("<header>a</header><nav>b</nav><aside>c</aside><form>d</form><script>var e='</p>'</script><style>f</style><p>g</p><footer>h</footer>", "g"),
        ('<div class="ad">a</div><div id="cookie-notice">b</div><div class="post sidebar">c</div><div role="navigation">d</div><p>e</p>', "e"),
        ('<article>a<div class="comments"><article>b</article></div><aside>c</aside><p hidden>d</p>e</article>', "a e"),
        ("<!-- <article>x</article> --><p>a</p><!-- never closed <p>b", "a"),
        ("<p>a</p><script>unclosed <p>b</p>", "a"),
        ('<p title="a > b" data-x=\'<i>\'>c</p>', "c"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("</p></div>a</b>", "a"),
        ('<a href="x>y', "y"),
        ("<article></article><p>a</p>", "a"),
        ("<P CLASS=AD>a</P><DIV>b</DIV>", "b"),
        ("<textarea><p>a</p></textarea>b<svg><path/></svg>c", "bc"),
        ("load<i>ed</i> <span class='headline'>header</span>", "loaded header"),
    ],
)
def test_one_page(page, text):
    assert walk(page) == text


def test_deep_nesting_and_long_pages():
    assert walk("<div>" * 20_000 + "x") == "x"
    assert len(walk("<p>word</p>" * 100_000)) == 500_000 - 1
    assert walk("<" * 50_000) == "<" * 50_000


def test_hosts():
    assert [host_of(u) for u in ("https://u:p@WWW.a.org:80/x?y#z", "http://b.org", "c.org/d", "", None, "https://[::1]/x")] == ["www.a.org", "b.org", "c.org", "", "", "["]


def _site(n=12):
    menu = "<div><span>Home</span> <span>About us</span></div>"
    return [(i, f"https://a.org/{i}", f"<body>{menu}<div><p>Own text {i}.</p><p>More of {i}</p></div><div>All rights of a.org</div></body>") for i in range(n)]


def test_what_recurs_on_a_host_goes(spark):
    rows = _site() + [(100, "https://b.org/1", "<body><div><span>Home</span> <span>About us</span></div><p>b</p></body>")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Own text {i}. More of {i}" for i in range(12)} | {100: "Home About us b"}


def test_the_article_stays_though_it_recurs(spark):
    rows = [(i, "https://a.org/", f"<div>menu</div><article><p>same on all pages</p><p>{i % 3}</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"same on all pages {i % 3}" for i in range(30)}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "https://a.org", ""), (None, "https://a.org", "<p>x</p>"), (3, "https://a.org", "<p>y</p>"), (3, "https://a.org", "<p>y</p>"), (3, "https://a.org", "<p>é</p>")]
    got = extract_main_text(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS uid", "3 AS `drop`"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "y", 1), (3, "y", 1), (3, "é", 1)]
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def _texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_without_an_article_keep_their_text_and_templates_stay_gone_on_a_large_host(spark):
    copies = [(i, f"https://a.org/{i}", "<body><div><p>One text</p><p>at many <b>URLs</b></p></div></body>") for i in range(30)]
    notice = lambda i: "<div>A notice on few pages</div>" if i < 1012 else ""
    large = [(i, f"https://b.org/{i}", f"<body>{notice(i)}<div><p>Own <b>text</b> {i}</p></div></body>") for i in range(1000, 4000)]
    got = _texts(spark, copies + large)
    assert got == {i: "One text at many URLs" for i in range(30)} | {i: f"Own text {i}" for i in range(1000, 4000)}


def test_a_box_inside_articles_that_otherwise_differ_goes(spark):
    box = "<div class='x9'><p>Get our letter</p><p>each week</p></div>"
    page = lambda own: f"<div>menu</div><main><article><h2>Summary</h2><p>Own {own}</p>{box}<ul><li>yes</li><li>{own}</li></ul></article></main>"
    rows = [(i, f"https://a.org/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://b.org/{i}", page(i % 3)) for i in range(30)]
    got = _texts(spark, rows)
    assert got == {i: f"Summary Own {i} yes {i}" for i in range(12)} | {100 + i: f"Summary Own {i % 3} Get our letter each week yes {i % 3}" for i in range(30)}


def _plain(rows, least=10):
    """The same by plain Python: count subtrees a host over pages of different text, drop, print."""
    from collections import defaultdict

    seen, pages = defaultdict(set), []
    for i, url, page in rows:
        own = ([], [])
        before = walk(page or "", hashes=own)
        pages.append((i, host_of(url), page or "", own[0] + own[1], before))
        for key in pages[-1][3]:
            seen[host_of(url), key].add(before)
    return {i: (before, walk(page, frozenset(k for k in keys if len(seen[host, k]) >= least))) for i, host, page, keys, before in pages}


@pytest.mark.parametrize("kind", ["given", "without articles", "boxes in articles"])
def test_the_given_pages_are_the_plain_version_and_the_count_changes_some(spark, kind):
    import os

    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(path).collect()]
    if kind == "without articles":
        rows = [(i, url, page and page.replace("<article", "<div").replace("</article", "</div")) for i, url, page in rows]
    if kind == "boxes in articles":
        given, rows = rows, [(i, url, page and page.replace("</article>", "<div><p>Share this page</p></div></article>")) for i, url, page in rows]
    want = _plain(rows)
    assert _texts(spark, rows) == {i: after for i, (_, after) in want.items()}
    if kind != "given":  # the given pages have templates only where tags say so
        assert sum(before != after for before, after in want.values()) > 0
    if kind == "boxes in articles":
        plain = {i: walk(page or "") for i, _, page in given}
        assert sum(want[i][1] == plain[i] for i in plain) > 0.7 * len(plain)  # hosts of ten pages and more


def test_without_marks_the_count_alone_finds_the_template(spark):
    """No tag, class or role says what is what."""
    rows = [(i, f"https://a.org/{i}", f"<div><div><p>Home</p><p>About</p></div><div><p>Text {i} one</p><div>Share this</div><p>Text {i} two</p></div><div>All rights</div></div>") for i in range(20)]
    assert _texts(spark, rows) == {i: f"Text {i} one Text {i} two" for i in range(20)}
    assert [walk(page) for _, _, page in rows[:1]] == ["Home About Text 0 one Share this Text 0 two All rights"]
