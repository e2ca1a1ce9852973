from passageworks.llm import pages, queries

SF = "/root/testdata/sf0.001"
LONG = "This is a paragraph of the article, and it is long enough to be judged by its words and its length."


def test_marked_article():
    page = f"<body><nav><a href=x>Menu</a></nav><div class=ad>Buy<article><header><h1>T</h1></header><p>{LONG}<p>No.<p>a &lt;b&gt;&nbsp;c &amp d<br>e</article><footer>f</footer>"
    assert pages.main_text(page) == f"T\n{LONG}\nNo.\na <b> c & d e"


def test_boilerplate_by_markup():
    bad = [
        "<header>Site name of the page</header>", "<aside>The side bar</aside>", "<form><p>Your name of the</p><input></form>", "<script>var a='<p>no</p>'</script>",
        "<style>p{}</style>", "<div id=cookie-notice>We use the cookies of this site</div>", "<section class='x comments'><p>" + LONG + "</p></section>",
        "<div role=navigation>to the top</div>", "<div style='display: none'>" + LONG + "</div>", "<!-- <p>no</p> -->", "<ul class=menu><li>of the</li></ul>",
    ]
    for b in bad:
        assert pages.main_text(f"<html><title>t</title><body>{b}<div><p>{LONG}</p>{b}<p>{LONG}</p></div>{b}</body></html>") == f"{LONG}\n{LONG}", b
        assert pages.main_text(f"<article><p>{LONG}</p>{b}<p>Short.</p></article>") == (f"{LONG}\nShort." if "<header>" not in b else f"{LONG}\nSite name of the page\nShort."), b


def test_rules_without_markup():
    links = "<p>" + "".join(f"<a href=x>link to the {i} of that</a> " for i in range(9)) + "</p>"
    odd = "<p>" + "xyzzy plugh foobar quux " * 6 + "</p>"
    assert pages.main_text(f"<body>{links}<p>Before it.</p><p>{LONG}</p><p>After it.</p><p>Two.</p>{odd}</body>") == f"Before it.\n{LONG}\nAfter it."


def test_neighbours_decide():
    assert pages.settle([None, True, None, None, False, None], False) == [True, True, True, False, False, False]
    assert pages.settle([True, None, False], False) == [True, True, False]
    assert pages.settle([None, None], True) == [True, True] and pages.settle([], True) == []


def test_odd_pages():
    for page, text in [(None, ""), ("", ""), ("<p>", ""), ("<", ""), ("<p>a <b", ""), ("<article>x < y & z", "x < y & z"), ("<article>a<!-- x", "a"), ("<article><p>a &am", "a &am")]:
        assert pages.main_text(page) == text
    assert len(pages.main_text("<article>" + "<p>word</p>" * 50_000)) == 5 * 50_000 - 1


def test_query_against_template(spark):
    import html
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op5_html_extraction(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        body = re.split(r"</?(?:p|h1)>", rows[r["page_id"]].split("<article>")[1].split("</article>")[0])
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in body]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<article>a</article>", None)], "page_id LONG, html STRING, n_chars STRING")
    assert sorted(r["text"] for r in pages.extract_text(df).collect()) == ["", "a"]
    assert pages.extract_text(df.limit(0)).count() == 0
