import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from passageworks.functions.text import suffix
from passageworks.operators.hooks import extract_with
from passageworks.sources import files, history, markdown, markup


def load(spark, folder, **kw):
    return {r.file_path.rsplit("/", 1)[1]: r for r in files.load_documents(files.scan_corpus(spark, str(folder)), **kw).collect()}


def test_scan_and_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "plain.TXT").write_bytes("ré\r\nsecond\rthird".encode())
    (tmp_path / "sub" / "page.md").write_text("# Title\n\nSome *text* here\n\n* one\n* two\n")
    (tmp_path / "rows.csv").write_text("col1,col2\nval1,val2\n")
    (tmp_path / "odd.unsupported").write_text("x")
    (tmp_path / "bad.pdf").write_text("not a pdf")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4 rest")
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "long.csv").write_text('"' + "x" * 1_000_000 + '",b\n')
    (tmp_path / "with space.txt").write_text("spaced")
    rows = load(spark, tmp_path)
    assert rows["plain.TXT"].text == "ré\nsecond\nthird"
    assert rows["page.md"].text == (
        "<h1>Title</h1>\n<p>Some <em>text</em> here</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>"
    )
    assert rows["rows.csv"].text == "col1, col2\nval1, val2"
    assert rows["with space.txt"].text == "spaced"
    errors = {n: r.load_error for n, r in rows.items() if r.load_error}
    assert errors == {
        "odd.unsupported": "unsupported", "bad.pdf": "corrupt_pdf", "scan.pdf": "needs_extractor",
        "latin.txt": "bad_utf8",
    }
    assert all(rows[n].text == "" for n in errors)
    scanned = files.scan_corpus(spark, str(tmp_path), glob="*.md").collect()
    assert [r.file_path for r in scanned] == [str(tmp_path / "sub" / "page.md")] and scanned[0].suffix == ".md"


def test_missing_file_is_reported(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    asked = spark.createDataFrame([(str(tmp_path / "a.txt"),), (str(tmp_path / "none.txt"),)], "file_path STRING")
    assert load(spark, tmp_path, requested=asked)["none.txt"].load_error == "missing"


def test_extractor_failures_stay_with_their_file(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-hello")
    (tmp_path / "evil.pdf").write_bytes(b"%PDF-\xff\xff")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    rows = load(spark, tmp_path, extractor=extract_with(lambda: lambda b: b[5:].decode()))
    assert (rows["good.pdf"].text, rows["good.pdf"].load_error) == ("hello", None)
    assert (rows["evil.pdf"].text, rows["evil.pdf"].load_error) == ("", "corrupt_pdf")
    assert rows["fake.pdf"].load_error == "corrupt_pdf"


def test_csv_equals_the_dialect(spark):
    rng = random.Random(3)
    texts = ["", "\n", "\n\n", "a", "a,", ",", '"', '""', '"a""b"', '"a"b"c,d', 'x"y,z"', '"open, to\nthe end',
             '"a,\nb",c\n\n', 'a,b\n"",""\n', '"x"\n', ' "x" , y', '"' + 'q""' * 20_000 + '",z']
    texts += ["".join(rng.choices('ab,"\n é', k=rng.randrange(1, 40))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for t, text in df.select("t", files.csv_content(F.col("t"))).collect():
        assert text == "\n".join(", ".join(r) for r in csv.reader(io.StringIO(t))), repr(t[:60])


@pytest.mark.parametrize("path,expected", [
    ("/a/b.TXT", ".txt"), ("/a/b.tar.md", ".md"), ("/a/.txt", ""), ("/a.b/c", ""), ("c.pdf", ".pdf"),
])
def test_suffix(spark, path, expected):
    assert spark.range(1).select(suffix(F.lit(path))).first()[0] == expected


def test_markdown_blocks(spark):
    text = "# One #\nintro line\nsecond line\n- a\n- b\n\n## Two\n1. first\n2. second\n\npara **b** <x>\n"
    docs = spark.createDataFrame([("d", text)], "file_path STRING, text STRING")
    rows = [(r.block_no, r.kind, r.level, r.text) for r in markup.markup_blocks(docs).collect()]
    assert rows == [
        (0, "heading", 1, "One"), (1, "paragraph", 0, "intro line\nsecond line"), (2, "bullet", 0, "a"),
        (3, "bullet", 0, "b"), (4, "heading", 2, "Two"), (5, "number", 0, "first"), (6, "number", 0, "second"),
        (7, "paragraph", 0, "para **b** <x>"),
    ]


#: Markdown texts and the HTML that they give.
RENDERED = [
    ("# Heading", "<h1>Heading</h1>"),
    ("", ""),
    ("`a*b*c` and `` x`y ``", "<p><code>a*b*c</code> and <code>x`y</code></p>"),
    ("a <b>bold</b> & &amp; 1 < 2", "<p>a <b>bold</b> &amp; &amp; 1 &lt; 2</p>"),
    ("_em_ __strong__ snake_case_name", "<p><em>em</em> <strong>strong</strong> snake_case_name</p>"),
    ("**a *b* c** ***d***", "<p><strong>a <em>b</em> c</strong> <strong><em>d</em></strong></p>"),
    ("2 * 3 * 4 and \\*kept\\*", "<p>2 * 3 * 4 and *kept*</p>"),
    ("```\n# not a heading\n\n*x* <y>\n```\nafter", "<pre><code># not a heading\n\n*x* &lt;y&gt;\n</code></pre>\n<p>after</p>"),
    ("~~~\nnever closed\n- x", "<pre><code>never closed\n- x</code></pre>"),
    ("- a\n    1. b\n    2. c\n- d", "<ul>\n<li>a<ol>\n<li>b</li>\n<li>c</li>\n</ol>\n</li>\n<li>d</li>\n</ul>"),
    ("- a\nmore of a\n- b\n\n1. c", "<ul>\n<li>a\nmore of a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>"),
    ("- a\n        - skips a level\n    - b", "<ul>\n<li>a<ul>\n<li>skips a level</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>"),
    ("<div>\n*raw*\n</div>\n\n*not raw*", "<div>\n*raw*\n</div>\n<p><em>not raw</em></p>"),
    ("Top\n===\n\nSub\n---\n\n---", "<h1>Top</h1>\n<h2>Sub</h2>\n<hr />"),
    ("> said\n> twice", "<blockquote>\n<p>said\ntwice</p>\n</blockquote>"),
    ("[x](http://h/a_b_c*d) ![i](p.png) <http://u/v>", '<p><a href="http://h/a_b_c*d">x</a> <img alt="i" src="p.png" /> <a href="http://u/v">http://u/v</a></p>'),
    ("one  \ntwo\n\n\n\nthree", "<p>one<br />\ntwo</p>\n<p>three</p>"),
    ("    code <x>\n    more", "<pre><code>code &lt;x&gt;\nmore\n</code></pre>"),
]


def test_markdown_texts(spark):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in RENDERED)), "i INT, text STRING")
    got = {r.i: r.html for r in docs.select("i", markdown.markdown_html(F.col("text")).alias("html")).collect()}
    for i, (text, html) in enumerate(RENDERED):
        assert got[i] == html, text


def test_long_markdown_is_linear(spark):
    """Items, fences, stars and backticks by the ten thousand, in one text each."""
    n = 20_000
    texts = ["- item\n" * n, "* a\nb\n" * n, "```\nx\n```\n" * n, "*" * n, "x * " * n, "_a " * n, "`" * n, "<" * n, "[" * n, "line\n" * n, "    code\n" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    sizes = {r.i: r.n for r in docs.select("i", F.length(markdown.markdown_html(F.col("text"))).alias("n")).collect()}
    assert sizes[0] == len("<li>item</li>\n") * n + len("<ul>\n</ul>") and all(sizes[i] > 0 for i in range(len(texts)))


def test_few_changed_files_are_opened_by_name(spark, tmp_path, monkeypatch):
    from passageworks.plans.ingest import incremental_ingest

    root = tmp_path / "docs"
    root.mkdir()
    for i in range(30):
        (root / f"f{i} [x]{{y}}.txt").write_text("words " * 1000 + str(i))
    corpus = files.Folder(spark, str(root))
    state_dir = str(tmp_path / "c")
    incremental_ingest(spark, corpus, state_dir)
    for i in (3, 9):
        (root / f"f{i} [x]{{y}}.txt").write_text("other words")
    read = []
    real = files.scan_corpus

    def spy(spark, root, glob=None):
        rows = real(spark, root, glob)
        read.append((root, rows.agg(F.sum("length")).first()[0]))
        return rows

    monkeypatch.setattr(files, "scan_corpus", spy)
    incremental_ingest(spark, corpus, state_dir).collect()
    # one scan of all bytes for the hashes, then the two changed files alone
    by_name = [size for place, size in read if isinstance(place, list)]
    assert by_name and all(size == 2 * len("other words") for size in by_name)
    assert sum(not isinstance(place, list) for place, _ in read) <= 3
    changed = spark.createDataFrame([(str(root / f"f{i} [x]{{y}}.txt"),) for i in (3, 9)], "file_path STRING")
    assert corpus.only(changed).count() == 2 and corpus.only(changed.limit(0)).count() == 0
    monkeypatch.setattr(files, "PATHS", 1)
    assert corpus.only(changed).count() == 2


def test_html_blocks(spark):
    html = ("<html><head><style>p{x}</style><script>if (a<b) '</p>'</script></head><body><!-- no -->"
            "<h2 class='t'>Head</h2><p>One &amp; <b>two</b></p><ul><li>x &lt; y</li></ul>tail</body>")
    docs = spark.createDataFrame([("d", html)], "file_path STRING, text STRING")
    rows = [(r.kind, r.level, r.text) for r in markup.markup_blocks(docs, flavour="html").collect()]
    assert rows == [("heading", 2, "Head"), ("paragraph", 0, "One & two"), ("bullet", 0, "x < y"),
                    ("paragraph", 0, "tail")]


def test_history(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0, "q", "a")], "session_id LONG, turn LONG, question STRING, answer STRING")
    where = str(tmp_path / "history")
    for day in ("2024-01-02", "2024-01-03", "2024-01-03"):
        history.write_history(pairs, where, F.to_date(F.lit(day)))
    counts = {str(r.day): r["count"] for r in history.read_history(spark, where).groupBy("day").count().collect()}
    assert counts == {"2024-01-02": 1, "2024-01-03": 2}


def test_single_files_lie_in_shared_folders_and_are_listed_once(spark, tmp_path, monkeypatch):
    rows = [(n, f"{n % 100}", f"text {n}") for n in (1, 101, 203)] + [(7, "7", "b"), (7, "7", "a"), (8, "8", None)]
    texts = spark.createDataFrame(rows, "doc_id LONG, shelf STRING, text STRING")
    for place in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        files.write_files(texts, place, ["shelf", "doc_id"])
        read = {r["file_path"].split(place.split("/")[-1] + "/", 1)[1].rsplit("/", 1)[0]: bytes(r["content"]) for r in files.scan_corpus(spark, place).collect()}
        assert read == {
            "shelf=1/doc_id=1": b"text 1\n", "shelf=1/doc_id=101": b"text 101\n", "shelf=3/doc_id=203": b"text 203\n",
            "shelf=7/doc_id=7": b"a\nb\n", "shelf=8/doc_id=8": b"\n",
        }

    from passageworks.plans.ingest import incremental_ingest

    listings, scan = [], files.scan_corpus
    monkeypatch.setattr(files, "scan_corpus", lambda spark, root, glob=None: listings.append(root) or scan(spark, root, glob))
    for _ in range(2):
        incremental_ingest(spark, files.Folder(spark, str(tmp_path / "a")), str(tmp_path / "state"))
    assert listings == [str(tmp_path / "a")] * 2


def test_mounted_folders_are_listed_by_tasks_as_by_sparks_reader(spark, tmp_path, monkeypatch):
    """Hidden and odd names, empty files, links, patterns, single files, paths that lie in each other."""
    root = tmp_path / "top [1]"
    for name in (
        "a.txt", "b.MD", "empty.txt", ".hidden.txt", "_marked.txt", "_k=1.txt", "_common_metadata", "_metadata/g.txt", "x._COPYING_", "100%41 é#?.txt", "sub/c.txt", "sub/deep/er/d.md",
        ".git/config", "_tmp/e.txt", "_k=2/f.txt", "sub/no suffix",
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else f"in {name}\r\n".encode())
    (root / "bare").mkdir()
    (root / "linked").symlink_to(root / "sub")
    (root / "lost").symlink_to(root / "nowhere")
    named = str(root).replace("[", "\\[").replace("]", "\\]")
    asked = [
        (named, None), (f"file:{named}", "*.{md,txt}"), (f"{named}/", "[a-c]?*"), (f"{named}/s*", None), (f"{named}/*", None), ([f"{named}/a.txt", f"{named}/sub/c.txt"], None),
        ([named, f"{named}/sub", f"{named}/_tmp", named], None), ([f"{named}/bare"], None), (f"{named}/sub", "nothing*"),
    ]

    def seen():
        found = [files.scan_corpus(spark, str(r) if isinstance(r, str) else r, g) for r, g in asked]
        assert {f.schema.simpleString() for f in found} == {"struct<file_path:string,suffix:string,modified_at:timestamp,length:bigint,content:binary>"}
        return found, [sorted((r.file_path, r.suffix, r.modified_at, r.length, bytes(r.content)) for r in f.collect()) for f in found]

    plans, by_tasks = seen()
    assert not any("binaryFile" in f._jdf.queryExecution().toString() for f in plans)
    # without the contents no file is opened
    assert "ArrowEvalPython" not in plans[0].drop("content")._jdf.queryExecution().executedPlan().toString()
    with monkeypatch.context() as m:
        m.setattr(files, "_mounted", lambda spark, paths: None)
        assert seen()[1] == by_tasks and len(by_tasks[0]) == 12 and not by_tasks[-1]
    for gone in (str(tmp_path / "none"), str(tmp_path / "none*")):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files.scan_corpus(spark, gone)


def test_tasks_of_a_scan_follow_bytes_and_not_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 7}" / f"{i}.txt").write_text("text " * i)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        scanned = files.scan_corpus(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "late.txt").write_text("not there when the folder was listed")
    assert scanned.agg(F.count("content"), F.sum("length"), F.sum(F.length("content"))).first()[:] == (299, 5 * 150 * 299, 5 * 150 * 299)
