import hashlib

from pyspark.sql import functions as F

from attestry.operators import integrity as I
from attestry.operators import reports as R
from attestry.sources.pages import page_extract


def report(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def blocks(spark, text):
    return [(r["kind"], r["content"]) for r in R.report_blocks(report(spark, text)).orderBy("n").collect()]


def test_sections(spark):
    text = "lead\n## A\n\nbody a\n### B\n## C\nbody c\n# not a section"
    assert [(r["title"], r["body"]) for r in R.report_sections(report(spark, text)).orderBy("n").collect()] == [
        ("摘要", "lead"), ("A", "body a"), ("C", "body c\n# not a section")]


def test_sections_may_be_limited(spark):
    text = "\n".join(f"## H{i}\nbody" for i in range(30))
    assert R.report_sections(report(spark, text)).count() == 30
    assert R.report_sections(report(spark, text), most_sections=20).count() == 20


def test_blocks(spark):
    text = "# T\nplain one\nplain two\n\n> q\n- a\n* b\n![i](x.jpg)\n|k|v|\n|--|--|\n|1|2|\nafter\n"
    assert blocks(spark, text) == [
        ("h1", "T"), ("paragraph", "plain one plain two"), ("quote", "q"), ("bullet", "a"), ("bullet", "b"),
        ("image", "![i](x.jpg)"), ("table", "|k|v|\n|--|--|\n|1|2|"), ("paragraph", "after")]


def test_pipe_lines_without_a_rule_are_text(spark):
    assert blocks(spark, "|a|\nplain\n|b|\n|c|\n|--|\n|d|\nend") == [
        ("paragraph", "|a| plain"), ("paragraph", "|b|"), ("table", "|c|\n|--|\n|d|"), ("paragraph", "end")]


def test_tables(spark):
    rows = R.report_tables(report(spark, "|k|v|\n|:--|--:|\n| 1 |2|\n\ntext\n|x|\n|--|")).orderBy("table_no", "row_no", "col_no").collect()
    assert [(r["table_no"], r["row_no"], r["col_no"], r["cell"]) for r in rows] == [
        (1, 1, 1, "k"), (1, 1, 2, "v"), (1, 2, 1, "1"), (1, 2, 2, "2"), (2, 1, 1, "x")]


def test_links_and_safe_images(spark):
    text = "[a](https://e.com) ![x](f/x.jpg) ![y](../y.jpg) ![z](/z.jpg) ![w](https://e.com/w.jpg) ![v](f/../v.jpg) " + " ".join(
        f"![p](p{i}.jpg)" for i in range(30))
    rows = R.report_links(report(spark, text), most_images=24).collect()
    images = sorted((r["n"], r["target"]) for r in rows if r["kind"] == "image")
    assert [r["target"] for r in rows if r["kind"] == "link"] == ["https://e.com"]
    assert images[:2] == [(1, "f/x.jpg"), (2, "f/../v.jpg")] and len(images) == 24


def test_inline(spark):
    df = report(spark, 'a <b> "q" & [l](https://e.com?a=1&b) `c` **d**')
    assert df.select(R.inline_render(F.col("text"))).first()[0] == (
        'a &lt;b&gt; &quot;q&quot; &amp; <link href="https://e.com?a=1&amp;b" color="#0066cc">l</link> '
        '<font face="Courier">c</font> <b>d</b>')


def test_graph(spark):
    nodes, edges = R.section_graph(report(spark, "lead\n## A b\nx\n![f](frames/F1.JPG)\n## C\ny"))
    got = {r["file"]: r for r in nodes.collect()}
    assert set(got) == {"cards/01_摘要.md", "cards/02_A-b.md", "cards/03_C.md", "assets/01_F1.jpg"}
    assert got["cards/02_A-b.md"]["node_id"] == hashlib.sha256("02_A-b.md".encode()).hexdigest()[:16]
    assert got["cards/03_C.md"]["y"] == 600 and got["assets/01_F1.jpg"]["x"] == 620
    links = {(r["edge_id"], r["from_node"], r["to_node"]) for r in edges.collect()}
    name = lambda f: got[f]["node_id"]
    assert links == {("e002", name("cards/01_摘要.md"), name("cards/02_A-b.md")), ("e003", name("cards/02_A-b.md"), name("cards/03_C.md"))}


def test_verify_finds_exactly_the_changed_row(spark):
    df = spark.range(50).selectExpr("concat('f', id, '.md') as name", "repeat(cast(id as string), 5) as content")
    manifest = I.content_manifest(df)
    header = I.manifest_header(manifest)
    assert I.manifest_verify(manifest, manifest, header).count() == 0
    changed = I.content_manifest(df.withColumn("content", F.when(F.col("name") == "f7.md", F.concat("content", F.lit("x"))).otherwise(F.col("content"))))
    assert [tuple(r) for r in I.manifest_verify(manifest, changed, header).collect()] == [("f7.md", "hash mismatch")]
    assert [tuple(r) for r in I.manifest_verify(changed, manifest, header).collect()] == [("(header)", "hash mismatch")]
    other = header.withColumn("schema_tag", F.lit("v0"))
    assert [tuple(r) for r in I.manifest_verify(manifest, manifest, other).collect()] == [("(header)", "unsupported schema")]
    assert I.manifest_verify(manifest, manifest, header.filter("false")).first()["error"] == "hash mismatch"


def test_unsafe_names(spark):
    df = spark.createDataFrame([(n, "x") for n in ("a.md", "../a.md", "/a.md", "C:a.md", "d/../a.md", "d/../../a.md")], "name string, sha256 string")
    bad = {r["name"] for r in I.manifest_verify(df, df).collect()}
    assert bad == {"../a.md", "/a.md", "C:a.md", "d/../../a.md"}


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"there")
    got = {r["name"]: r["sha256"] for r in I.file_manifest(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"sub/a.txt": hashlib.sha256(b"hello").hexdigest(), "b.txt": hashlib.sha256(b"there").hexdigest()}


def test_page_extract(spark):
    html = ("<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav><a href='/n'>n</a></nav>"
            "<script>var t='</p>';</script><h1>Head</h1><p>One <b>two</b>\nthree <a href='https://e.com'>link</a>.</p><footer>f</footer></body>")
    df = spark.createDataFrame([(1, "https://host.org/x", html), (2, "https://Host.org/y", "<p> </p>"), (3, "z", None)],
                               "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_extract(df).collect()}
    assert (got[1]["title"], got[1]["text"]) == ("A & B", "Head\nOne two three [link](https://e.com).")
    assert [tuple(x) for x in got[1]["links"]] == [("link", "https://e.com")]
    assert not got[2]["success"] and got[2]["title"] == "host.org" and got[3]["title"] == "z"
