"""Probes of unknown pages."""

from pyspark.sql import functions as F

from dossier.sources import html, probes

PAGE = """<body><a href="/a/x.PDF">one</a><a href="y?f=z.docx&amp;k=1">two</a><a href="http://o.org/getFile/9">three</a><a href="#top">up</a>
<a href="javascript:go()">go</a><a href="//cdn.org/q">plan.zip</a><a href="next">more</a><a href="/list/2">2</a><a href="/list/17">last</a><script>downloadDoc(1); download</script><p>download it</p></body>"""


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_targets(spark):
    target = lambda href, base: one(spark, probes.absolute(F.lit(href), F.lit(base)))
    base = "https://h.org/a/b?q=1#f"
    assert [target(x, base) for x in ("c", "/c", "//o/c", "ftp://o/c", "?x=1")] == ["https://h.org/a/c", "https://h.org/c", "https://o/c", "ftp://o/c", "https://h.org/a/?x=1"]
    assert target("c", "https://h.org") == "https://h.org/c"


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h.org/d/p", PAGE), (2, "http://h.org", None)], "k int, url string, html string")
    nodes = html.nodes(pages, "k")
    got = [(r.kind, r.extension, r.target) for r in probes.classified_links(pages, nodes, "k", "url").orderBy("node").collect()]
    assert got == [
        ("document", "pdf", "http://h.org/a/x.PDF"), ("document", "docx", "http://h.org/d/y?f=z.docx&k=1"), ("document_hint", None, "http://o.org/getFile/9"), ("script", None, None), ("script", None, None),
        ("document", "zip", "http://cdn.org/q"), ("other", None, "http://h.org/d/next"), ("other", None, "http://h.org/list/2"), ("other", None, "http://h.org/list/17"),
    ]
    assert [tuple(r) for r in probes.pagination(nodes, "k", r"^/list/(\d+)$").collect()] == [(1, 17, "/list/2")]
    counts = pages.where("k = 1").select(*probes.word_counts(F.col("html"), ["download"])).first()
    assert tuple(counts) == (2, 1)


def test_labels_and_names(spark):
    pages = spark.createDataFrame([(1, "<dt>Last  DAY</dt><dt>price a</dt><dt>Price b</dt><dt>value c</dt><dt>price d</dt>")], "k int, html string")
    got = probes.keyword_fields(html.nodes(pages, "k"), "k", ("dt",), {"deadline": ("last day",), "value": ("price", "value")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "deadline", "Last DAY"), (1, "value", "Price b"), (1, "value", "price a"), (1, "value", "value c")]
    listed = spark.createDataFrame([(1, "A b.docx"), (1, "c.docx")], "k int, name string")
    shown = spark.createDataFrame([(1, "a B.DOCX"), (2, "c.docx")], "k int, name string")
    assert sorted((r.name, r.on_page) for r in probes.matched_names(listed, shown, "k", "name").collect()) == [("A b.docx", True), ("c.docx", False)]
