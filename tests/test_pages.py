"""Pieces of text, and nested shapes against trees built by hand."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from dossier.sources import html


def pieces(spark, page):
    rows = html.nodes(spark.createDataFrame([(1, page)], "id long, html string"), "id", tags=("dd", "br", html.TEXT)).orderBy("node").collect()
    return [(r.tag, r.text) for r in rows]


def test_pieces_of_text(spark):
    assert pieces(spark, "a &amp; b<br>c <!-- d --> e<dd>f<i>g</i>h</dd><script>no</script> 1 < 2") == [
        ("#text", "a & b"), ("br", ""), ("#text", "c "), ("#text", " e"), ("dd", "fgh"), ("#text", "f"), ("#text", "g"), ("#text", "h"), ("#text", " 1 < 2"),
    ]
    page = spark.createDataFrame([(1, "<p>x</p>")], "id long, html string")
    assert [r.tag for r in html.nodes(page, "id").collect()] == ["p"]  # without being asked for they are no nodes


def test_lines_and_links(spark):
    page = "<dl><dt>Codes:</dt><dd> <br> </dd><dt>codes</dt><p>between</p><dd>1<br><b>2</b> 3<br/></dd><dt>Codes</dt><dd>late</dd></dl><a href='/y'>1</a><i><a href=' /m/1 '>2</a></i><a href='/m/0'>3</a>"
    nodes = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string"), "id", tags=("dt", "dd", "a", html.TEXT))
    lines = html.labelled_lines(nodes, "id", F.col("tag") == "dt", F.col("tag") == "dd", {"codes": "c"})
    assert [tuple(r) for r in lines.collect()] == [(1, "c", ["1", "2", "3"])]
    assert [tuple(r) for r in html.first_link(nodes, "id", "/m/").collect()] == [(1, "/m/1")]


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack = [["", (), (), []]]

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        node = [tag, tuple(sorted((names.get("class") or "").split())), tuple(sorted(names)), []]
        self.stack[-1][3].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()


def shapes(node):
    """All subtrees as tuples, the node's own last."""
    below = [shapes(c) for c in node[3]]
    own = (*node[:3], tuple(b[-1] for b in below))
    return [s for b in below for s in b] + [own]


def random_page(rng, depth=0):
    tag = rng.choice(["div", "p", "b"])
    attrs = rng.choice(["", ' class="x y"', ' class="y  x"', ' class="x"', ' id="1"', f' id="{rng.random()}" class="x"'])
    return f"<{tag}{attrs}>t{''.join(random_page(rng, depth + 1) for _ in range(rng.randrange(0, 3 if depth < 3 else 1)))}</{tag}>"


def test_signatures(spark):
    rng = random.Random(3)
    pages = [(k, "".join(random_page(rng) for _ in range(rng.randrange(0, 4)))) for k in range(60)]
    trees = html.subtrees(html.nodes(spark.createDataFrame(pages, "id long, html string"), "id"), "id").collect()
    expected = {}
    for k, page in pages:
        parser = Tree()
        parser.feed(page)
        expected[k] = [s for root in parser.stack[0][3] for s in shapes(root)]
    names: dict = {}
    for k, _ in pages:
        own = sorted((r for r in trees if r.id == k), key=lambda r: r.node)
        assert len(own) == len(expected[k])
        assert sorted(r.size for r in own) == sorted(map(count, expected[k]))
        got = {r.signature for r in own}
        assert len(got) == len(set(expected[k]))
        for s in set(expected[k]):
            names.setdefault(s, []).append(k)
    by_signature: dict = {}
    for r in trees:
        by_signature.setdefault(r.signature, set()).add(r.id)
    assert sorted(map(sorted, by_signature.values())) == sorted(map(sorted, names.values()))


def count(shape):
    return 1 + sum(count(c) for c in shape[3])


def test_smallest_differences(spark):
    rng = random.Random(5)
    old, new = ([(k, "".join(random_page(rng) for _ in range(3))) for k in range(30)] for _ in range(2))
    trees = [html.subtrees(html.nodes(spark.createDataFrame(p, "id long, html string"), "id"), "id") for p in (new, old)]
    got = html.subtree_differences(*trees, "id").collect()
    rows = [t.collect() for t in trees]
    known = {(r.id, r.signature) for r in rows[1]}
    lacking = [r for r in rows[0] if (r.id, r.signature) not in known]
    parents = {(r.id, r.parent) for r in lacking}
    assert sorted((r.id, r.node) for r in got) == sorted((r.id, r.node) for r in lacking if (r.id, r.node) not in parents)
    assert 0 < len(got) < len(lacking)


def test_differences_of_pages_are_merged(spark):
    rows = html.subtrees(html.nodes(spark.createDataFrame([(1, "<p><b>1</b></p>")], "id long, html string"), "id"), "id")
    for joined in (html.subtree_differences(rows, rows, "id"), html.known_shapes(rows, rows, "id", F.lit(True))):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_by_many_tasks(spark):
    from dossier.queries import pages

    assert pages._customers(spark, "/root/testdata/sf0.001", F.lit("<p>")).rdd.getNumPartitions() >= 16


def test_plain_pages_have_the_parsers_nodes():
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<b class=\"x  y\" id=\"1\">", "</b>", "<br>", "<br/>", "<br />", "<a href=\"/1?x=1>\">", "<a href=\"/é\" href=\"/2\" rel=\"\">", "</a>", "<i title=\"a&lt;b\">", "</i>", "<P>", "t", " \n", "1 &lt 2", "&amp;", " > ", " < ", "<!-- c -->", "<title>", "</title>", "<script>", "</script>", "<hr", "</br>", "<li/>", "<!x", "&#65", "<a b='c'>"]
    plain = 0
    for _ in range(4000):
        page = "".join(rng.choices(parts[: rng.choice((8, 11, 17, len(parts)))], k=rng.randrange(12)))
        for pieces_too in (False, True):
            slow, fast = html._Nodes(pieces_too), html._Nodes(pieces_too)
            plain += html._Nodes(pieces_too)._plain(page)
            slow.feed(page)
            slow.close()
            while slow.open:
                slow._shut()
            fast.read(page)
            said = lambda n: [(*t, end, "".join(n.said[a:b])) for t, end, (a, b) in zip(n.tags, n.last, n.spans, strict=True)]
            assert said(fast) == said(slow), page
    assert plain > 1000
