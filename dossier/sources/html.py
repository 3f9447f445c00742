"""HTML pages as rows of nodes.

One small parser turns a page into nodes with their places: a node holds what opens
after it and before its end, so that containment is a comparison of numbers, and
everything that pages are asked for is joins and aggregates over nodes of a page.
Pieces of text are nodes as well where they are asked for (tag #text): what stands
between two tags.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import collapsed, label
from dossier.store import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))
BATCH_TEXT = 16 << 20  #: characters of text in a batch of nodes
BATCH_ROWS = 50_000  #: nodes in a batch
TEXT = "#text"
NODE = "node int, parent int, `last` int, tag string, attrs map<string,string>, text string"


class _Nodes(HTMLParser):
    """Nodes in order; text is what a node and the nodes in it say, without scripts and styles."""

    def __init__(self, pieces: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces, self.piece = pieces, None  #: the piece of text that goes on
        self.tags: list[tuple[int, str, dict]] = []
        self.last: list[int] = []
        self.spans: list[list[int]] = []
        self.open: list[int] = []
        self.said: list[str] = []
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.piece = None
        self.tags.append((self.open[-1] if self.open else -1, tag, {k: v or "" for k, v in attrs}))
        self.last.append(len(self.tags) - 1)
        self.spans.append([len(self.said), len(self.said)])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.piece = None
        if any(self.tags[k][1] == tag for k in self.open):
            while self._shut() != tag:
                pass

    def _shut(self) -> str:
        k = self.open.pop()
        self.last[k], self.spans[k][1] = len(self.tags) - 1, len(self.said)
        return self.tags[k][1]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.tags[self.open[-1]][1] in HIDDEN):
            self.said.append(data)
            if self.pieces:
                if self.piece is None:
                    self.piece = len(self.tags)
                    self.tags.append((self.open[-1] if self.open else -1, TEXT, {}))
                    self.last.append(self.piece)
                    self.spans.append([len(self.said) - 1, len(self.said)])
                self.spans[self.piece][1] = len(self.said)

    def handle_comment(self, data: str) -> None:
        self.piece = None

    def read(self, html: str) -> None:
        """Pages of plain tags and texts go by regular expressions; others through the parser, with the same nodes."""
        if not self._plain(html):
            self.__init__(self.pieces)
            self.feed(html)
            self.close()
        while self.open:
            self._shut()

    def _plain(self, html: str) -> bool:
        for text, raw in _TOKENS.findall(html):
            if raw:
                known = _plain_tag(raw)
                if known is None:
                    return False
                kind, tag, attrs = known
                if kind == 0:
                    self.handle_starttag(tag, attrs)
                elif kind == 1:
                    self.handle_endtag(tag)
                else:
                    self.handle_startendtag(tag, attrs)
            elif "<" in text:
                return False
            else:
                self.handle_data(unescape(text) if "&" in text else text)
        return True


_TOKENS = re.compile(r"([^<]+|<(?![^<>]*>))|(<[^<>]*>)")
_PLAIN_TAG = re.compile(r"""<([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z-]*="[^"&]*")*)[ ]?(/?)>|</([a-z][a-z0-9]*)>""")
_PLAIN_ATTR = re.compile(r"""([a-z][a-z-]*)="([^"&]*)\"""")
#: Elements whose insides are no tags, or that change how what follows is read.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext svg math template select".split())


@lru_cache(maxsize=1 << 12)
def _plain_tag(raw: str) -> tuple[int, str, list] | None:
    """Kind (0 opens, 1 ends, 2 both), name and attributes of a tag that is written in the plainest way; null for others."""
    m = _PLAIN_TAG.fullmatch(raw)
    if m is None or (m[1] or m[4]) in _RAW:
        return None
    return (1, m[4], []) if m[4] else (2 if m[3] else 0, m[1], _PLAIN_ATTR.findall(m[2]) if m[2] else [])


class _Rows:
    """Nodes in columns, until there is enough of them for a batch."""

    def __init__(self, most_text: int | None, tags: tuple[str, ...], said: tuple[str, ...]) -> None:
        self.most_text, self.tags, self.said = most_text, frozenset(tags), frozenset(said)
        self.begin()

    def begin(self) -> None:
        self.at, self.node, self.parent, self.last, self.tag, self.text = [], [], [], [], [], []
        self.names, self.values, self.offsets, self.size = [], [], [0], 0

    def add(self, i: int, page: _Nodes) -> Iterator[None]:
        """Takes a page's nodes, and stops wherever a batch is full."""
        tags, said, most = self.tags, self.said, self.most_text
        for k, (parent, tag, attrs) in enumerate(page.tags):
            if tags and tag not in tags:
                continue
            text = ""
            if most != 0 and (not said or tag in said):
                a, b = page.spans[k]
                text = page.said[a] if b == a + 1 else "".join(page.said[a:b])
                text = text if most is None else text[:most]
                self.size += len(text)
            self.at.append(i)
            self.node.append(k)
            self.parent.append(parent)
            self.last.append(page.last[k])
            self.tag.append(tag)
            self.text.append(text)
            if attrs:
                self.names.extend(attrs)
                self.values.extend(attrs.values())
            self.offsets.append(len(self.names))
            if self.size > BATCH_TEXT or len(self.at) >= BATCH_ROWS:
                yield

    def made(self, keys: pa.Array, key: str) -> pa.RecordBatch:
        attrs = pa.MapArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        numbers = [pa.array(c, pa.int32()) for c in (self.node, self.parent, self.last)]
        out = pa.RecordBatch.from_arrays([keys.take(pa.array(self.at, pa.int64())), *numbers, pa.array(self.tag, pa.string()), attrs, pa.array(self.text, pa.string())], names=[key, "node", "parent", "last", "tag", "attrs", "text"])
        self.begin()
        return out


def nodes(pages: DataFrame, key: str, html: str = "html", most_text: int | None = None, tags: tuple[str, ...] = (), said: tuple[str, ...] = ()) -> DataFrame:
    """key and NODE columns of each element, or of those with some tags.  Null pages have none.

    A node's text is whole, or cut at most_text where that is given; with said, only nodes of these tags have a text, others an empty one.
    Pieces of text are nodes if tags has TEXT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(most_text, tags, said)
        for batch in batches:
            keys = batch.column(key)
            for i, page in enumerate(batch.column(html)):
                parsed = _Nodes(TEXT in tags)
                parsed.read(page.as_py() or "")
                for _ in rows.add(i, parsed):
                    yield rows.made(keys, key)
            yield rows.made(keys, key)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {NODE}")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)


def inside(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Pairs of an outer node and a node in it: key, outer_node and inner's columns."""
    o = outer.select(key, F.col("node").alias("outer_node"), F.col("last").alias("outer_last"))
    return inner.join(o, key).where((F.col("node") > F.col("outer_node")) & (F.col("node") <= F.col("outer_last"))).drop("outer_last")


def links(page_nodes: DataFrame, key: str) -> DataFrame:
    """key, node, href, text of each link."""
    return page_nodes.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select(key, "node", F.trim(F.col("attrs")["href"]).alias("href"), collapsed(F.col("text")).alias("text"))


def list_items(page_nodes: DataFrame, key: str, item: Column, title: Column, time: Column) -> DataFrame:
    """Entries of list pages: key, item_node, title, href, filename, file_type, raw_time; entries without a titled link are left out.

    Entries don't nest, so that the entry a node is in is the last one that opened before it; one pass over a page's nodes.
    """
    order = W.partitionBy(key).orderBy("node")
    opened = lambda c: F.last(F.when(c, F.struct("node", "last")), ignorenulls=True).over(order)
    placed = spread(page_nodes, key).withColumns({"_item": opened(item), "_title": opened(title), "_is_time": time})
    placed = placed.where((F.col("node") > F.col("_item.node")) & (F.col("node") <= F.col("_item.last")))
    linked = (F.col("tag") == "a") & (F.col("node") > F.col("_title.node")) & (F.col("node") <= F.col("_title.last")) & (F.col("_title.node") > F.col("_item.node"))
    first = lambda c, value: F.min_by(value, F.when(c, F.col("node")))
    found = placed.groupBy(key, F.col("_item.node").alias("item_node")).agg(
        first(linked, F.struct(F.trim("text").alias("title"), F.col("attrs")["href"].alias("href"))).alias("a"),
        first(F.col("_is_time"), F.col("text")).alias("raw_time"),
        F.max(linked).alias("_linked"),
    )
    name = F.element_at(F.split(F.coalesce("a.href", F.lit("")), "/"), -1)
    kind = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return found.where("_linked").select(key, "item_node", "a.title", "a.href", name.alias("filename"), kind.alias("file_type"), F.coalesce("raw_time", F.lit("")).alias("raw_time"))


def labelled_values(page_nodes: DataFrame, key: str, is_label: Column, is_value: Column, fields: dict[str, str]) -> DataFrame:
    """Values beside known labels: key, field, value; a value is the next sibling that can be one, and a field's first value that says something wins."""
    name = F.lit(None).cast("string")
    for said, field in fields.items():
        name = F.when(label(F.col("text")) == said, field).otherwise(name)
    later = W.partitionBy(key, "parent").orderBy("node").rowsBetween(1, W.unboundedFollowing)
    rows = spread(page_nodes.where(is_label | is_value), key).withColumns({"field": F.when(is_label, name), "_value": F.when(is_value, collapsed(F.col("text")))})
    beside = rows.withColumn("value", F.first("_value", ignorenulls=True).over(later)).where("field IS NOT NULL AND value <> ''")
    return beside.groupBy(key, "field").agg(F.min_by("value", "node").alias("value"))


def labelled_lines(page_nodes: DataFrame, key: str, is_label: Column, is_value: Column, fields: dict[str, str]) -> DataFrame:
    """As labelled_values, with lines: the pieces of text in the value one by one, as breaks and tags part them; blank ones are left out, and a value without any says nothing.

    page_nodes hold pieces of text.  Values don't nest.
    """
    name = F.lit(None).cast("string")
    for said, field in fields.items():
        name = F.when(label(F.col("text")) == said, field).otherwise(name)
    order, later = W.partitionBy(key).orderBy("node"), W.partitionBy(key, "parent").orderBy("node").rowsBetween(1, W.unboundedFollowing)
    rows = spread(page_nodes.where(is_label | is_value | (F.col("tag") == TEXT)), key).withColumns({"field": F.when(is_label, name), "_value": F.when(is_value, F.col("node"))})
    opened = F.last(F.when(is_value, F.struct("node", "last")), ignorenulls=True).over(order)
    rows = rows.withColumns({"_of": F.when(is_label, F.first("_value", ignorenulls=True).over(later)), "_in": opened})
    pieces = rows.where((F.col("tag") == TEXT) & (F.col("node") > F.col("_in.node")) & (F.col("node") <= F.col("_in.last"))).select(key, F.col("_in.node").alias("_of"), "node", collapsed(F.col("text")).alias("line")).where("line <> ''")
    lines = pieces.groupBy(key, "_of").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda p: p["line"]).alias("lines"))
    beside = rows.where("field IS NOT NULL AND _of IS NOT NULL").select(key, "field", "node", "_of").join(lines.hint("merge"), [key, "_of"])
    return beside.groupBy(key, "field").agg(F.min_by("lines", "node").alias("lines"))


def first_link(page_nodes: DataFrame, key: str, marker: str) -> DataFrame:
    """key, href of each page's first link whose address holds the marker."""
    return links(page_nodes, key).where(F.col("href").contains(marker)).groupBy(key).agg(F.min_by("href", "node").alias("href"))


def table_cells(page_nodes: DataFrame, key: str) -> DataFrame:
    """Cells of tables by their headers: key, table_node, row_node, header, value; cells beyond the headers are left out.

    A cell's table is the last one that opened before it and isn't closed; one pass over a page's nodes.
    """
    opened = F.last(F.when(F.col("tag") == "table", F.struct("node", "last")), ignorenulls=True).over(W.partitionBy(key).orderBy("node"))
    rows = spread(page_nodes, key).withColumn("_table", opened).where(F.col("tag").isin("th", "td") & (F.col("node") <= F.col("_table.last")))
    rows = rows.select(key, F.col("_table.node").alias("table_node"), F.when(F.col("tag") == "td", F.col("parent")).alias("row_node"), "node", "text")
    place = F.row_number().over(W.partitionBy(key, "table_node", "row_node").orderBy("node"))
    rows = rows.withColumn("_place", place)
    is_head = F.col("row_node").isNull()
    heads = F.collect_list(F.when(is_head, F.struct("_place", label(F.col("text")).alias("header")))).over(W.partitionBy(key, "table_node"))
    cells = rows.withColumn("_heads", heads).where(~is_head)
    header = F.get(F.filter("_heads", lambda h: h["_place"] == F.col("_place")), F.lit(0))["header"]
    return cells.select(key, "table_node", "row_node", header.alias("header"), collapsed(F.col("text")).alias("value")).where("header IS NOT NULL")


def structure(page_nodes: DataFrame, key: str) -> DataFrame:
    """Shapes of a page: key, tag, classes, attributes, n; what one page has and another lacks is a difference of these."""
    names = F.array_join(F.array_sort(F.map_keys("attrs")), ",")
    return page_nodes.groupBy(key, "tag", F.coalesce(F.col("attrs")["class"], F.lit("")).alias("classes"), names.alias("attributes")).agg(F.count(F.lit(1)).alias("n"))


def tag_counts(page_nodes: DataFrame, key: str, tags: tuple[str, ...]) -> DataFrame:
    """Numbers of some tags of each page: what makes a page dynamic."""
    return page_nodes.groupBy(key).agg(*(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in tags))


def structure_difference(shapes: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Shapes (see structure) of shapes' pages that the page of the same key in other lacks."""
    return shapes.join(other.select(key, "tag", "classes", "attributes"), [key, "tag", "classes", "attributes"], "left_anti")


def call_arguments(page_nodes: DataFrame, key: str, function: str, attributes: tuple[str, ...] = ("href", "onclick")) -> DataFrame:
    """key, node, argument of the first call of a script function in a node's attributes, as document links have it."""
    said = F.concat_ws(" ", *(F.col("attrs")[a] for a in attributes))
    argument = F.regexp_extract(said, function + r"\(\s*['\"]?([^'\"),\s]+)", 1)
    return page_nodes.select(key, "node", argument.alias("argument")).where("argument <> ''")


@lru_cache(maxsize=1 << 12)
def _signature(tag: str, classes: str, names: str, below: tuple[str, ...]) -> str:
    shape = [tag, classes.split(), names.split(" ") if names else [], [*below]]
    return hashlib.sha256(json.dumps(shape).encode()).hexdigest()


def _signed(key: str):
    """Signatures of nodes that come page by page, each from the last one up: what stands below a node is known when it is reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, below, sizes = None, {}, {}
        for batch in batches:
            out = []
            for at, node, parent, tag, given, names in zip(*(batch.column(c).to_pylist() for c in (key, "node", "parent", "tag", "given", "names")), strict=True):
                if at != page:
                    page, below, sizes = at, {}, {}
                classes = " ".join(sorted(given.split()))
                signature = _signature(tag, classes, names, tuple(reversed(below.pop(node, ()))))
                size = 1 + sizes.pop(node, 0)
                if parent >= 0:
                    below.setdefault(parent, []).append(signature)
                    sizes[parent] = sizes.get(parent, 0) + size
                out.append((classes, signature, size))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "node", "parent", "tag")), *made], names=[key, "node", "parent", "tag", "classes", "signature", "size"])

    return run


def subtrees(page_nodes: DataFrame, key: str) -> DataFrame:
    """key, node, parent, tag, classes, signature, size of each subtree of elements.

    Signatures are equal for equal trees of tag, classes (in any order) and names of attributes, children in order, and for
    no others.  Nodes stream page by page, so that a task holds what is open of one page.
    """
    kind = page_nodes.schema[key].dataType.simpleString()
    elements = page_nodes.where(F.col("tag") != TEXT).select(key, "node", "parent", "tag", F.coalesce(F.col("attrs")["class"], F.lit("")).alias("given"), F.array_join(F.array_sort(F.map_keys("attrs")), " ").alias("names"))
    ordered = spread(elements, key).sortWithinPartitions(key, F.desc("node"))
    return ordered.mapInArrow(_signed(key), f"`{key}` {kind}, node int, parent int, tag string, classes string, signature string, size int")


def subtree_differences(trees: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The smallest subtrees (see subtrees) that the page of the same key in other lacks: those all of whose children it has.

    Both sides are as large as the pages, however small the table that they come from looks to the planner: merged, never broadcast.
    """
    lacking = trees.join(other.select(key, "signature").distinct().hint("merge"), [key, "signature"], "left_anti")
    above = lacking.select(key, F.col("parent").alias("node")).distinct()
    return lacking.join(above.hint("merge"), [key, "node"], "left_anti")


def known_shapes(trees: DataFrame, other: DataFrame, key: str, roots: Column) -> DataFrame:
    """The roots among trees with known: whether any page of other has a subtree of that shape, so that whole entries are compared with those of a reference."""
    shapes = other.select("signature").distinct().withColumn("_known", F.lit(True))
    joined = trees.where(roots).join(shapes.hint("merge"), "signature", "left")
    return joined.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
