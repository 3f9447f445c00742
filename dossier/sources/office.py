"""Texts of DOCX, XLSX and ZIP files, a row for each member.

Files come as rows of bytes (spark.read.format("binaryFile")).  A small walker lists
the members of an archive and hands on the XML parts of its documents as rows, which
are dealt anew, so that no task has an archive to itself; small readers turn a part
into rows of paragraphs, cells, strings or sheets; and texts, counts and limits are
joins and aggregates over these.  A bad file, member or part is a failed row and never
ends the job.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.store import spread, stored

# The namespaces of office files.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TEXT, MARKS = f"{W}t", {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
MEMBER = "member_name string, file_type string, status string, text string, paragraph_count long, table_count long, sheet_count long, row_count long, cell_count long, error string"
COUNTS = ("paragraph_count", "table_count", "sheet_count", "row_count", "cell_count")
PART = "file string, path string, member_name string, file_type string, status string, error string, part string, xml binary"
#: Rows of a part: a..c say where the text belongs, kind what it is.
PIECE = "file string, member_name string, part string, kind string, a long, b long, c long, name string, said string"
BATCH_ROWS, BATCH_TEXT = 20_000, 4 << 20  #: rows, and characters or bytes, of a batch that a task hands on


@dataclass
class Limits:
    """Most members, bytes of one and of all, nesting, and what a workbook may hold."""

    members: int = 200
    member_bytes: int = 20 << 20
    total_bytes: int = 100 << 20
    depth: int = 2
    sheets: int = 100
    rows: int = 100_000
    cells: int = 1_000_000
    chars: int = 10_000_000


class LimitExceeded(ValueError):
    """The whole archive is given up."""


@dataclass
class _Spent:
    limits: Limits
    members: int = 0
    bytes: int = 0


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded numbers and texts: handing on a batch costs more than reading a small part."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_TEXT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _bounded(z: zipfile.ZipFile, name: str, limits: Limits) -> bytes:
    """A member's bytes, read no further than it may be large."""
    with z.open(name) as f:
        data = f.read(limits.member_bytes + 1)
    if len(data) > limits.member_bytes:
        raise LimitExceeded(f"{name}: too many bytes")
    return data


def _document(name: str, kind: str, data: bytes, spent: _Spent) -> Iterator[tuple]:
    """The parts of a DOCX or XLSX that hold what it says: rows of PART from member_name on.

    Parts count towards the bytes of the whole file.  Their sizes are known before they are read, and no more than these is
    read of them: a document beyond what is left is one failed row.
    """
    limits = spent.limits
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            wanted = ["word/document.xml"] if kind == "docx" else ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", *(n for n in names if n == "xl/sharedStrings.xml" or n.startswith("xl/worksheets/") and n.endswith(".xml"))]
            sizes = [z.getinfo(n).file_size for n in wanted]
            if max(sizes) > limits.member_bytes or spent.bytes + sum(sizes) > limits.total_bytes:
                raise LimitExceeded(f"{len(sizes)} parts: too many bytes")
            spent.bytes += sum(sizes)
            parts = [(n, _bounded(z, n, limits)) for n in wanted]
    except Exception as e:  # whatever a damaged file does is its own failure
        yield name, kind, "failed", _told(e), None, None
        return
    yield name, kind, "success", None, None, None
    for part, xml in parts:
        yield name, kind, "part", None, part, xml


def _walk(data: bytes, outer: str, depth: int, spent: _Spent) -> Iterator[tuple]:
    limits = spent.limits
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            spent.members += 1
            spent.bytes += info.file_size
            if spent.members > limits.members or info.file_size > limits.member_bytes or spent.bytes > limits.total_bytes:
                raise LimitExceeded(f"{info.filename}: too many members or bytes")
            name = f"{outer}!/{info.filename}" if outer else info.filename
            kind = info.filename.rsplit(".", 1)[-1].lower() if "." in info.filename.rsplit("/", 1)[-1] else ""
            if kind not in ("docx", "xlsx", "zip") or kind == "zip" and depth >= limits.depth:
                yield name, kind, "skipped", None, None, None
                continue
            try:
                inner = _bounded(z, info.filename, limits)
                yield from list(_walk(inner, name, depth + 1, spent)) if kind == "zip" else _document(name, kind, inner, spent)
            except LimitExceeded:
                raise
            except Exception as e:
                yield name, kind, "failed", _told(e), None, None


def _members(name: str, data: bytes, limits: Limits) -> list[tuple]:
    """Rows of PART from member_name on for a file by its extension; members of an archive as outer!/inner."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind in ("docx", "xlsx"):
        return list(_document("", kind, data, _Spent(limits)))
    try:
        if kind != "zip":
            raise ValueError("the type is not supported")
        return list(_walk(data, "", 1, _Spent(limits)))
    except Exception as e:
        return [("", kind, "failed", _told(e), None, None)]


def _paragraph(node) -> str:
    return "".join([(x.text or "") if x.tag == TEXT else MARKS.get(x.tag, "") for x in node.iter()]).strip()


def _docx_pieces(xml: bytes) -> Iterator[tuple]:
    """A paragraph of the body by its block; a table, and each of its rows with any text by block and row, cells parted by tabs."""
    body = ElementTree.fromstring(xml).find(f"{W}body")
    for a, block in enumerate(body if body is not None else ()):
        if block.tag == f"{W}p":
            yield "paragraph", a, 0, 0, None, _paragraph(block)
        elif block.tag == f"{W}tbl":
            yield "table", a, 0, 0, None, None
            for b, row in enumerate(block.iter(f"{W}tr")):
                cells = ["\n".join(filter(None, map(_paragraph, cell.iter(f"{W}p")))) for cell in row.findall(f"{W}tc")]
                if any(cells):
                    yield "row", a, b, 0, None, "\t".join(cells)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_pieces(part: str, xml: bytes) -> Iterator[tuple]:
    """Shared strings by number, sheets with their order and link, links with their parts, cells by row and column."""
    root = ElementTree.fromstring(xml)
    texts = lambda x: "".join(t.text or "" for t in x.iter(f"{S}t"))
    if part == "xl/sharedStrings.xml":
        for a, string in enumerate(root.findall(f"{S}si")):
            yield "string", a, 0, 0, None, texts(string)
    elif part == "xl/workbook.xml":
        for a, sheet in enumerate(root.iter(f"{S}sheet")):
            yield "sheet", a, 0, 0, sheet.get("name"), sheet.get(f"{R}id")
    elif part.endswith(".rels"):
        for a, link in enumerate(root):
            target = (link.get("Target") or "").lstrip("/")
            yield "link", a, 0, 0, link.get("Id"), target if target.startswith("xl/") else f"xl/{target}"
    else:
        for a, row in enumerate(root.iter(f"{S}row")):
            for k, cell in enumerate(row.findall(f"{S}c")):
                value, kind = cell.find(f"{S}v"), cell.get("t")
                text = texts(cell) if kind == "inlineStr" else (value.text or "" if value is not None else "")
                if text:
                    b = _column(cell.get("r")) if cell.get("r") else k
                    if kind == "s":
                        yield "shared", a, b, int(text), None, None
                    else:
                        yield "value", a, b, 0, None, {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [c.split() for c in PIECE.split(", ")]
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in fields])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for *own, xml in zip(*(batch.column(c) for c in ("file", "member_name", "part", "xml")), strict=True):
                file, member, part = (x.as_py() for x in own)
                try:
                    found = list(_docx_pieces(xml.as_py()) if part.startswith("word/") else _xlsx_pieces(part, xml.as_py()))
                except Exception as e:
                    found = [("error", 0, 0, 0, None, _told(e))]
                yield from ((file, member, part, *x) for x in found)

    return _batched(rows(), schema)


def _joined(order: Sequence[str], text: str, between: str) -> Column:
    """A group's texts in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), between)


def _docx_texts(pieces: DataFrame) -> DataFrame:
    """Paragraphs and table rows in the order of the body; blank ones are left out."""
    kind = F.col("kind")
    line = F.when(kind.isin("paragraph", "row") & (F.col("said") != ""), F.struct("a", "b", "said"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["said"]), "\n")
    return pieces.groupBy("file", "member_name").agg(F.count_if(kind == "paragraph").alias("paragraph_count"), F.count_if(kind == "table").alias("table_count"), text.alias("_docx"))


def _xlsx_texts(pieces: DataFrame, limits: Limits) -> DataFrame:
    """Stored values of each sheet with any, under its name; cells are parted by tabs, empty ones at the end left out."""
    document = ["file", "member_name"]
    of = lambda kind: pieces.where(F.col("kind") == kind)
    links = of("link").select(*document, F.col("name").alias("link"), F.col("said").alias("part"))
    sheets = of("sheet").select(*document, F.col("a").alias("place"), "name", F.col("said").alias("link")).join(links, [*document, "link"]).drop("link")
    strings = of("string").select(*document, F.col("a").alias("c"), F.col("said").alias("string"))
    shared = of("shared").join(strings, [*document, "c"], "left").select(*document, "part", "a", "b", F.col("string").alias("value"))
    cells = of("value").select(*document, "part", "a", "b", F.col("said").alias("value")).unionByName(shared).where("value <> ''")
    row = cells.groupBy(*document, "part", "a").agg(F.map_from_entries(F.collect_list(F.struct("b", "value"))).alias("m"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.least("last", F.lit(limits.cells))), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), "\t")
    by_sheet = row.withColumn("line", line).groupBy(*document, "part").agg(_joined(["a"], "line", "\n").alias("lines"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("cells"))
    said = by_sheet.join(sheets, [*document, "part"]).withColumn("block", F.concat(F.lit("[Sheet: "), "name", F.lit("]\n"), "lines"))
    out = said.groupBy(*document).agg(_joined(["place"], "block", "\n").alias("text"), F.count(F.lit(1)).alias("sheet_count"), F.sum("rows").alias("row_count"), F.sum("cells").alias("cell_count"))
    every = sheets.groupBy(*document).agg(F.count(F.lit(1)).alias("sheets")).join(out, document, "left").fillna(0, ["sheet_count", "row_count", "cell_count"])
    limit = F.when(F.col("sheets") > limits.sheets, "too many sheets").when((F.col("row_count") > limits.rows) | (F.col("cell_count") > limits.cells), "too many rows or cells").when(F.length("text") > limits.chars, "too much text")
    return every.withColumn("error", F.concat(F.lit("LimitExceeded: "), limit)).drop("sheets")


def extracted(files: DataFrame, *, path: str = "path", content: str = "content", keys: Sequence[str] = (), limits: Limits | None = None) -> DataFrame:
    """(path, content) -> keys, path and the columns of MEMBER, a row a document; null content is a failed row.

    Rows that are alike in keys, path and content give their members once each.
    """
    limits = limits or Limits()
    names = [c.split()[0] for c in PART.split(", ")]
    own = files.select(*keys, F.col(path).alias("path"), F.col(content).alias("content"))
    own = own.withColumn("file", F.sha2(F.concat_ws("\x01", F.to_json(F.struct(*keys, "path")), F.sha2("content", 256)), 256))
    own = spread(own, "file").dropDuplicates(["file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "xml" else pa.string()) for n in names])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, name, data in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    yield from ((file, name, *r) for r in _members(name or "", data.as_py() or b"", limits))

        return _batched(rows(), schema)

    parts = stored(own.select("file", "path", "content").mapInArrow(run, PART), "parts")
    open_ = spread(parts.where("status = 'part'").select("file", "member_name", "part", "xml"), "file", "member_name", "part")
    pieces = stored(open_.mapInArrow(_pieces, PIECE), "pieces")
    document = ["file", "member_name"]
    bad = pieces.where("kind = 'error'").groupBy(*document).agg(F.min("said").alias("_bad"))
    docx, xlsx = _docx_texts(pieces.where(F.col("part").startswith("word/"))), _xlsx_texts(pieces.where(F.col("part").startswith("xl/")), limits)
    read = parts.where("status <> 'part'").drop("part", "xml").withColumnRenamed("error", "_given")
    for found in (bad, docx, xlsx):
        read = read.join(found, document, "left")
    error = F.coalesce("_given", "_bad", "error")
    good = (F.col("status") == "success") & error.isNull()
    done = read.select(
        "file", "path", "member_name", "file_type", F.when(error.isNull(), F.col("status")).otherwise("failed").alias("status"), F.when(good, F.coalesce("_docx", "text", F.lit(""))).alias("text"),
        *(F.when(good, F.col(c)).alias(c) for c in COUNTS), error.alias("error"),
    )
    if keys:
        done = done.join(own.select("file", *keys), "file")
    return done.select(*keys, "path", *(c.split()[0] for c in MEMBER.split(", ")))


def extraction_status(rows: DataFrame) -> DataFrame:
    """Documents by status and type: status, file_type, n, chars."""
    return rows.groupBy("status", "file_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def _xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def built_docx(paragraphs: list[str], table: list[list[str]] | None = None) -> bytes:
    """A minimal DOCX of paragraphs and a table."""
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>'
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table or [])
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'.encode()})


def built_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """A minimal XLSX with inline strings."""
    files, names, links = {}, [], []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{_xml(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
        files[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{S[1:-1]}"><sheetData>{cells}</sheetData></worksheet>'.encode()
        names.append(f'<sheet name="{_xml(name)}" sheetId="{k}" r:id="r{k}"/>')
        links.append(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>')
    files["xl/workbook.xml"] = f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets>{"".join(names)}</sheets></workbook>'.encode()
    files["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>'.encode()
    return zipped(files)


def zipped(files: dict[str, bytes]) -> bytes:
    """An archive of stored members, written as a whole: zipfile takes several times as long for members of a few bytes."""
    out, directory, at = [], [], 0
    for name, data in files.items():
        said = name.encode()
        head = struct.pack("<5H3I2H", 20, 0x800, zipfile.ZIP_STORED, 0, 33, zlib.crc32(data), len(data), len(data), len(said), 0)
        out += [b"PK\3\4", head, said, data]
        directory += [b"PK\1\2\x14\0", head, struct.pack("<3H2I", 0, 0, 0, 0, at), said]
        at += 30 + len(said) + len(data)
    listed = b"".join(directory)
    return b"".join((*out, listed, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(files), len(files), len(listed), at, 0)))
