"""Parts of office files as rows, handed on many parts at a time."""

import io
import zipfile

import pyarrow as pa

from dossier.sources import office


def test_small_parts_are_handed_on_together(spark, monkeypatch):
    xml = [zipfile.ZipFile(io.BytesIO(office.built_docx([f"p{i}", "", "q"], [["a", str(i)]]))).read("word/document.xml") for i in range(50)] + [b"<damaged"]
    n = len(xml)
    given = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(n)]), pa.array([""] * n), pa.array(["word/document.xml"] * n), pa.array(xml, pa.binary())], names=["file", "member_name", "part", "xml"])
    whole = list(office._pieces(iter([given])))
    assert len(whole) == 1 and whole[0].num_rows == 50 * 5 + 1
    for name, most in (("BATCH_ROWS", 3), ("BATCH_TEXT", 4)):
        with monkeypatch.context() as m:
            m.setattr(office, name, most)
            parts = list(office._pieces(iter([given])))
        assert len(parts) > 50 and [r for b in parts for r in b.to_pylist()] == whole[0].to_pylist()
    assert not list(office._pieces(iter([])))


def test_rows_of_tables(spark):
    """Paragraphs of a cell and cells of a row in order; blank cells between others stay, blank rows don't, tables inside cells are rows too."""
    p = lambda t: f"<w:p><w:r><w:t> {t} </w:t></w:r></w:p>"
    cell = lambda *c: f"<w:tc>{''.join(c)}</w:tc>"
    row = lambda *c: f"<w:tr>{''.join(c)}</w:tr>"
    inner = f"<w:tbl>{row(cell(p('in')))}</w:tbl>"
    table = f"<w:tbl>{row(cell(p('a'), p(''), p('b')), cell(p('')), cell(p('c')))}{row(cell(p('')), cell())}{row()}{row(cell(p('x'), inner), cell())}</w:tbl>"
    doc = office.zipped({"word/document.xml": f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{p("one")}{table}{p("")}{p("two")}</w:body></w:document>'.encode()})
    found = office.extracted(spark.createDataFrame([("d.docx", doc), ("d.docx", doc), ("e.docx", doc)], "path string, content binary")).collect()
    assert sorted((r.path, r.status, r.paragraph_count, r.table_count) for r in found) == [("d.docx", "success", 3, 1), ("e.docx", "success", 3, 1)]
    assert {r.text for r in found} == {"one\na\nb\t\tc\nx\nin\t\nin\ntwo"}


def test_archives_are_zip_files():
    given = {"a.xml": b"x" * 50, "ü/ b.txt": b"", "z.zip": office.zipped({})}
    with zipfile.ZipFile(io.BytesIO(office.zipped(given))) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == given
