"""Bytes of a document's parts, and artifacts of deep runs."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from dossier.operators import responses
from dossier.sources import files, office

ROWS = "path string, content binary"


def sheets(n, size):
    """A workbook whose sheets are a few bytes packed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(office.built_xlsx({f"S{i}": [["x" * size]] for i in range(n)}))) as plain, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for name in plain.namelist():
            packed.writestr(name, plain.read(name))
    return out.getvalue()


def test_parts_have_one_budget(spark):
    """Many sheets, each small enough, are one failed row; so are those inside an archive, whose other members are read."""
    many, few = sheets(40, 20_000), sheets(2, 20_000)
    assert len(many) < 40_000
    limits = office.Limits(member_bytes=30_000, total_bytes=300_000)
    given = [("many.xlsx", many), ("few.xlsx", few), ("large.xlsx", sheets(1, 40_000)), ("a.zip", office.zipped({"1.xlsx": few, "2.xlsx": many, "3.docx": office.built_docx(["d"])}))]
    got = {(r.path, r.member_name): (r.status, r.error) for r in office.extracted(spark.createDataFrame(given, ROWS), limits=limits).collect()}
    assert got[("few.xlsx", "")] == ("success", None) == got[("a.zip", "1.xlsx")] == got[("a.zip", "3.docx")]
    assert got[("many.xlsx", "")] == ("failed", "LimitExceeded: 42 parts: too many bytes") == got[("a.zip", "2.xlsx")]
    assert got[("large.xlsx", "")][0] == "failed" and len(got) == 6


def test_documents_of_an_archive_share_it(spark):
    four = office.zipped({f"{i}.xlsx": sheets(2, 20_000) for i in range(4)})
    got = {r.member_name: r.status for r in office.extracted(spark.createDataFrame([("a.zip", four)], ROWS), limits=office.Limits(total_bytes=130_000)).collect()}
    assert sorted(got.values()) == ["failed", "success", "success", "success"]


def test_artifacts(spark, tmp_path):
    cases = spark.createDataFrame([("a", "ok", None), ("b", "stale_context", "changed"), ("c", "ok", None)], "case_id string, preparation string, detail string")
    contexts = spark.createDataFrame([("a", 3, 10, 2), ("b", 1, 1, 1)], "case_id string, document_coverage int, input_size_chars int, evidence_units int")
    answers = spark.createDataFrame([("a", "p", "raw", (5,), "r1", 1, None, None), ("b", "p", "raw", (5,), "r2", 1, None, None)], "case_id string, prediction string, raw_output string, usage struct<input_tokens: int>, response_id string, attempts int, error_kind string, error_message string")
    records = responses.deep_records(cases, contexts, answers, "case_id")
    assert {r.case_id: (r.status, r.input_size_chars, r.prediction, r.response_id, r.error) for r in records.collect()} == {
        "a": ("scored", 10, "p", "r1", None), "b": ("skipped", None, None, None, ("stale_context", "changed")), "c": ("error", None, None, None, ("unexpected_error", "no answer")),
    }
    files.write_artifact(responses.deep_artifacts(records, {"model": F.lit("m")}, F.col("usage.input_tokens") * 2), f"{tmp_path}/run")
    written = [json.loads(line) for p in tmp_path.glob("run/part-*") for line in p.read_text().splitlines()]
    assert {(w["model"], w["case"]["case_id"], w.get("cost")) for w in written} == {("m", "a", 10), ("m", "b", None), ("m", "c", None)}
