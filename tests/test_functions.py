"""Column expressions on single values."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates, money, rules, segments, text, urls
from dossier.operators import validators
from dossier.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("expression", "given", "expected"),
    [
        (text.collapsed, " a \t b\x1c ", "a b"),
        (text.stripped, "\t a b\n", "a b"),
        (text.unix_lines, "\r\na\rb\r\n", "a\nb"),
        (text.label, " Name  OF :: ", "name of"),
        (text.meaningful, " N/A ", None),
        (text.meaningful, "x  y", "x y"),
        (text.is_blank, "  \n", True),
        (text.is_blank, None, True),
        (text.is_blank, "a", False),
        (text.amount, "980 000", 980000),
        (text.amount, "1 234 567", 1234567),
        (text.amount, "980000", 980000),
        (text.amount, "98 00", None),
        (text.amount, "1.5", None),
        (text.amount, "99999999999999999999", None),
        (text.natural_number, "-3", None),
        (text.natural_number, "007", 7),
        (text.is_snake_case, "office_goods2", True),
        (text.is_snake_case, "Office", False),
        (text.is_snake_case, None, False),
        (text.html_escaped, "a<b>&", "a&lt;b&gt;&amp;"),
        (text.safe_file_name, r"..\dir/na:me?.docx", "na_me_.docx"),
        (text.safe_file_name, "CON.txt", "_CON.txt"),
        (text.safe_file_name, " . ", "document"),
        (text.safe_file_name, "x" * 200 + ".zip", "x" * 146 + ".zip"),
        (urls.host, "HTTPS://www.A.b:80/x", "a.b"),
        (urls.host, "not a url", None),
        (urls.base_name, "http://h/a/b%20c.DOCX?x=1#y", "b c.DOCX"),
        (urls.base_name, "http://h/%zz", "%zz"),
        (urls.is_readable, "http://h/f.XLSX?a.pdf", True),
        (urls.is_readable, "http://h/f.pdf", False),
        (urls.extension, ".profile", ""),
        (dates.normal_datetime, "1/9/2026 7:05", "2026-09-01 07:05:00"),
        (dates.normal_datetime, "2026-09-01", None),
        (dates.normal_datetime, "31/02/2026 10:00", None),
        (dates.deadline, "2026-10-01", datetime(2026, 10, 1, 19, 59, 59)),
        (dates.deadline, "2026-10-01 12:00", datetime(2026, 10, 1, 8)),
        (dates.deadline, "2026-10-01T12:00:00Z", datetime(2026, 10, 1, 12)),
        (dates.deadline, "2026-10-01T12:00:00+02:00", datetime(2026, 10, 1, 10)),
        (dates.deadline, "soon", None),
        (dates.first_datetime, "x 2026-09-25 18:59:34-y", "2026-09-25 18:59:34"),
        (dates.until_datetime, "от ДО 2026-10-02 11:10:00 час", "2026-10-02 11:10:00"),
        (dates.until_datetime, "Бессрочно", None),
    ],
)
def test_of_one_text(spark, expression, given, expected):
    assert one(spark, expression(F.lit(given).cast("string"))) == expected


def test_url_kinds(spark):
    kinds = [("a.example.org", "/detail/", "detail"), ("b.example.org", None, "list"), ("c.example.org", "^/files/", "direct_file")]
    for url, kind in (("https://www.a.example.org/detail/1.pdf", "detail"), ("http://b.example.org/x", "list"), ("http://x.org/a.PDF?q", "direct_file"), ("http://c.example.org/files/1", "direct_file"), ("http://c.example.org/x", "unknown"), (None, "unknown")):
        assert one(spark, urls.classified(F.lit(url).cast("string"), kinds)) == kind
    assert one(spark, urls.query_value(F.lit("http://h/?a=1&resourceId=x%20y&resourceId=2"), "resourceId")) == "x y"
    assert [one(spark, urls.page_url(F.lit("http://h/s/"), F.lit(n))) for n in (1, 3, 0)] == ["http://h/s/", "http://h/s/3", None]


def test_eligibility(spark):
    now = F.lit("2026-10-01 08:00:00").cast("timestamp")
    past, future = "2026-09-30 11:00:00", "2026-10-10 11:00:00"
    cases = [
        ((past, None), "expired"), (("2026-10-01 12:00:00", None), "expired"), (("2026-10-01 12:00:01", None), "eligible"), ((None, " "), "unknown"), ((past, "soon"), "unknown"),
        ((future, "soon"), "eligible"), ((past, future), "conflict"), ((future, past), "conflict"), ((future, "2026-10-10T07:00:00Z"), "eligible"), (("2026-10-01", None), "eligible"),
    ]
    for given, status in cases:
        assert one(spark, dates.eligibility([F.lit(x).cast("string") for x in given], now))["status"] == status, given


def test_money(spark):
    usage = lambda *n: [F.lit(x).cast("long") for x in n]
    assert one(spark, money.cost(F.lit("model_a"), *usage(4100, 0, 0, 300))) == Decimal("0.00118")
    assert one(spark, money.cost(F.lit("model_a"), *usage(75473, 0, 0, 4350))) == Decimal("0.0203146")
    assert one(spark, money.cost(F.lit("model_a"), *usage(272_000, 0, 0, 0))) == Decimal("0.0544")
    assert one(spark, money.cost(F.lit("model_a"), *usage(272_001, 0, 0, 0))) == Decimal("0.1088004")
    assert one(spark, money.cost(F.lit("model_a"), *usage(10, 8, 3, 0))) is None
    assert one(spark, money.cost(F.lit("other"), *usage(10, 0, 0, 0))) is None
    assert one(spark, money.conservative_cost(F.lit("model_b"), *usage(1000, 8000))) == Decimal("0.0985")
    assert [one(spark, money.request_tokens(F.lit(n))) for n in (0, 1, 24, 25, 305_901)] == [300, 301, 310, 311, 127_759]
    assert one(spark, money.ledger_count(F.lit(-1))) == 0 and one(spark, money.ledger_count(F.lit(None).cast("int"))) == 0
    assert one(spark, money.ceil_product(F.lit(900), F.expr("0.1BD"), F.expr("0.333BD"))) == 30


def test_rules(spark):
    guard = lambda spend, est, deep: tuple(one(spark, rules.budget_guard(*(F.lit(Decimal(str(x))) for x in (spend, est)), F.lit(deep), F.lit(15), F.lit(12), F.expr("0.75BD"))))
    assert guard(15, 0.1, False) == ("blocked_hard_limit", False)
    assert guard(1, 0.8, True) == ("blocked_single_call_limit", False)
    assert guard(14.9, 0.2, False) == ("insufficient_budget_remaining", False)
    assert guard(12, 0.2, True) == ("soft_limit_mode", False)
    assert guard(12, 0.2, False) == ("soft_limit_mode", True)
    assert guard(1, 0.8, False) == ("allowed", True)
    docs = F.expr("array(named_struct('document_id', 1L, 'filename', 'a.zip', 'language', 'RU'), named_struct('document_id', 2L, 'filename', 'b.DOCX', 'language', 'ru'), named_struct('document_id', 3L, 'filename', 'c.docx', 'language', 'HY'), named_struct('document_id', 4L, 'filename', 'd.pdf', 'language', 'RU'))")
    assert one(spark, rules.best_document(docs))["document_id"] == 2
    assert tuple(one(spark, rules.error_kind(F.lit(429), F.lit(False), F.lit(True)))) == ("rate_limit", False)
    assert tuple(one(spark, rules.error_kind(F.lit(503), F.lit(False), F.lit(False)))) == ("server", True)


def test_validators(spark):
    found = lambda *v: one(spark, validators.triage_errors(*(F.lit(x) for x in v)))
    assert found("relevant", "procurement", "office_goods", "high", "why", True) == []
    assert found("not_relevant", "procurement", "Bad", "sure", " ", True) == ["confidence", "reason", "category", "pair", "deep_flag"]
    assert found("maybe", "unclear", "goods", "low", "why", False) == ["category"]
    barrier = F.expr("array(named_struct('type', 'license', 'description', 'x', 'severity', 'huge', 'evidence', array('q')))")
    assert one(spark, validators.barrier_errors(barrier)) == ["bad_severity"]
    assert one(spark, validators.item_errors(F.expr("array(named_struct('item_name', 'x', 'evidence', cast(array() as array<string>)))"))) == ["no_evidence"]
    assert one(spark, validators.key_errors(F.lit('{"b":1,"c":2}'), ["a", "b"])) == ["extra:c", "missing:a"]
    items = F.expr("array(named_struct('source_type', 'document', 'text', ' '))")
    assert one(spark, validators.evidence_errors(items, ["document"])) == ["blank_text"]
    assert one(spark, validators.evidence_errors(F.lit(None).cast("array<struct<source_type:string,text:string>>"), ["document"])) == ["empty"]
    kind = lambda refusal, status, said: one(spark, validators.response_kind(F.lit(refusal).cast("string"), F.lit(status), F.lit(said).cast("string"), F.lit(True)))
    assert [kind("no", "ok", "{}"), kind(None, "incomplete", "{}"), kind(None, "ok", None), kind(None, "ok", "{x"), kind(None, "ok", "[1]"), kind(None, "ok", '{"a":1}')] == ["refusal", "incomplete", "empty", "invalid_structured_output", "invalid_structured_output", None]


def test_segments():
    for t in ("", "a", "ab\ncd\nef", "\n" * 7, "abcdefghij", "a b c d e f g"):
        for size in (1, 2, 3, 5, 100):
            spans = list(segments.chunk_spans(t, size))
            assert "".join(t[a:b] for a, b in spans) == t and all(b - a <= size for a, b in spans)
            units = list(segments.unit_spans(t, size))
            assert all(0 < b - a <= size and t[a:b].strip() and "\n" not in t[a:b] for a, b in units)
            assert "".join(t[a:b] for a, b in units).replace(" ", "") == t.replace("\n", "").replace(" ", "")
    assert list(segments.chunk_spans("ab\ncd", 4)) == [(0, 3), (3, 5)]
    assert segments.packed_pages(["aa", "bb", "c" * 7, "d e f"], 5) == ["aa\nbb", "ccccc", "cc", "d e f"]


def test_clipped(spark):
    clip = lambda t, n: one(spark, segments.clipped(F.lit(t), n))
    assert clip("short", 10) == "short"
    assert clip("One two. Three four five", 12) == "One two."
    assert clip("One two three, four five", 16) == "One two three…"
    assert clip("abcdefghijkl", 5) == "abcd…"


def test_landed_files(spark):
    assert [files.header_name(x) for x in (None, "inline", 'attachment; filename="a b.docx"', "attachment; filename*=UTF-8\'\'%D1%84.zip", 'attachment; filename="=?UTF-8?B?0YQ=?="', 'attachment; filename="\u00d1\u0084"')] == [None, None, "a b.docx", "ф.zip", "ф", "ф"]
    state = lambda *v: one(spark, files.response_state(*(F.lit(x) for x in v)))
    assert state(404, "attachment", "text/html", "", 9, 9) == "unknown"
    assert state(200, "", "application/zip", "", 0, 0) == "direct_file"
    assert state(200, "", "text/html; charset=utf-8", "", 4, 0) == "html_tender_page"
    assert state(200, "", "text/html", "", 0, 2) == "html_documents_page"
    given = spark.createDataFrame([("d", "a.zip", "11111111aa", 1), ("d", "a.zip", "22222222bb", 2), ("d", "a.zip", "22222222cc", 3), ("d", "a.zip", "11111111aa", 4)], "folder string, name string, sha string, k int")
    got = {r.k: (r.landed_name, r.is_copy) for r in files.landed_names(given, "folder", "name", "sha", "k").collect()}
    assert got == {1: ("a.zip", False), 2: ("a__22222222bb.zip", False), 3: ("a__22222222cc.zip", False), 4: ("a.zip", True)}


def test_complete_thought(spark):
    clip = lambda t, n: one(spark, segments.complete_thought(F.lit(t), n))
    assert clip("short, and", 10) == "short, and"
    assert clip("one two three, four; five six", 22) == "one two three, four."
    assert clip("one two three, four и; five six", 23) == "one two three."
    assert clip("one, two three four five", 20) is None
    assert clip("one two three four,five six", 22) is None


def test_codes_and_callbacks(spark):
    lines = F.array(*map(F.lit, (" 44131300 -  a  b ", "4413130-x", " ", "44131300-")))
    assert [tuple(x) for x in one(spark, text.cpv_codes(lines))] == [("44131300", "a b"), (None, "4413130-x"), ("44131300", None)]
    assert one(spark, text.cpv_codes(F.array(F.lit(" ")))) is None
    assert [one(spark, text.callback_id(F.lit(x))) for x in ("full:17", "full:", "full:1234567890123456789", "xfull:1", None)] == [17, None, None, None, None]


def test_last_functions(spark, tmp_path):
    from dossier.operators import grounding, responses
    from dossier.sources import html, office

    assert one(spark, grounding.document_unit_id(F.lit(7), F.lit("abcdef0123"), F.lit(12))) == "ev_doc_7_abcdef_0012"
    (tmp_path / "cases.json").write_text('[{"case_id": "a", "n": 1},\n {"case_id": "b", "n": null}]')
    schema = spark.createDataFrame([], "case_id string, n long").schema
    assert sorted(tuple(r) for r in files.json_cases(spark, str(tmp_path / "cases.json"), schema).collect()) == [("a", 1), ("b", None)]
    (tmp_path / "bad.json").write_text('[{"case_id": "a", "n": "x"}')
    with pytest.raises(Exception):
        files.json_cases(spark, str(tmp_path / "bad.json"), schema).collect()
    nodes = html.nodes(spark.createDataFrame([(1, "<div><p>a<b>x</b></p></div><p>c</p>")], "k int, html string"), "k")
    pairs = html.inside(nodes.where("tag = 'div'"), nodes, "k").collect()
    assert {(r.outer_node, r.tag, r.text) for r in pairs} == {(0, "p", "ax"), (0, "b", "x")}
    found = spark.createDataFrame([("success", "docx", "abc"), ("success", "docx", "d"), ("failed", "zip", None)], "status string, file_type string, text string")
    assert {tuple(r) for r in office.extraction_status(found).collect()} == {("success", "docx", 2, 4), ("failed", "zip", 1, 0)}
    leaves = one(spark, grounding.leaf_texts(F.lit('{"a":"x \\"y\\"","b":[1,-2.5,true,null,{"c":"z"}],"d":""}')))
    assert leaves == ['x "y"', "1", "-2.5", "z", ""]
    said = lambda text_, json, quote: one(spark, grounding.quoted_in(grounding.source_variants(F.lit(text_).cast("string"), F.lit(json).cast("string")), F.lit(quote)))
    assert said('a "b"', None, 'a \\"b') and said("a  b", None, "a b") and not said("ab", None, " ") and said(None, '{"k":["one","two"]}', '"k":["one') and said(None, '{"k":["o\\nne"]}', "o ne")
    read = lambda text_: tuple(one(spark, responses.token_count(F.lit(text_).cast("string"))))
    assert [read(x) for x in (None, "null", "12", "-1", "1.0", "true")] == [(0, False), (0, False), (12, False), (None, True), (None, True), (None, True)]


@pytest.mark.parametrize(("header", "expected"), [(None, None), ("inline", None), ('attachment; filename="a b.docx"', "a b.docx"), ("attachment; filename*=UTF-8''%D1%84.zip", "ф.zip"), ('attachment; filename="=?UTF-8?B?0YQ=?="', "ф"), ('attachment; filename="Ñ\u0084"', "ф"), ('attachment; filename="x.zip"; filename*=UTF-8\'\'%zz', "x.zip")])
def test_header_file_names(spark, header, expected):
    assert one(spark, files.header_file_name(F.lit(header).cast("string"))) == expected
