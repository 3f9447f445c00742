"""Writes, runs and formats on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import candidates, facts, grounding, ledger, upsert
from dossier.plans import analysis, delivery, monitor
from dossier.sources import html, office
from dossier.store import fresh_path, table_or_empty
from dossier.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_change_detection(spark):
    old = spark.createDataFrame([(1, "a", None, 10, 10), (2, "b", "x", 10, 10), (3, "c", "y", 10, 10)], "k int, v string, w string, first_seen_at int, last_seen_at int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "z")], "k int, v string, w string")
    assert rows(upsert.upsert_status(old, new, ["k"], ["v", "w"], replace=True), "k", "status", "changed") == [(1, "existing", []), (2, "updated", ["w"]), (3, "deleted", []), (4, "new", [])]
    assert rows(upsert.upserted(old, new, ["k"], ["v", "w"], F.lit(20)), "k", "w", "first_seen_at", "last_seen_at") == [(1, None, 10, 10), (2, None, 10, 20), (3, "y", 10, 10), (4, "z", 20, 20)]
    assert rows(upsert.upserted(old, new, ["k"], ["v", "w"], F.lit(20), touch_existing=True).where("k = 1"), "last_seen_at") == [(20,)]


def test_batch_order(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    batch = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("a", "2", 2), ("b", "1", 3), ("b", "2", 4), ("c", " ", 5)], "k string, v string, position int")
    got = {r.position: r.status for r in upsert.batch_status(old, batch, ["k"], ["v"], "position", ["v"]).collect()}
    assert got == {0: "existing", 1: "updated", 2: "existing", 3: "new", 4: "updated", 5: "failed"}


def test_children(spark):
    kind = "array<struct<code:string,name:string>>"
    given = spark.createDataFrame([(1, [("a", "x"), (" ", "y"), ("a", "x"), ("a", None), ("a", None)]), (2, None), (3, [])], f"k int, c {kind}")
    clean = given.select("k", upsert.cleaned_children(F.col("c"), "code", "name").alias("c"))
    assert {r.k: r.c and [tuple(x) for x in r.c] for r in clean.collect()} == {1: [("a", "x"), ("a", None)], 2: None, 3: []}
    stored = F.array(F.struct(F.lit("a").alias("code"), F.lit("x").alias("name")))
    got = {r.k: r.r.changed for r in clean.select("k", upsert.replaced_children(stored, F.col("c")).alias("r")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_deliveries(spark):
    stored = spark.createDataFrame([("a", "1", "sent", 1), ("b", "1", "failed", 2)], "u string, h string, status string, attempt_count int")
    wanted = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "u string, h string")
    assert rows(upsert.begun_attempts(stored, wanted, ["u", "h"]), "u", "h", "attempt_count") == [("a", "2", 1), ("b", "1", 3)]
    results = spark.createDataFrame([("a", "1", False), ("b", "1", True)], "u string, h string, ok boolean")
    assert rows(upsert.settled_deliveries(stored, results, ["u", "h"]), "u", "status") == [("a", "sent"), ("b", "sent")]


def test_ledger(spark):
    have = spark.createDataFrame([("r1", 1.0)], "response_id string, cost double")
    new = spark.createDataFrame([("r1", 1.0), ("r2", 2.0), ("r2", 2.0), (None, 3.0), (None, 3.0)], "response_id string, cost double")
    assert rows(ledger.appended(have, new), "response_id", "cost") == [("r2", 2.0), (None, 3.0), (None, 3.0)]
    blocks = spark.createDataFrame([("r1", None), ("r2", None), ("r3", "x")], "response_id string, resolved_at string")
    assert rows(ledger.replayed_blocks(blocks, have), "response_id") == [("r2",)]


def test_unions(spark):
    a = spark.createDataFrame([("x", 1), (" ", 2), (None, 3)], "k string, p int")
    b = spark.createDataFrame([("x", 4), ("y", 5), ("y", 6), (" ", 7)], "k string, p int")
    assert rows(candidates.first_wins([a, b], "k", ["p"]), "p") == [(1,), (2,), (3,), (5,), (7,)]
    assert rows(candidates.union_minus([a, b], spark.createDataFrame([("y",)], "k string"), "k"), "k") == [("x",)]


def test_lot_tables(spark):
    head = "Terms\nLots\tName\nNumber\tPrice\n"
    texts = {
        "good": head + "1\t980 000\ta\n2\t5\tb\nend\n3\tx\ty", "two": head + "1\t5\ta\n" + head + "1\t5\ta", "none": head + "x", "twice": head + "1\t5\ta\n1\t5\ta", "gap": head + "1\t5\ta\n3\t5\ta", "empty": head + "1\t\ta", "no": "text",
    }
    docs = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r.k: (r.lots, r.lot_sum, r.reason) for r in facts.lot_tables(docs, "k", r"^Lots\tName\s*\nNumber\tPrice\s*$").collect()}
    assert got == {"good": (2, 980005, None), "two": (2, None, "several_tables"), "none": (0, None, "no_rows"), "twice": (2, None, "repeated_number"), "gap": (2, None, "not_contiguous"), "empty": (1, None, "bad_price")}


def test_grounding(spark):
    sources = spark.createDataFrame([(1, "A  b c"), (2, None)], "k int, text string")
    quotes = spark.createDataFrame([(1, "b c"), (1, "B c"), (1, " "), (2, "x"), (3, "x")], "k int, quote string")
    assert rows(grounding.grounded(quotes, sources, "k"), "k", "quote", "grounded") == sorted([(1, "b c", True), (1, "B c", False), (1, " ", False), (2, "x", False), (3, "x", False)], key=str)
    assert spark.range(1).select(grounding.quote_variants(F.lit('a"b')).alias("v")).first().v == ['a"b', 'a\\"b']


def test_office(spark):
    book = office.built_xlsx({"Lot": [["Item", "Qty"], ["Bolt", "10"]], "Empty": []})
    doc = office.built_docx(["Hello & <you>", "", "x"], [["a", "b"], ["", ""]])
    deep = office.zipped({"in.zip": office.zipped({"third.zip": b"", "y.docx": doc}), "bad.xlsx": b"no", "n.txt": b"n"})
    files = spark.createDataFrame([("b.xlsx", book), ("d.DOCX", doc), ("z.zip", deep), ("q.pdf", b"%"), ("broken.zip", b"PK"), ("null.docx", None)], "path string, content binary")
    got = {(r.path, r.member_name): (r.status, r.text) for r in office.extracted(files).collect()}
    assert got == {
        ("b.xlsx", ""): ("success", "[Sheet: Lot]\nItem\tQty\nBolt\t10"), ("d.DOCX", ""): ("success", "Hello & <you>\nx\na\tb"), ("z.zip", "in.zip!/third.zip"): ("skipped", None),
        ("z.zip", "in.zip!/y.docx"): ("success", "Hello & <you>\nx\na\tb"), ("z.zip", "bad.xlsx"): ("failed", None), ("z.zip", "n.txt"): ("skipped", None), ("q.pdf", ""): ("failed", None),
        ("broken.zip", ""): ("failed", None), ("null.docx", ""): ("failed", None),
    }
    limited = office.extracted(files.where("path = 'z.zip'"), limits=office.Limits(members=2)).collect()
    assert [(r.status, r.member_name) for r in limited] == [("failed", "")]


PAGE = """<html><script>var x = "<a href='no'>"</script><div class="tender x"><div class="tender_title"><a href="http://h/d/1">T &amp; 1</a></div>
<p class="tender_time">(2026-09-25 18:59:34-от До 2026-10-02 11:10:00 час)</p></div><div class="tender"><p>no link</p></div></html>"""
DETAIL = "<dl><dt>Code:</dt><dd> C-1 </dd><dt>Published</dt><dd>25/9/2026 18:59:34</dd><dt>Code</dt><dd>other</dd><dt>Nothing</dt></dl>"


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>a<br>b</p></i><img src=x")], "k int, html string")
    nodes = html.nodes(pages, "k")
    assert rows(html.links(nodes, "k"), "k", "href", "text") == [(1, "http://h/d/1", "T & 1")]
    assert rows(nodes.where("k = 3"), "tag", "text", "parent") == [("br", "", 0), ("p", "ab", -1)]


def test_long_texts_stay_whole(spark):
    long = "word " * 1000
    detail = lambda end: f"<dl><dt>Code</dt><dd>{long}{end}</dd></dl>"
    pages = spark.createDataFrame([(1, detail("a")), (2, detail("b")), (3, f"<table><tr><th>H</th></tr><tr><td>{long}c</td></tr></table><div><a href='x'>{long}d</a></div>")], "k int, html string")
    nodes = html.nodes(pages, "k")
    values = html.labelled_values(nodes, "k", F.col("tag") == "dt", F.col("tag") == "dd", {"code": "code"})
    assert rows(values, "k", "value") == [(1, f"{long}a"), (2, f"{long}b")]
    assert rows(html.table_cells(nodes, "k"), "value") == [(f"{long}c",)]
    some = html.nodes(pages, "k", tags=("div", "a"), said=("a",))
    assert rows(some, "tag", "text") == [("a", f"{long}d"), ("div", "")]


def test_batches_of_nodes(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"<p>{k}<b>{'x' * 50}</b></p>") for k in range(30)], "k int, html string")
    whole = rows(html.nodes(pages, "k"), "k", "node", "text")
    monkeypatch.setattr(html, "BATCH_TEXT", 20)
    assert len(whole) == 60 and rows(html.nodes(pages, "k"), "k", "node", "text") == whole


SITE = monitor.Site([("h", "/d/", "eauction_tender_page")], {"code": "procedure_code", "published": "published_at_detail"}, ("procedure_code", "published_at_detail"))


def test_monitor_run(spark):
    lists = spark.createDataFrame([("http://h/list", "open", "Open", PAGE)], "url string, section string, section_name string, html string")
    given = monitor.announcements(lists, SITE)
    now = F.lit("2026-10-01 00:00:00").cast("timestamp")
    snapshot, statuses = monitor.ingest(table_or_empty(spark, fresh_path(spark, "none"), schemas.ANNOUNCEMENTS), given, now)
    assert rows(statuses, "resource_url", "status") == [("http://h/d/1", "new")]
    again, statuses = monitor.ingest(snapshot, given, F.lit("2026-10-02 00:00:00").cast("timestamp"))
    assert rows(statuses, "status") == [("existing",)]
    assert [(r.first_seen_at.day, r.last_seen_at.day, r.deadline_at) for r in again.collect()] == [(1, 2, "2026-10-02 11:10:00")]
    details = spark.createDataFrame([("http://h/d/1", DETAIL)], "url string, html string")
    (e,) = monitor.enrichments(snapshot, details, SITE).collect()
    assert (e.procedure_code, e.published_at_detail, e.published_at_match, e.enrichment_status) == ("C-1", "2026-09-25 18:59:34", True, "success")
    assert monitor.enrichments(snapshot, details.limit(0), SITE).first().enrichment_status == "partial"


def test_file_extraction_run(spark):
    planned = spark.createDataFrame([("u1", "f1", "A.docx"), ("u2", "f2", "b.docx"), ("u3", "f3", "c.zip"), ("u4", "f4", "d.docx")], "resource_url string, source_url string, expected_filename string")
    files = spark.createDataFrame([("f1", office.built_docx(["x|y"])), ("f2", b"<!DOCTYPE html><p>"), ("f3", b"1" * 999)], "url string, content binary")
    got = {r.resource_url: (r.status, r.text, r.error and r.error[:10]) for r in monitor.extractions(planned, files, most_bytes=900).collect()}
    assert got == {"u1": ("success", "x|y", None), "u2": ("failed", None, "a page ins"), "u3": ("failed", None, "too many b")}


def _waiting(spark, n):
    return spark.createDataFrame([(f"u{i}", "h", "retry_triage" if i == 0 else "skip_expired" if i == 1 else "needs_triage", i) for i in range(n)], "resource_url string, input_hash string, reason string, first_seen_at int")


def test_analysis_batch(spark):
    seen = []

    def analyzer(row):
        seen.append(row["resource_url"])
        if row["resource_url"] == "u3":
            raise analysis.AnalyzerError("rate_limit")
        return {"result": {"relevance_status": "relevant"}, "usage": {"input_tokens": 5}, "response_id": row["resource_url"]}

    price = lambda usage: Decimal(usage["input_tokens"])
    run = lambda n, limit, a=analyzer, **k: analysis.run_batch(_waiting(spark, n), a, price, limit=limit, budget=Decimal(100), spent=Decimal(0), estimate=lambda r: Decimal(1), **k)
    batch = run(6, 4)
    assert seen == ["u2", "u3", "u4", "u5"]
    assert [o["reason_code"] for o in batch.outcomes] == ["relevant", "rate_limit", "relevant", "relevant"]
    assert [r["status"] for r in batch.reservations] == ["settled", "released", "settled", "settled"] and len(batch.ledger) == 3
    assert analysis.selected(_waiting(spark, 6), 2).count() == 3

    def broken(row):
        raise RuntimeError

    batch = run(6, 3, broken)
    assert [o["reason_code"] for o in batch.outcomes] == ["unexpected_error: RuntimeError", "accounting_blocked", "accounting_blocked"]
    assert batch.reservations[0]["status"] == "unresolved" and len(batch.reservations) == 1
    assert {o["reason_code"] for o in run(4, 3, open_reservations=1).outcomes} == {"accounting_blocked"}
    for bad in (0, True, None):
        with pytest.raises(ValueError):
            analysis.selected(_waiting(spark, 1), bad)
    said = spark.createDataFrame([{"state": "triage_error", "reason_code": "x"}, {"state": "triage_completed", "reason_code": "y"}])
    assert rows(analysis.summary(said), "state", "n", "failed") == [("triage_completed", 1, 0), ("triage_error", 1, 1)]


def test_delivery_run(spark):
    ready = spark.createDataFrame([("a", "1", "eligible", "T", ["x"] * 7), ("b", "1", "stale", "T", ["x"]), ("c", "1", "eligible", "T", ["y" * 5000])], "resource_url string, input_hash string, delivery string, title string, items array<string>")
    out = delivery.outbox(ready, spark.createDataFrame([("c", "1", "failed", 1)], "resource_url string, input_hash string, status string, attempt_count int"))
    got = {r.resource_url: (r.attempt_count, r.card) for r in out.collect()}
    assert got["a"] == (1, "T\n" + "• x\n" * 5 + "… 5 / 7") and got["c"][0] == 2 and len(got["c"][1]) <= 4096

    def sender(card):
        if "y" in card:
            raise OSError
        return True

    assert [(s["resource_url"], s["ok"]) for s in delivery.send(out, sender, 5)] == [("a", True), ("c", False)]


def test_incremental(spark, tmp_path):
    kind = "user_id string, event_id long, event_type string"
    for i, batch in enumerate([[("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x")], [("a", 4, "z"), ("b", 5, "y"), (None, 6, None)]]):
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.createDataFrame([], kind).schema
    stream = incremental.file_stream(spark, f"{tmp_path}/in/*", schema, files_a_batch=1)
    snapshot, statuses = incremental.upsert_stream(stream, ["user_id"], ["event_type"], "event_id", ["event_type"])
    assert {r.user_id: r.event_type for r in snapshot.collect()} == {"a": "z", "b": "y"}
    counts = {r.status: r["count"] for r in statuses.groupBy("status").count().collect()}
    assert counts["failed"] == 1 and counts["new"] == 2 and sum(counts.values()) == 6
    once = incremental.once_only(incremental.file_stream(spark, f"{tmp_path}/in/*", schema, files_a_batch=1), ["user_id", "event_type"])
    assert rows(once, "user_id", "event_type") == sorted([("a", "x"), ("b", "y"), ("a", "z"), (None, None)], key=str)


def test_incremental_by_position(spark, tmp_path):
    """40 files whose ids interleave and come from the last to the first give what one batch gives."""
    kind = "user_id long, event_id long, event_type string"
    events = [(i % 7, i, "xyz"[i * i % 11 % 3]) for i in range(400)]
    for k in range(40):
        spark.createDataFrame([e for e in events if (e[1] + 13) % 40 == 39 - k], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    stream = incremental.file_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], kind).schema)
    snapshot, statuses = incremental.upsert_stream(stream, ["user_id"], ["event_type"], "event_id")
    last, expected = {}, []
    for user, i, said in events:
        expected.append((i, "new" if user not in last else "existing" if last[user] == said else "updated"))
        last[user] = said
    assert {r.user_id: (r.event_type, r.first_seen_at, r.last_seen_at) for r in snapshot.collect()} == {u: (t, u, 399) for u, t in last.items()}
    assert sorted((r.event_id, r.status) for r in statuses.collect()) == expected


def test_both_legs_of_a_batch(spark, tmp_path):
    from decimal import Decimal

    from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

    from dossier.plans import analysis

    rows = spark.createDataFrame([(f"u{i}", "h", i) for i in range(7)], "resource_url string, input_hash string, first_seen_at long")
    triage = spark.createDataFrame([("u1", "h", "relevant"), ("u2", "h", "not_relevant"), ("u3", "old", "relevant"), ("u4", "h", "relevant"), ("u6", "h", "relevant")], "resource_url string, input_hash string, relevance_status string")
    deep = spark.createDataFrame([("u4", "h")], "resource_url string, input_hash string")
    url = F.col("resource_url")
    facts = {"eligibility": F.when(url == "u5", "expired").otherwise("eligible"), "gate": F.when(url == "u6", "skip_low_value").otherwise("deep_candidate"), "admission": F.lit("admitted")}
    steps = analysis.next_steps(rows, triage, deep, "resource_url", facts)
    assert {r.resource_url: r.step for r in steps.collect()} == {"u0": "call_triage", "u1": "call_deep", "u2": "stop_not_relevant", "u3": "call_triage", "u4": "reuse_deep", "u5": "skip_expired", "u6": "gate:skip_low_value"}
    assert {r.resource_url: (r.state, r.reason_code) for r in analysis.quiet_states(steps).collect()} == {"u2": ("stopped_not_relevant", None), "u4": ("deep_completed", None), "u5": ("skipped_expired", None), "u6": ("commercial_gate_skip", "skip_low_value")}

    calls = []

    def analyzer(leg):
        def call(row):
            calls.append((leg, row["resource_url"]))
            if row["resource_url"] == "u3":
                raise analysis.AnalyzerError("timeout")
            return {"result": {"relevance_status": "relevant"}, "usage": {"input_tokens": 10}, "response_id": "r1"}

        return call

    run = lambda **more: analysis.process(steps, {"triage": analyzer("triage"), "deep": analyzer("deep")}, lambda u: Decimal("0.5"), limit=5, budget=Decimal(9), spent=Decimal(0), estimate=lambda row: Decimal(1), **more)
    batch = run()
    # the unknown outcome of u3 blocks the deep call after it
    assert calls == [("triage", "u0"), ("triage", "u3")] and batch.blocked
    assert [(o["resource_url"], o["state"], o["reason_code"]) for o in batch.outcomes] == [("u0", "triage_completed", "relevant"), ("u3", "triage_error", "timeout"), ("u1", None, "accounting_blocked")]
    text = lambda *names: [StructField(n, StringType()) for n in names]
    schemas = {
        "ledger": StructType([*text("resource_url", "input_hash", "response_id"), StructField("cost", DecimalType(38, 12)), StructField("input_tokens", LongType())]),
        "reservations": StructType([*text("resource_url", "input_hash", "status"), StructField("cost", DecimalType(38, 12))]),
    }
    assert analysis.outstanding(spark, str(tmp_path), schemas["reservations"]) == 0
    analysis.record(spark, batch, str(tmp_path), schemas)
    analysis.record(spark, batch, str(tmp_path), schemas)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 1  # the same response from two batches
    assert analysis.outstanding(spark, str(tmp_path), schemas["reservations"]) == 1
    assert all(o["reason_code"] == "accounting_blocked" for o in run(open_reservations=1).outcomes)


def test_runs_go_on_where_they_ended(spark, tmp_path):
    from dossier.streaming import incremental

    schema = "key string, value string, position long"
    given = f"{tmp_path}/given"
    kinds = spark.createDataFrame([], schema).schema
    seen = []
    for n, rows in enumerate(([("a", "1", 1), ("b", "2", 2)], [("a", "1", 3), ("b", " ", 4), ("c", "5", 5)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(given)
        snapshot, statuses = incremental.upsert_stream(incremental.file_stream(spark, given, kinds), ["key"], ["value"], "position", ["value"], base=f"{tmp_path}/run")
        seen.append(({(r.key, r.value) for r in snapshot.collect()}, {(r.position, r.status) for r in statuses.collect()}))
        once = incremental.once_only(incremental.file_stream(spark, given, kinds), ["key"], base=f"{tmp_path}/once")
        assert once.count() == 2 + n
    assert seen[0] == ({("a", "1"), ("b", "2")}, {(1, "new"), (2, "new")})
    assert seen[1] == ({("a", "1"), ("b", "2"), ("c", "5")}, {(1, "new"), (2, "new"), (3, "existing"), (4, "failed"), (5, "new")})
    numbers = sorted(int(p.name) for p in (tmp_path / "run" / "snapshot").iterdir() if p.name.isdigit())
    assert numbers == [1, 2]
