"""What people are shown, deliveries, landed files and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import dates, money, text
from dossier.operators import candidates, cards, ledger, upsert, validators
from dossier.plans import analysis, delivery, monitor
from dossier.queries.base import Registry, table
from dossier.sources import files
from dossier.store import fresh_path, spread, table_or_empty
from dossier.streaming import incremental

registry = Registry()


@registry.add("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(ts + INTERVAL 4 HOUR, '%d.%m.%Y %H:%M') AS shown FROM events
""")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as UTC text and as people in the local zone see them."""
    return table(spark, sf_dir, "events").select("event_id", dates.utc_text(F.col("ts")).alias("utc"), dates.local_display(F.col("ts")).alias("shown"))


@registry.add("""
SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d ') || CASE o_custkey % 4 WHEN 1 THEN '09:05:00' ELSE '09:05:07' END END AS normal,
  CASE WHEN o_custkey % 4 = 0 THEN FALSE WHEN o_custkey % 4 = 1 THEN o_custkey % 8 <> 5 END AS same FROM orders
""")
def detail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of detail pages in their forms, and whether they match those of the list."""
    c, day = F.col("o_custkey") % 4, F.col("o_orderdate")
    given = F.when(c == 0, F.date_format(day, "yyyy.MM.dd 9:05")).when(c == 1, F.date_format(day, "d/M/yyyy 9:5")).when(c == 2, F.date_format(day, " d/M/yyyy  9:05:07")).otherwise(F.date_format(day, "yyyy-M-d 9:5:7"))
    other = F.when(c > 1, F.lit(" ")).when(F.col("o_custkey") % 8 == 5, F.lit("x")).when(c == 0, F.lit("y")).otherwise(given)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.normal_datetime(given).alias("normal"), dates.dates_match(given, other).alias("same"))


@registry.add("""
SELECT c_custkey, CASE WHEN length(c_mktsegment) > 8 THEN c_mktsegment[1:7] || '…' ELSE rpad(c_mktsegment, 8, ' ') END AS padded, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS said,
  CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN NULL WHEN 2 THEN c_custkey * 1000 END AS amount, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS number, c_custkey % 3 = 1 AS local_currency,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS counted, upper(c_mktsegment[1:1]) || replace(c_mktsegment[2:], '_', ' ') AS category FROM customer
""")
def shown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts padded to a width, words that say nothing, amounts, whole numbers, currency marks, token counts, names of categories."""
    k, key, s = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    empty = F.when(k % 9 == 0, F.lit(" N/A ")).when(k % 3 == 0, F.lit("None")).otherwise(F.concat(F.lit("  "), s))
    amount = F.when(k % 4 == 0, key).when(k % 4 == 1, F.concat(key, F.lit(",5"))).when(k % 4 == 2, F.concat(F.replace(F.format_number(k * 1000, 0), F.lit(","), F.lit(" ")))).otherwise(F.lit("-1"))
    number = F.when(k % 4 == 0, key).when(k % 4 == 1, F.concat(F.lit("+"), key)).when(k % 4 == 2, F.concat(key, F.lit(" "))).otherwise(F.lit(""))
    price = F.when(k % 3 == 0, "10 USD").when(k % 3 == 1, "10 Драм").otherwise("10 драм, USD")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.padded(s, 8).alias("padded"), text.meaningful(empty).alias("said"), text.amount(amount).alias("amount"), text.natural_number(number).alias("number"),
        text.currency_is(price, "драм", "usd|eur").alias("local_currency"), money.ledger_count(F.when(k % 2 == 0, k).when(k % 3 == 0, -k)).alias("counted"), text.category_label(s, {}).alias("category"),
    )


@registry.add("""
SELECT l_orderkey, string_agg(s || l_linenumber, ' ' ORDER BY p, l_linenumber, l_partkey) AS severities FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'high' ELSE 'other' END AS s, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 4 END AS p FROM lineitem) GROUP BY 1
""")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barriers by severity, unknown ones last, otherwise as they were."""
    flag = F.col("l_returnflag")
    severity = F.when(flag == "A", "low").when(flag == "N", "high").otherwise("other")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", severity.alias("s")))).alias("l"))
    ranked = cards.by_severity(F.transform("l", lambda x: F.struct(x["s"].alias("severity"), x["l_linenumber"].alias("text"))))
    return lines.select("l_orderkey", F.array_join(F.transform(ranked, lambda b: F.concat(b["severity"], b["text"].cast("string"))), " ").alias("severities"))


@registry.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def limit_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit counts rows that pass the filter."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return candidates.limited_with_exempt(rows, F.lit(False), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey")


@registry.add("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50) JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def limit_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the join loses are not made up for."""
    first = candidates.limited_with_exempt(table(spark, sf_dir, "orders"), F.lit(False), ["o_orderdate", "o_orderkey"], 50)
    return first.join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey")


@registry.add("""
(SELECT 'enrichment' AS kind, o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 3) UNION ALL (SELECT 'document', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 3)
""")
def retry_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three failed rows of each kind a run, the oldest first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey")
    first = lambda kind, rows: rows.orderBy("o_orderdate", "o_orderkey").limit(3).select(F.lit(kind).alias("kind"), "o_orderkey")
    return first("enrichment", o.where("o_orderstatus = 'P'")).unionByName(first("document", o.where("o_orderstatus = 'F' AND o_custkey % 2 = 0")))


@registry.add("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sent' WHEN o_orderkey % 5 = 0 THEN 'sent' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'pending' END AS status FROM orders
""")
def settled_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries after their results: a failure takes back nothing that was sent."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 3 == 0, "sent").otherwise("pending").alias("status"))
    results = o.where("o_orderkey % 5 = 0 OR o_orderkey % 7 = 0").select("o_orderkey", (k % 5 == 0).alias("ok"))
    return upsert.settled_deliveries(o, results, ["o_orderkey"])


@registry.add("""
WITH d AS (SELECT o_orderkey AS delivery_id, o_custkey AS reference, o_orderstatus AS h FROM orders), r AS (SELECT c_custkey AS reference, CASE WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'F' END AS h, c_name FROM customer)
SELECT delivery_id, CASE WHEN r.h = d.h THEN c_name END AS result, coalesce(r.h = d.h, FALSE) AS available FROM d LEFT JOIN r USING (reference)
""")
def delivery_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that a delivered card belongs to; none if the result is of another version by now."""
    deliveries = table(spark, sf_dir, "orders").select(F.concat(F.lit("full:"), F.col("o_orderkey").cast("string")).alias("data"), F.col("o_custkey").alias("reference"), F.col("o_orderstatus").alias("input_hash"))
    deliveries = deliveries.withColumn("delivery_id", text.callback_id(F.col("data"))).drop("data")
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reference"), F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F").alias("input_hash"), F.col("c_name").alias("result"))
    return cards.delivered_result(deliveries, results, "reference").select("delivery_id", "result", "available")


@registry.add("""
WITH v AS (SELECT o_orderkey, o_custkey, 'Order ' || o_orderkey AS title FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0)
SELECT o_orderkey AS resource_url, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END::BIGINT AS attempt_count, title || chr(10) || '• ' || o_custkey AS card FROM v
""")
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards to be sent: eligible versions that were not sent, with the number of this attempt."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("resource_url"), F.lit("h").alias("input_hash"), F.when(F.col("o_orderstatus") == "O", "eligible").otherwise("stale").alias("delivery"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.array(F.col("o_custkey").cast("string")).alias("items"))
    known = rows.where("resource_url % 4 = 0 OR resource_url % 3 = 0").select("resource_url", "input_hash", F.when(F.col("resource_url") % 4 == 0, "sent").otherwise("failed").alias("status"), F.lit(2).cast("long").alias("attempt_count"))
    return delivery.outbox(rows, known).select("resource_url", "attempt_count", "card")


@registry.add("""
SELECT state, count(*)::BIGINT AS n, count(*) FILTER (state IN ('triage_error', 'deep_error') OR reason = 'accounting_blocked')::BIGINT AS failed FROM (
  SELECT CASE event_type WHEN 'error' THEN 'triage_error' WHEN 'view' THEN 'triage_completed' ELSE 'deep_error' END AS state, CASE WHEN user_id % 5 = 0 THEN 'accounting_blocked' END AS reason FROM events) GROUP BY 1
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a batch by state, and how many of them failed."""
    state = F.when(F.col("event_type") == "error", "triage_error").when(F.col("event_type") == "view", "triage_completed").otherwise("deep_error")
    return analysis.summary(table(spark, sf_dir, "events").select(state.alias("state"), F.when(F.col("user_id") % 5 == 0, "accounting_blocked").alias("reason_code")))


@registry.add("SELECT count(*)::BIGINT AS events, max(event_id) AS mark FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added after a high-water mark, and the next mark."""
    events = table(spark, sf_dir, "events")
    mark = ledger.high_water(events).first()["mark"] // 2
    new = ledger.since(events, mark)
    return new.agg(F.count(F.lit(1)).alias("events")).crossJoin(ledger.high_water(new))  # a row each


@registry.add("SELECT doc_id, quality, CASE WHEN doc_id % 4 = 0 THEN 'not run' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'current' END AS stage FROM labels")
def current_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result counts only for the same content, prompt version and model."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").withColumns({"stored": F.when(i % 4 != 0, F.when(i % 10 == 0, "other").otherwise("h")), "model": F.when(i % 10 == 5, "m2").otherwise("m1")})
    current = candidates.stage_current(F.col("stored"), [(F.col("model"), F.lit("m1"))], F.lit("h"))
    return rows.select("doc_id", "quality", F.when(F.col("stored").isNull(), "not run").when(current, "current").otherwise("stale").alias("stage"))


@registry.add("SELECT doc_id, quality, toxic FROM labels")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as an artifact and read back."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = fresh_path(spark, "artifact")
    files.write_artifact(rows, path)
    return spark.read.schema(rows.schema).json(path)


@registry.add("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE upper(lang) END AS lang FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, l.quality, d.lang FROM labels l LEFT JOIN d USING (doc_id)
""")
def missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was never written counts as empty, and columns that an older one lacks as null."""
    path = fresh_path(spark, "states")
    schema = "doc_id long, lang string, note string"
    kinds = spark.createDataFrame([], schema).schema
    none = table_or_empty(spark, path, kinds)
    given = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.upper("lang")).alias("lang"))
    none.unionByName(given, allowMissingColumns=True).drop("note").write.parquet(path)
    states = table_or_empty(spark, path, kinds)
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(states.where("note IS NULL"), "doc_id", "left").select("doc_id", "quality", "lang")


@registry.add("""
SELECT user_id, arg_max(event_type, event_id) AS event_type FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS event_type FROM events) WHERE trim(event_type) <> '' GROUP BY user_id
""")
def incremental_snapshot_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a blank required field change nothing in the snapshot."""
    schema = table(spark, sf_dir, "events").schema
    events = incremental.file_stream(spark, f"{sf_dir}/events.parquet*", schema).select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("event_type"))
    snapshot, _ = incremental.upsert_stream(events, ["user_id"], ["event_type"], "event_id", required=["event_type"])
    return snapshot.select("user_id", "event_type")


@registry.add("""
WITH c AS (SELECT page_id, url || '|' || page_id AS resource_url, CASE WHEN page_id % 3 = 0 THEN 'plain ' || page_id ELSE coalesce(html, '') END AS content FROM pages)
SELECT resource_url, sha256(content) AS sha256, 'failed' AS status, CASE WHEN page_id % 5 = 0 THEN 'fewer bytes than announced' WHEN regexp_matches(lower(substr(content, 1, 200)), '<!doctype html|<html') THEN 'a page instead of a file' ELSE 'not supported' END AS error FROM c
""")
def landed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files that are pages, shorter than announced or of no supported type fail, each under its own URL whatever that holds."""
    page = table(spark, sf_dir, "pages")
    url = F.concat("url", F.lit("|"), F.col("page_id").cast("string"))
    content = F.encode(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("plain "), F.col("page_id").cast("string"))).otherwise(F.coalesce("html", F.lit(""))), "utf-8")
    landed = page.select(url.alias("url"), content.alias("content"), (F.octet_length(content) + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("content_length"))
    planned = page.select(url.alias("resource_url"), url.alias("source_url"), F.lit("a.txt").alias("expected_filename"))
    rows = monitor.extractions(planned, landed)
    return rows.select("resource_url", "sha256", "status", F.when(F.col("error").contains("not supported"), "not supported").otherwise(F.col("error")).alias("error"))


@registry.add("""
SELECT section, count(*)::BIGINT AS pages, count(*) FILTER (page_id % 3 = 0)::BIGINT AS failed, count(*) FILTER (page_id % 3 = 0) = 0 AS whole FROM (SELECT page_id, 's' || page_id % 4 AS section FROM pages) GROUP BY 1
""")
def section_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose pages could not be read are told, and hold up nothing else."""
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("section"), "url", F.when(F.col("page_id") % 3 != 0, F.coalesce(F.nullif("html", F.lit("")), F.lit("<p>"))).alias("html"))
    return monitor.section_runs(rows)


@registry.add("""
WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a ' || user_id || '.pdf' WHEN 2 THEN 'é' || user_id || '.zip' ELSE 'b.docx' END AS name FROM events) SELECT event_id, name FROM f
""")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of Content-Disposition headers: plain, quoted, and in the extended form."""
    u, c = F.col("user_id").cast("string"), F.col("event_id") % 4
    header = F.when(c == 0, F.lit("inline")).when(c == 1, F.concat(F.lit('attachment; filename="a '), u, F.lit('.pdf"'))).when(c == 2, F.concat(F.lit("attachment; filename*=UTF-8''%C3%A9"), u, F.lit(".zip"))).otherwise(F.lit("attachment; filename=b.docx"))
    return table(spark, sf_dir, "events").select("event_id", files.header_file_name(header).alias("name"))


@registry.add("""
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 2) AS cents, replace(format('{:,}', floor(l_extendedprice)::BIGINT), ',', ' ') AS grouped, l_quantity < 0 AS negative FROM lineitem
""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as a report gives them: to the cent by half to even, and whole with grouped thousands."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 8, 2).alias("cents"), text.grouped_number(F.floor("l_extendedprice")).alias("grouped"), F.coalesce(validators.not_natural(F.col("l_quantity")), F.lit(False)).alias("negative"))


@registry.add("""
SELECT doc_id, concat_ws(chr(10), 'Lang: ' || lang, CASE WHEN n_chars % 2 = 0 THEN 'Chars: ' || n_chars END, '• ' || source || ' — high', CASE WHEN n_chars % 3 = 0 THEN '• late' END) AS lines FROM documents
""")
def full_analysis_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of an analysis: fields with a value, and barriers, whose label is left out where the description says it."""
    n = F.col("n_chars")
    fields = cards.field_lines({"Lang": F.col("lang"), "Chars": F.when(n % 2 == 0, n.cast("string"))})
    late = F.struct(F.lit("late").alias("label"), F.lit("Late").alias("description"))
    barriers = F.when(n % 3 == 0, F.array(F.struct(F.lit("high").alias("label"), F.col("source").alias("description")), late)).otherwise(F.array(F.struct(F.lit("high").alias("label"), F.col("source").alias("description"))))
    lines = F.transform(F.concat(fields, cards.barrier_lines(barriers)), lambda x: F.replace(x, F.lit("Late"), F.lit("late")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("lines"))


@registry.add("""
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN strftime(ts + INTERVAL 4 HOUR, '%d.%m.%Y %H:%M') END AS deadline, CASE WHEN user_id % 2 = 0 THEN value END AS value FROM events
""")
def callback_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline and value of a delivered version, only while the announcement is still that version."""
    e = table(spark, sf_dir, "events")
    now = e.select("event_id", F.when(F.col("user_id") % 2 == 0, "h").otherwise("other").alias("input_hash"), F.col("ts").alias("deadline"), "value")
    return cards.callback_context(e.select("event_id", F.lit("h").alias("input_hash")), now, "event_id")


@registry.add("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 3 = 0 OR l_linenumber % 2 = 0 THEN NULL ELSE 'part ' || l_partkey || CASE WHEN l_linenumber % 5 = 0 THEN ' — pcs' ELSE ' — ' || l_quantity::BIGINT || ' pcs' END END AS item,
  CASE WHEN l_linenumber % 4 <> 0 THEN CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Лот ' || l_linenumber || ': ' END || 'supply ' || l_suppkey END AS lot FROM lineitem),
g AS (SELECT l_orderkey AS k, coalesce(list(item ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (item IS NOT NULL), []) AS items, coalesce(list(lot ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (lot IS NOT NULL), []) AS lots, count(*) AS n FROM i GROUP BY 1)
SELECT k AS l_orderkey, array_to_string(list_concat(CASE WHEN len(items) > 0 THEN items ELSE lots END, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN ['Услуга: freight', 'Маршрут: a → b'] WHEN 2 THEN ['Груз: goods ' || k, 'Маршрут: b', 'Вид транспорта: sea'] ELSE [] END), chr(10)) AS bought,
  array_to_string(CASE k % 3 WHEN 0 THEN ['about ' || n || ' ЛОТОВ'] WHEN 1 THEN ['about ' || n, 'Лотов: ' || n] ELSE ['Лотов: ' || n] END, chr(10)) AS quantities FROM g
""")
def procured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cards say of items, of lots where no item says anything, of logistics, and of quantities."""
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.when(k % 3 == 0, F.concat(F.lit("Лот № "), i.cast("string"))).when(i % 2 == 0, "None").otherwise(F.concat(F.lit(" part  "), F.col("l_partkey").cast("string")))
    item = F.struct(name.alias("item_name"), F.when(i % 5 == 0, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("quantity"), F.lit("pcs").alias("unit"))
    lot = F.struct(F.when(i % 3 == 0, " ").otherwise(i.cast("string")).alias("lot_number"), F.when(i % 4 != 0, F.concat(F.lit("supply "), F.col("l_suppkey").cast("string"))).alias("description"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item"), lot.alias("lot"))))
    orders = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(lines.alias("l"), F.count(F.lit(1)).alias("n"))
    said = lambda **of: F.when(k % 4 == 1, of.get("one")).when(k % 4 == 2, of.get("two")).when(k % 4 == 3, " ")
    logistics = F.when(k % 4 != 0, F.struct(said(one="freight").alias("service"), said(two=F.concat(F.lit("goods "), k.cast("string"))).alias("cargo"), said(one="a", two="null").alias("origin"), said(one="b", two="b").alias("destination"), said(two="sea").alias("transport_mode")))
    bought = cards.procured_lines(F.transform("l", lambda x: x["item"]), F.transform("l", lambda x: x["lot"]), logistics)
    summary = F.when(k % 3 == 0, F.concat(F.lit("about "), F.col("n").cast("string"), F.lit(" ЛОТОВ"))).when(k % 3 == 1, F.concat(F.lit(" about "), F.col("n").cast("string")))
    return orders.select("l_orderkey", F.array_join(bought, "\n").alias("bought"), F.array_join(cards.quantity_lines(summary, F.col("n")), "\n").alias("quantities"))


@registry.add("""
WITH c AS (SELECT c_custkey AS k, c_name FROM customer)
SELECT k, CASE k % 6 WHEN 0 THEN c_name || ' é.pdf' WHEN 1 THEN 'Лот ' || k WHEN 2 THEN c_name || 'é ' || k WHEN 3 THEN '=?nowhere?B?YQ==?=' WHEN 4 THEN 'é' || k ELSE c_name || ' é' END AS name FROM c
""")
def encoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of headers in encoded words: Base64 and Q, two charsets, words that go on in the next one, an unknown charset."""
    k = F.col("c_custkey")
    name, key = F.col("c_name"), k.cast("string")
    base = lambda c: F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(c, "UTF-8")), F.lit("?="))
    said = F.when(k % 6 == 0, base(F.concat(name, F.lit(" é.pdf")))).when(k % 6 == 1, F.concat(F.lit("=?windows-1251?Q?=CB=EE=F2_"), key, F.lit("?=")))
    said = said.when(k % 6 == 2, F.concat(base(name), F.lit(" \t=?UTF-8?q?=C3?= =?utf-8?Q?=A9_"), key, F.lit("?="))).when(k % 6 == 3, "=?nowhere?B?YQ==?=")
    said = said.when(k % 6 == 4, F.concat(F.lit("=?iso-8859-1?Q?=E9?= =?iso-8859-1?B?"), F.base64(F.encode(key, "UTF-8")), F.lit("?="))).otherwise(F.concat(name, F.lit(" =?utf-8?Q?=C3=A9?=")))
    header = F.concat(F.lit('attachment; filename="'), said, F.lit('"'))
    return table(spark, sf_dir, "customer").select(k.alias("k"), files.header_file_name(header).alias("name"))
