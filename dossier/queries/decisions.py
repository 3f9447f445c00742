"""Rules, validators, evaluation, office files and incremental runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import dates, money, rules
from dossier.operators import contexts, evaluation, validators
from dossier.queries.base import Registry, table
from dossier.sources import files, office

registry = Registry()




@registry.add("""
WITH d AS (SELECT o_orderkey, date_trunc('second', o_orderdate) AS a, o_orderkey % 5 AS kind FROM orders),
p AS (SELECT o_orderkey, kind, a - INTERVAL 4 HOUR AS x,
  CASE kind WHEN 2 THEN a - INTERVAL 4 HOUR WHEN 3 THEN date_trunc('day', a) + INTERVAL 86399 SECOND - INTERVAL 4 HOUR WHEN 4 THEN a + INTERVAL 30 DAY END AS y FROM d),
r AS (SELECT *, greatest(x, coalesce(y, x)) AS latest FROM p)
SELECT o_orderkey, CASE WHEN latest <= TIMESTAMP '1996-01-01' AND kind = 1 THEN 'unknown' WHEN latest <= TIMESTAMP '1996-01-01' THEN 'expired' WHEN y IS NULL OR x = y THEN 'eligible' ELSE 'conflict' END AS status, latest AS resolved FROM r
""")
def deadline_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines as texts of two sources in several forms, against one instant."""
    when = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    other = (
        F.when(kind == 1, "soon")
        .when(kind == 2, F.date_format(when, "dd/MM/yyyy HH:mm:ss"))
        .when(kind == 3, F.date_format(when, "yyyy-MM-dd"))
        .when(kind == 4, F.date_format(when + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    found = dates.eligibility([F.date_format(when, "yyyy-MM-dd  HH:mm:ss"), other], F.lit("1996-01-01 00:00:00").cast("timestamp"), "+04:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("e")).select("o_orderkey", "e.status", "e.resolved")


@registry.add("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'manual_review' WHEN o_orderkey % 3 <> 0 AND o_totalprice < 100000 THEN 'skip_low_value' WHEN o_orderkey % 3 <> 0 THEN 'deep_candidate' WHEN o_custkey % 2 = 0 THEN 'insufficient_data' ELSE 'deep_candidate' END AS gate FROM orders
""")
def commercial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    gate = rules.commercial_gate(F.col("o_orderstatus") == "P", value, F.lit(100_000), F.col("o_custkey") % 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("gate"))


@registry.add("""
WITH lot AS (SELECT l_orderkey, sum(l_extendedprice::BIGINT)::BIGINT AS lot_sum FROM lineitem GROUP BY 1),
v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN lot_sum ELSE o_totalprice::BIGINT END AS official, lot_sum FROM orders LEFT JOIN lot ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN coalesce(official <> lot_sum, false) THEN NULL ELSE coalesce(official, lot_sum) END AS value,
  CASE WHEN coalesce(official <> lot_sum, false) THEN 'unknown' WHEN official IS NOT NULL THEN 'official_tender_value' WHEN lot_sum IS NOT NULL THEN 'sum_of_official_lot_values' ELSE 'unknown' END AS source FROM v
""")
def value_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.bround("l_extendedprice").cast("long")).alias("lot_sum"))
    orders = table(spark, sf_dir, "orders").join(lots, "o_orderkey", "left")
    kind = F.col("o_orderkey") % 4
    official = F.when(kind == 1, F.col("lot_sum")).when(kind > 1, F.bround("o_totalprice").cast("long"))
    return orders.select("o_orderkey", rules.value_facts(official, F.col("lot_sum")).alias("v")).select("o_orderkey", "v.value", "v.source")


@registry.add("""
WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(event_id, event_id) AS last_id, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT c_custkey, c_acctbal, s.user_id IS NOT NULL AS has_state, coalesce(n % 3 = 0, false) AS same,
  CASE event_type WHEN 'click' THEN 'stopped_not_relevant' WHEN 'view' THEN 'deep_completed' WHEN 'error' THEN 'commercial_gate_skip' WHEN 'purchase' THEN 'triage_completed' ELSE 'skipped_expired' END AS state,
  c_custkey % 2 = 0 AS tcur, c_custkey % 11 = 0 AS tfail, c_mktsegment = 'BUILDING' AS notrel, c_mktsegment = 'MACHINERY' AS dcur, c_custkey % 13 = 0 AS dfail, c_acctbal < 0 AS expired
  FROM customer LEFT JOIN s ON s.user_id = c_custkey),
r AS (SELECT *, CASE WHEN NOT tcur AND tfail THEN NULL WHEN NOT tcur AND NOT has_state THEN 'needs_triage' WHEN NOT tcur THEN 'retry_triage'
  WHEN notrel AND same AND has_state AND state = 'stopped_not_relevant' THEN NULL WHEN notrel THEN 'needs_routing' WHEN dcur AND same AND has_state AND state = 'deep_completed' THEN NULL WHEN dcur THEN 'needs_routing'
  WHEN dfail THEN NULL WHEN same AND has_state AND state = 'commercial_gate_skip' THEN NULL WHEN NOT has_state OR state = 'triage_completed' THEN 'needs_deep' ELSE 'retry_deep' END AS reason FROM c)
SELECT c_custkey, CASE WHEN reason IN ('needs_triage', 'retry_triage', 'needs_deep', 'retry_deep') AND expired AND same AND has_state AND state = 'skipped_expired' THEN NULL
  WHEN reason IN ('needs_triage', 'retry_triage', 'needs_deep', 'retry_deep') AND expired THEN 'skip_expired' ELSE reason END AS reason FROM r
""")
def pending_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's announcement waits for, with the last event as its state."""
    state = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("event_type"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(state, "c_custkey", "left")
    names = {"click": "stopped_not_relevant", "view": "deep_completed", "error": "commercial_gate_skip", "purchase": "triage_completed"}
    name = F.lit("skipped_expired")
    for k, v in names.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    key, has = F.col("c_custkey"), F.col("event_type").isNotNull()
    given = {
        "triage_current": key % 2 == 0, "triage_failure_known": key % 11 == 0, "not_relevant": F.col("c_mktsegment") == "BUILDING", "deep_current": F.col("c_mktsegment") == "MACHINERY",
        "deep_failure_known": key % 13 == 0, "has_state": has, "same_hash": F.coalesce(F.col("n") % 3 == 0, F.lit(False)), "state": F.when(has, name),
        "memo_same_value": F.lit(True), "memo_same_tokens": F.lit(True), "expired": F.col("c_acctbal") < 0,
    }
    return rows.select("c_custkey", rules.pending_reason(given).alias("reason"))


@registry.add("""
WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'skipped' ELSE 'failed' END AS status, 'm' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '.pdf' END AS name FROM lineitem),
c AS (SELECT l_orderkey, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (status = 'skipped') AS skip,
  list_sort(list_distinct(list(CASE WHEN name LIKE '%.pdf' THEN '.pdf' ELSE '(no extension)' END) FILTER (status = 'skipped'))) AS ext FROM e GROUP BY 1)
SELECT o_orderkey, coalesce(ok, 0)::BIGINT AS successful, coalesce(bad, 0)::BIGINT AS failed, coalesce(skip, 0)::BIGINT AS skipped, coalesce(array_to_string(ext, ','), '') AS unsupported,
  coalesce(bad, 0) = 0 AND coalesce(skip, 0) = 0 AND o_orderstatus <> 'P' AND coalesce(ok, 0) > 0 AS complete FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
""")
def document_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "skipped").otherwise("failed")
    name = F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.lit(".pdf")))
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), status.alias("status"), name.alias("member_name"), F.lit("x").alias("text"))
    orders = table(spark, sf_dir, "orders")
    known = orders.select("o_orderkey", F.array(F.lit("https://files.example.org/terms.docx")).alias("known_names"))
    state = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"))
    return contexts.coverage(documents, known, "o_orderkey", state).select("o_orderkey", "successful", "failed", "skipped", F.array_join("unsupported", ",").alias("unsupported"), "complete")


@registry.add("""
WITH r AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 2) AS readable FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, concat_ws(',', CASE WHEN n IS NULL THEN 'no_extraction' END, CASE WHEN failed > 0 THEN 'failed_extraction' END, CASE WHEN readable > 0 THEN 'skipped_supported_members' END) AS reasons
FROM orders LEFT JOIN r ON doc_id = o_orderkey WHERE n IS NULL OR failed > 0 OR readable > 0
""")
def backfill_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "N", "skipped").otherwise("success")
    name = F.when(F.col("l_linenumber") == 2, "a.zip!/b.xlsx").otherwise("a.zip!/b.pdf")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), status.alias("status"), name.alias("member_name"))
    found = contexts.backfill_reasons(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), rows, "doc_id")
    return found.withColumn("reasons", F.array_join("reasons", ","))


@registry.add("""
WITH d AS (SELECT l_orderkey, l_partkey AS document_id, 'f' || l_linenumber || CASE l_linenumber % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' ELSE '.pdf' END AS filename,
  CASE l_returnflag WHEN 'A' THEN 'hy' WHEN 'N' THEN 'en' ELSE 'ru' END AS language, l_linenumber AS k FROM lineitem),
r AS (SELECT *, CASE language WHEN 'ru' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS l, CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 0 THEN 3 END AS f FROM d WHERE k % 4 <> 3)
SELECT l_orderkey, arg_min(document_id::VARCHAR, (l, f, k, document_id)) AS source_ref, arg_min(filename, (l, f, k, document_id)) AS expected_filename, 'armeps_document' AS source_kind FROM r GROUP BY l_orderkey
""")
def document_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document to read of each order: by language, then format, then place."""
    kind = F.col("l_linenumber") % 4
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(kind == 0, ".zip").when(kind == 1, ".docx").when(kind == 2, ".xlsx").otherwise(".pdf"))
    language = F.when(F.col("l_returnflag") == "A", "hy").when(F.col("l_returnflag") == "N", "en").otherwise("ru")
    lots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("document_id"), name.alias("filename"), language.alias("language")))).alias("documents"))
    plan = rules.document_plan(F.lit("armeps_documents_page"), F.lit("https://files.example.org/x"), F.lit(None).cast("string"), F.col("documents"))
    return lots.select("l_orderkey", plan.alias("p")).where("p IS NOT NULL").select("l_orderkey", "p.source_ref", "p.expected_filename", "p.source_kind")


@registry.add("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'timeout' WHEN k BETWEEN 1 AND 3 THEN 'authentication' WHEN k = 29 THEN 'rate_limit' WHEN k >= 60 THEN 'server' ELSE 'request' END AS kind,
  event_id % 9 = 0 OR k >= 60 AND k NOT IN (-1) OR (k IN (8, 9, 29) AND NOT event_id % 2 = 0) AS retryable
FROM (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events)
""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls by their status and whether they are tried again."""
    k = F.from_json("props", "k long")["k"]
    status = F.when(k.between(1, 2), F.lit(401)).when(k == 3, F.lit(403)).when(k == 8, F.lit(408)).when(k == 9, F.lit(409)).when(k == 29, F.lit(429)).when(k >= 60, F.lit(503)).otherwise(F.lit(400))
    found = rules.error_kind(status, F.col("event_id") % 9 == 0, F.col("event_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", found.alias("e")).select("event_id", "e.kind", "e.retryable")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expectations; predictions by length."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    expected = F.when(F.col("toxic") == 1, "not_relevant").when(F.col("quality") == 1, "relevant").otherwise("maybe")
    predicted = F.when(F.col("n_chars") < 500, "not_relevant").when(F.col("n_chars") > 1500, "relevant").otherwise("maybe")
    kind = lambda c: F.when(F.col(c) == "relevant", "procurement").when(F.col(c) == "maybe", "unclear").otherwise("unrelated")
    rows = labels.select("doc_id", expected.alias("expected_status"), predicted.alias("predicted_status"), F.when(F.col("quality") == 1, F.col("lang")).alias("expected_category"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("xx").alias("predicted_category"))
    return evaluation.compared(rows.withColumns({"expected_type": kind("expected_status"), "predicted_type": kind("predicted_status")}))


CASES = """
WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'not_relevant' WHEN quality = 1 THEN 'relevant' ELSE 'maybe' END AS e, CASE WHEN n_chars < 500 THEN 'not_relevant' WHEN n_chars > 1500 THEN 'relevant' ELSE 'maybe' END AS p,
  CASE WHEN quality = 1 THEN lang END AS ec, CASE WHEN n_chars % 2 = 0 THEN lang ELSE 'xx' END AS pc FROM labels JOIN documents USING (doc_id)),
m AS (SELECT *, CASE WHEN e = 'relevant' AND p = 'not_relevant' THEN 'false_negative' WHEN e = 'not_relevant' AND p = 'relevant' THEN 'false_positive' WHEN e <> p THEN 'maybe_unclear' ELSE 'none' END AS mismatch FROM c)
"""


@registry.add(CASES + """
, a AS (SELECT count(*) FILTER (e = p) AS s, count(*) AS n, count(*) FILTER (ec = pc) AS c, count(ec) AS nc, count(*) FILTER (e = p AND ec IS NOT DISTINCT FROM pc) AS f FROM m)
SELECT 'status' AS metric, s::BIGINT AS correct, n::BIGINT AS total, s / n::DOUBLE AS ratio FROM a UNION ALL SELECT 'type', s, n, s / n::DOUBLE FROM a UNION ALL SELECT 'category', c, nc, c / nc::DOUBLE FROM a
UNION ALL SELECT 'core', s, n, s / n::DOUBLE FROM a UNION ALL SELECT 'full', f, n, f / n::DOUBLE FROM a
""")
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_cases(spark, sf_dir))


@registry.add(CASES + """
SELECT l.e AS expected_status, count(*) FILTER (m.p = 'relevant')::BIGINT AS relevant, count(*) FILTER (m.p = 'maybe')::BIGINT AS maybe, count(*) FILTER (m.p = 'not_relevant')::BIGINT AS not_relevant
FROM (VALUES ('relevant'), ('maybe'), ('not_relevant')) l(e) LEFT JOIN m ON m.e = l.e GROUP BY l.e
""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_cases(spark, sf_dir), "expected_status", "predicted_status")


@registry.add(CASES + "SELECT mismatch, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM m GROUP BY mismatch")
def mismatch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mismatches(_cases(spark, sf_dir), "doc_id")


@registry.add(CASES + "SELECT mismatch, doc_id, row_number() OVER (PARTITION BY mismatch ORDER BY doc_id) AS place FROM m WHERE mismatch <> 'none'")
def mismatch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of each class of mismatch in order."""
    return evaluation.mismatch_ids(_cases(spark, sf_dir), "doc_id", "doc_id").select("mismatch", "doc_id", "place")


@registry.add(CASES + """
SELECT p AS predicted_status, bool_and(e = p) AS all_right, count(*) FILTER (mismatch = 'false_negative') = 0 AS no_misses, count(*) FILTER (mismatch = 'false_positive') = 0 AS no_false_alarms, true AS no_errors,
  bool_and(e = p) AND count(*) FILTER (mismatch IN ('false_negative', 'false_positive')) = 0 AS passes FROM m GROUP BY p
""")
def acceptance_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.passes(_cases(spark, sf_dir), F.lit(False), ["predicted_status"])


@registry.add("""
WITH b AS (SELECT item_id, text, CASE WHEN item_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS h FROM benchmark), c AS (SELECT item_id, sha256(text) AS h FROM benchmark WHERE item_id % 7 <> 0)
SELECT b.item_id, CASE WHEN c.h IS NULL THEN 'missing' WHEN c.h = b.h THEN 'ok' ELSE 'stale' END AS preparation FROM b LEFT JOIN c USING (item_id)
""")
def golden_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("input_hash"))
    cases = items.withColumn("input_hash", F.when(F.col("item_id") % 4 == 0, F.lit("old")).otherwise(F.col("input_hash")))
    return evaluation.prepared(cases, items.where("item_id % 7 <> 0"), "item_id").select("item_id", "preparation")


@registry.add("""
SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 AND quality = 0 THEN 'category' END, CASE WHEN toxic = 1 AND quality = 1 OR toxic = 0 AND quality = 0 THEN 'pair' END, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'deep_flag' END) AS errors FROM labels
""")
def triage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of triage rows: types and categories that don't go together, and a flag that must not be set."""
    status = F.when(F.col("toxic") == 1, "not_relevant").otherwise("relevant")
    kind = F.when(F.col("quality") == 1, "procurement").when(F.col("toxic") == 1, "unrelated").otherwise("other_service")
    found = validators.triage_errors(status, kind, F.lit("office_goods"), F.lit("high"), F.lit("because"), F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(found, ",").alias("errors"))


@registry.add("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority LIKE '5%' THEN 'summary' END, CASE WHEN o_orderstatus = 'P' THEN 'type' END,
  CASE WHEN (o_orderstatus = 'F') <> (o_orderkey % 3 = 0) THEN 'procurement' END, CASE WHEN (o_orderstatus = 'O') <> (o_orderkey % 5 = 0) THEN 'logistics' END) AS errors FROM orders
""")
def deep_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of deep results: blank texts, unknown types, and blocks that don't go with the type."""
    kind = F.when(F.col("o_orderstatus") == "F", "procurement").when(F.col("o_orderstatus") == "O", "logistics").otherwise("transport")
    said = F.when(F.col("o_orderpriority").startswith("5"), F.lit(" ")).otherwise(F.col("o_orderpriority"))
    found = validators.deep_errors(said, F.lit("why"), kind, F.lit("low"), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("errors"))


@registry.add("SELECT event_id, CASE event_type WHEN 'error' THEN 'missing:k' WHEN 'view' THEN 'extra:kk,missing:k' ELSE '' END AS errors FROM events")
def json_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are missing or too many after a change to the events' properties."""
    events = table(spark, sf_dir, "events")
    changed = F.when(F.col("event_type") == "error", F.lit("{}")).when(F.col("event_type") == "view", F.replace(F.col("props"), F.lit('"k"'), F.lit('"kk"'))).otherwise(F.col("props"))
    return events.select("event_id", F.array_join(validators.key_errors(changed, ["k"]), ",").alias("errors"))


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    deep = office.zipped({"x.docx": office.built_docx([])})
    for batch in batches:
        names, contents = [], []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines = (t or "").split("\n")
            inner = office.zipped({"in.docx": office.built_docx(lines[:1]), "deep.zip": deep})
            names.append(f"{i}.zip")
            contents.append(office.zipped({"a.docx": office.built_docx(lines, [["n", str(i)]]), "b.xlsx": office.built_xlsx({"Lot": [["id", str(i)], ["", "x"]]}), "c.pdf": b"%", "d.docx": b"damaged", "e.zip": inner}))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["path", "content"])


@registry.add(r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines, len(string_split(text, chr(10)))::BIGINT AS n,
  regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS head FROM documents)
SELECT doc_id || '.zip' AS path, 'a.docx' AS member_name, 'success' AS status, sha256(array_to_string(list_append(lines, 'n' || chr(9) || doc_id), chr(10))) AS text_hash, n AS paragraph_count FROM t
UNION ALL SELECT doc_id || '.zip', 'b.xlsx', 'success', sha256('[Sheet: Lot]' || chr(10) || 'id' || chr(9) || doc_id || chr(10) || chr(9) || 'x'), NULL FROM t
UNION ALL SELECT doc_id || '.zip', 'c.pdf', 'skipped', NULL, NULL FROM t UNION ALL SELECT doc_id || '.zip', 'd.docx', 'failed', NULL, NULL FROM t
UNION ALL SELECT doc_id || '.zip', 'e.zip!/in.docx', 'success', sha256(head), 1 FROM t UNION ALL SELECT doc_id || '.zip', 'e.zip!/deep.zip', 'skipped', NULL, NULL FROM t
""")
def archive_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document written into an archive of office files, some damaged or too deep, and all of it read back."""
    archives = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_filed, "path string, content binary")
    rows = office.extracted(archives)
    return rows.select("path", "member_name", "status", F.sha2("text", 256).alias("text_hash"), "paragraph_count")


@registry.add("""
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'needs_triage' WHEN 'F' THEN 'needs_deep' ELSE 'skip_expired' END AS reason, o_custkey % 3 = 0 AS not_relevant,
  CASE WHEN o_totalprice < 50000 THEN 'skip_low_value' ELSE 'deep_candidate' END AS gate, o_totalprice::BIGINT AS tokens FROM orders)
SELECT CASE WHEN reason = 'skip_expired' THEN 'skip_expired' WHEN reason = 'needs_triage' THEN 'pending_triage' WHEN not_relevant THEN 'stopped_not_relevant'
  WHEN gate <> 'deep_candidate' THEN 'commercial_gate_skip:' || gate WHEN tokens > 140000 THEN 'deep:deferred_input_too_large' ELSE 'deep:admitted' END AS routing,
  count(*)::BIGINT AS n, sum(CASE WHEN reason = 'needs_triage' THEN ceil(tokens / 2.4::DECIMAL(4,1)) + 300 ELSE 0 END)::BIGINT AS triage_tokens FROM t GROUP BY 1
""")
def routing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a batch would send each announcement, and the tokens that its triage would take, without a paid call."""
    reason = F.when(F.col("o_orderstatus") == "O", "needs_triage").when(F.col("o_orderstatus") == "F", "needs_deep").otherwise("skip_expired")
    gate = rules.commercial_gate(F.lit(False), F.col("o_totalprice"), F.lit(50_000), F.lit(1))
    chars = F.bround("o_totalprice").cast("long")
    admission = rules.deep_admission(gate, F.lit(True), chars, F.lit(140_000), F.lit(True))
    routing = rules.routing(reason, F.col("o_custkey") % 3 == 0, gate, admission)
    tokens = F.when(reason == "needs_triage", money.request_tokens(chars)).otherwise(F.lit(0))
    return table(spark, sf_dir, "orders").select(routing.alias("routing"), tokens.alias("t")).groupBy("routing").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("triage_tokens"))


@registry.add("""
WITH c AS (SELECT l_partkey AS folder, CASE WHEN l_returnflag = 'A' THEN 'a.docx' ELSE 'b' END AS name, sha256(l_linenumber::VARCHAR) AS h, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
g AS (SELECT folder, name, h, min(k) AS first_k FROM c GROUP BY ALL), n AS (SELECT *, first_k = min(first_k) OVER (PARTITION BY folder, name) AS own FROM g)
SELECT folder, name, h AS sha256, CASE WHEN own THEN name WHEN name = 'b' THEN 'b__' || substr(h, 1, 8) ELSE 'a__' || substr(h, 1, 8) || '.docx' END AS landed_name, count(*)::BIGINT AS files, count(*) FILTER (k > first_k)::BIGINT AS copies
FROM c JOIN n USING (folder, name, h) GROUP BY ALL
""")
def landed_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which files land: equal contents share one, other contents of a name get digits of their hash."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("folder"), F.when(F.col("l_returnflag") == "A", "a.docx").otherwise("b").alias("name"), F.sha2(F.col("l_linenumber").cast("string"), 256).alias("sha256"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    named = files.landed_names(rows, "folder", "name", "sha256", "k")
    return named.groupBy("folder", "name", "sha256", "landed_name").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_copy").alias("copies"))


@registry.add("""
WITH l AS (SELECT l_orderkey, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1)
SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, CASE WHEN l_linenumber <> last_line THEN 'not_latest' WHEN o_orderstatus <> 'P' AND l_suppkey % 2 <> 0 THEN 'other_source' WHEN o_orderstatus <> 'P' AND l_returnflag = 'A' THEN 'unchanged' ELSE 'updated' END AS state
FROM lineitem i JOIN l USING (l_orderkey) JOIN orders ON o_orderkey = i.l_orderkey
""")
def reconciled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backfill of each version does to its announcement's state: only the latest version of the same source changes it."""
    lots = table(spark, sf_dir, "lineitem")
    last = lots.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_line"))
    joined = lots.join(last, "l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    state = rules.reconciled_state(F.col("l_linenumber") == F.col("last_line"), F.col("o_orderstatus") != "P", F.col("l_suppkey") % 2 == 0, F.col("l_returnflag") == "A")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


@registry.add("""
SELECT event_id, CASE WHEN k < 10 THEN 'refusal' WHEN k < 20 THEN 'incomplete' WHEN k < 30 THEN 'failed' WHEN k < 40 THEN 'empty' WHEN k < 50 THEN 'invalid_structured_output' WHEN k < 60 THEN 'validation' END AS kind,
  CASE WHEN k < 10 THEN 'refused' WHEN k < 20 THEN 'output_cut' WHEN k BETWEEN 40 AND 59 THEN 'invalid_output' END AS escalation
FROM (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events)
""")
def response_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with answers, and which of it goes on to a person."""
    k = F.from_json("props", "k long")["k"]
    status = F.when(k.between(10, 19), "incomplete").when(k.between(20, 29), "failed").otherwise("completed")
    said = F.when(k.between(30, 39), F.lit(" ")).when(k.between(40, 49), F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    kind = validators.response_kind(F.when(k < 10, "no"), status, said, ~k.between(50, 59))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
    return rows.select("event_id", "kind", rules.escalation(F.col("kind")).alias("escalation"))


@registry.add("""
SELECT error, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN trim(coalesce(c_mktsegment, '')) = '' THEN 'missing segment' END AS error FROM customer
  UNION ALL SELECT 'bad hash' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'repeated' FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) > 1)) WHERE error IS NOT NULL GROUP BY error
""")
def case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of a set of cases, with customers as cases."""
    digest = F.sha2(F.col("c_name"), 256)
    cases = table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("case_id"), "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.upper(digest)).otherwise(digest).alias("input_hash"))
    found = evaluation.case_errors(cases, "case_id", "input_hash", {"segment": F.col("c_mktsegment")})
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
