"""Journals of paid calls, landed updates and quotes without a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.operators import accounts, grounding, responses, results, validators
from dossier.queries.base import Registry, table
from dossier.sources import updates
from dossier.store import fresh_path, spread

registry = Registry()

KINDS = {"view": "reserved", "signup": "settled", "purchase": "reconciled", "error": "unresolved", "click": "block_opened"}
ENTRIES = f"""
WITH e AS (SELECT event_id AS seq, event_id // 4 AS reservation, ts AS moment, value::DECIMAL(38,12) AS cost, 'u' || user_id AS reference,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind,
  CASE WHEN (props::JSON ->> '$.k')::BIGINT % 3 > 0 THEN 'r' || (props::JSON ->> '$.k') END AS response_id,
  CASE event_type WHEN 'click' THEN event_id WHEN 'purchase' THEN event_id - 1 END AS block FROM events)
"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a journal, four to a reservation."""
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for said, means in KINDS.items():
        kind = F.when(F.col("event_type") == said, means).otherwise(kind)
    k = F.from_json("props", "k long")["k"]
    block = F.when(F.col("event_type") == "click", F.col("event_id")).when(F.col("event_type") == "purchase", F.col("event_id") - 1)
    cost = F.col("value").cast("decimal(38,12)")
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"), F.floor(F.col("event_id") / 4).cast("long").alias("reservation"), block.alias("block"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("reference"), F.when(k % 3 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("response_id"), cost.alias("estimate"), cost.alias("cost"),
    )


@registry.add(ENTRIES + """
, s AS (SELECT *, CASE kind WHEN 'reconciled' THEN 'settled' ELSE kind END AS status FROM e WHERE kind <> 'block_opened'),
r AS (SELECT reservation, arg_max(status, seq) AS status, min(moment) FILTER (WHERE kind = 'reserved') AS created_at, arg_max(moment, seq) AS said_at,
  arg_min(cost, seq) FILTER (WHERE kind = 'reserved') AS estimate, arg_max(cost, seq) AS cost, arg_min(reference, seq) FILTER (WHERE kind = 'reserved') AS reference FROM s GROUP BY 1)
SELECT reservation, status, created_at, CASE WHEN status = 'settled' THEN said_at END AS settled_at, estimate::VARCHAR AS estimate, cost::VARCHAR AS cost, reference FROM r
""")
def journal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reservation is after the entries of its journal: what a driver that died left behind is still reserved."""
    return accounts.journal_reservations(_entries(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("estimate", "cost")})


@registry.add(ENTRIES + """
, p AS (SELECT * FROM e WHERE kind IN ('settled', 'reconciled'))
SELECT seq, response_id, cost::VARCHAR AS cost FROM p QUALIFY response_id IS NULL OR row_number() OVER (PARTITION BY response_id ORDER BY seq) = 1
""")
def journal_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a journal: a response once, by its first entry."""
    return accounts.journal_ledger(_entries(spark, sf_dir)).select("seq", "response_id", F.col("cost").cast("string").alias("cost"))


@registry.add(ENTRIES + "SELECT seq, block, reservation FROM e WHERE kind = 'block_opened' AND block NOT IN (SELECT block FROM e WHERE kind = 'reconciled')")
def journal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that no reconciliation has settled."""
    return accounts.open_blocks(_entries(spark, sf_dir)).select("seq", "block", "reservation")


@registry.add("""
WITH r AS (SELECT coalesce(c.month, l.month) AS month, coalesce(l.spent, 0) AS spent, coalesce(c.reserved, 0) AS reserved FROM (
  SELECT date_trunc('month', created_at)::TIMESTAMP AS month, sum(estimate) AS reserved FROM (
    SELECT reservation, arg_max(CASE kind WHEN 'reconciled' THEN 'settled' ELSE kind END, seq) AS status, min(moment) FILTER (WHERE kind = 'reserved') AS created_at, arg_min(cost, seq) FILTER (WHERE kind = 'reserved') AS estimate
    FROM e WHERE kind <> 'block_opened' GROUP BY 1) WHERE status IN ('reserved', 'unresolved') GROUP BY 1) c
  FULL JOIN (SELECT date_trunc('month', moment)::TIMESTAMP AS month, sum(cost) AS spent FROM (
    SELECT * FROM e WHERE kind IN ('settled', 'reconciled') QUALIFY response_id IS NULL OR row_number() OVER (PARTITION BY response_id ORDER BY seq) = 1) GROUP BY 1) l ON l.month = c.month)
SELECT month, spent::DECIMAL(38,2)::VARCHAR AS spent, reserved::DECIMAL(38,2)::VARCHAR AS reserved FROM r
""".replace("WITH r AS", ENTRIES.strip() + ", r AS", 1))
def journal_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each month has spent and what its outstanding reservations hold, both from the entries."""
    return accounts.journal_committed(_entries(spark, sf_dir)).select("month", *(F.col(c).cast("decimal(38,2)").cast("string").alias(c) for c in ("spent", "reserved")))


LANDED = "WITH u AS (SELECT conv_id * 1000 + turn AS update_id, conv_id, turn % 6 AS kind FROM conversations)"


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Turns as landed updates: whole ones, one without a callback, one of another chat, one with other data, and two kinds of broken lines."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("update_id"), "conv_id", (F.col("turn") % 6).alias("kind"))
    kind = F.col("kind")
    chat = F.struct(F.struct(F.when(kind == 2, 8).otherwise(7).alias("id")).alias("chat"))
    data = F.concat(F.when(kind == 3, "half:").otherwise("full:"), F.col("conv_id").cast("string"))
    query = F.struct(F.concat(F.lit("c"), F.col("update_id").cast("string")).alias("id"), data.alias("data"), chat.alias("message"))
    line = F.to_json(F.struct("update_id", F.when(kind != 1, query).alias("callback_query")))
    line = F.when(kind == 4, F.substring(line, F.lit(1), F.length(line) - 3)).when(kind == 5, F.regexp_replace(line, '"update_id"', '"id"')).otherwise(line)
    path = fresh_path(spark, "landed")
    rows.select(line.alias("value")).write.text(path)
    return path


@registry.add(LANDED + " SELECT DISTINCT update_id, CASE kind WHEN 1 THEN NULL WHEN 2 THEN '8' ELSE '7' END AS chat_id, CASE kind WHEN 1 THEN NULL WHEN 3 THEN 'half:' || conv_id ELSE 'full:' || conv_id END AS data FROM u WHERE kind < 4")
def updates_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a streaming source over landed files, each id once."""
    accepted, _ = updates.received(spark, _landed(spark, sf_dir))
    return accepted.select("update_id", "chat_id", "data")


@registry.add(LANDED + " SELECT CASE kind WHEN 4 THEN 'not JSON' ELSE 'no update_id' END AS error, count(*)::BIGINT AS n FROM u WHERE kind >= 4 GROUP BY 1")
def updates_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of landed files that are no updates: set apart as rows, with the others taken all the same."""
    _, refused = updates.received(spark, _landed(spark, sf_dir))
    return refused.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@registry.add(LANDED + """
, a AS (SELECT DISTINCT update_id, conv_id, kind FROM u WHERE kind < 4)
SELECT update_id, CASE WHEN kind = 1 THEN NULL WHEN kind = 2 THEN 'forbidden_chat' WHEN kind = 3 THEN 'unknown_prefix' WHEN conv_id % 3 > 1 OR conv_id % 3 = 1 AND conv_id % 2 = 1 THEN 'delivery_not_found' WHEN conv_id % 5 = 0 THEN 'version_unavailable' ELSE 'answered' END AS outcome FROM a
""")
def update_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each accepted update comes to, with the delivery that its button names."""
    accepted, _ = updates.received(spark, _landed(spark, sf_dir))
    k = F.col("delivery_id")
    sent = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("delivery_id")).distinct().where(k % 3 < 2)
    sent = sent.select("delivery_id", F.when((k % 3 == 1) & (k % 2 == 1), "failed").otherwise("sent").alias("status"), (k % 5 != 0).alias("matches"))
    named = accepted.withColumn("delivery_id", updates.callback_id(F.col("data"))).join(sent, "delivery_id", "left").withColumn("error", F.lit(None).cast("string"))
    return named.select("update_id", updates.callback_outcome(F.lit(7), F.col("status"), F.col("matches")).alias("outcome"))


@registry.add(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
q AS (SELECT doc_id, trim(regexp_replace(substr(text, 31, 80), '\s+', ' ', 'g')) || CASE WHEN doc_id % 7 = 0 THEN '#' ELSE '' END AS q FROM documents)
SELECT q.doc_id, count(d.doc_id)::BIGINT AS n_sources, min(d.doc_id) AS first_source FROM q LEFT JOIN d ON q.q <> '' AND contains(d.t, q.q) GROUP BY q.doc_id
""")
def quote_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes that name no source come from: all texts that hold each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quotes = docs.select("doc_id", F.concat(F.trim(F.substring("text", 31, 80)), F.when(F.col("doc_id") % 7 == 0, "#").otherwise("")).alias("quote"))
    return grounding.found_sources(quotes, docs, "doc_id", "doc_id")


@registry.add(r"""
WITH d AS (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(substr(text, 1, 50), ''), '\s+', ' ', 'g')) AS q FROM documents),
o AS (SELECT d.*, n.t AS other FROM d LEFT JOIN d n ON n.doc_id = d.doc_id + 1)
SELECT doc_id, array_to_string(list_concat(CASE WHEN q = '' THEN ['blank_text'] ELSE [] END,
  list_concat(CASE WHEN q = '' THEN ['ungrounded:0'] ELSE [] END,
  list_concat(CASE WHEN doc_id % 3 = 0 AND NOT contains(t, trim(q || '~')) OR q = '' AND doc_id % 3 <> 0 THEN ['ungrounded:1'] ELSE [] END,
  CASE WHEN q = '' OR other IS NULL OR NOT contains(other, q) THEN ['ungrounded:2'] ELSE [] END))), ',') AS errors FROM o
""")
def grounded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of results with those of their evidence: an altered quote, and one that another text lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.substring("text", 1, 50)
    altered = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce(quote, F.lit("")), F.lit("~"))).otherwise(quote)
    item = lambda source, said: F.struct(source.cast("long").alias("source"), F.lit("document").alias("source_type"), said.alias("text"))
    results = docs.select("doc_id", F.array(item(F.col("doc_id"), quote), item(F.col("doc_id"), altered), item(F.col("doc_id") + 1, quote)).alias("evidence"))
    judged = grounding.evidence_grounding(results, docs.withColumnRenamed("doc_id", "source"), "doc_id")
    own = validators.evidence_errors(F.transform("evidence", lambda e: F.struct(e["source_type"], e["text"])), validators.SOURCES)
    return judged.select("doc_id", F.array_join(validators.grounded_errors(own, F.col("ungrounded")), ",").alias("errors"))


@registry.add("""
WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '$.reason: blank' WHEN 1 THEN '$.confidence: missing' WHEN 2 THEN '$: unknown field "note"' WHEN 3 THEN '$: unclear without maybe' WHEN 4 THEN '$: no deep analysis'
  WHEN 5 THEN '$.evidence[1].source_type: not one of the values;$.evidence[1].text: too long' WHEN 6 THEN '$.evidence: not a list' WHEN 7 THEN '$: not JSON' ELSE '' END AS faults FROM o
""")
def triage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all faults of triage results that are broken in one way or another."""
    k = F.col("o_orderkey") % 11
    item = lambda source, said: F.struct(source.alias("source_type"), F.lit("title").alias("field"), F.lit(None).cast("long").alias("download_id"), F.lit(None).cast("string").alias("member_name"), said.alias("text"))
    evidence = F.array(item(F.lit("announcement"), F.col("o_orderpriority")), item(F.when(k == 5, "rumour").otherwise("document"), F.when(k == 5, F.repeat(F.lit("x"), F.lit(501))).otherwise("y")))
    result = F.struct(
        F.lit("relevant").alias("relevance_status"), F.when(k == 3, "unclear").otherwise("procurement").alias("opportunity_type"), F.lit(None).cast("string").alias("category"), F.lit("high").alias("confidence"),
        F.when(k == 0, " \t").otherwise(F.col("o_orderpriority")).alias("reason"), (k != 4).alias("requires_deep_analysis"), evidence.alias("evidence"),
    )
    json = F.to_json(result, {"ignoreNullFields": "false"})
    json = F.when(k == 1, F.replace(json, F.lit('"confidence":"high",'), F.lit(""))).when(k == 2, F.replace(json, F.lit('"confidence"'), F.lit('"note":1,"confidence"'))).when(k == 6, F.regexp_replace(json, r'"evidence":\[.*\]\}$', '"evidence":{}}')).when(k == 7, F.substring(json, F.lit(2), F.length(json))).otherwise(json)
    written = spread(table(spark, sf_dir, "orders").select("o_orderkey", json.alias("json")))
    return written.select("o_orderkey", F.array_join(results.triage_faults(F.col("json")), ";").alias("faults"))


@registry.add("""
WITH c AS (SELECT c_custkey, c_custkey % 9 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '$.logistics: unknown field "route";$.logistics.cargo: not a text' WHEN 1 THEN '$.procurement.brand_or_equivalent.equivalent_allowed: not a flag' WHEN 2 THEN '$.procurement.items[0].item_name: blank;$.procurement.items[0].evidence: too few'
  WHEN 3 THEN '$.procurement.lots[0].item_count: too small' WHEN 4 THEN '$.participation_barriers[0].severity: not one of the values' WHEN 5 THEN '$: needs logistics' WHEN 6 THEN '$: must not have procurement' WHEN 7 THEN '$.source_conflicts[0].sources: too few' ELSE '' END AS faults FROM c
""")
def deep_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all faults of deep results: logistics, brands, items, lots, barriers, conflicts, and blocks that the type asks for."""
    k = F.col("c_custkey") % 9
    null, name = F.lit("null"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    members = lambda fields: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items())), F.lit("}"))
    quote = members({"source_type": F.lit('"document"'), "field": F.lit('"text"'), "download_id": F.col("c_custkey").cast("string"), "member_name": F.lit('""'), "text": name})
    listed = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    brand = members({"specified_brand": null, "equivalent_allowed": F.when(k == 1, '"yes"').otherwise("true")})
    item = members({"item_name": F.when(k == 2, '" "').otherwise(name), "lot_number": null, "quantity": null, "unit": null, "key_specifications": F.lit('["m8"]'), "brand_or_equivalent": null, "evidence": F.when(k == 2, "[]").otherwise(listed(quote))})
    lot = members({"lot_number": F.lit('"1"'), "description": null, "item_count": F.when(k == 3, "-1").otherwise("3"), "evidence": F.lit("[]")})
    given = {n: null for n in results.PROCUREMENT.fields} | {"total_lots": F.lit("2"), "brand_or_equivalent": brand, "items": listed(item), "lots": listed(lot)}
    cargo = {n: null for n in results.LOGISTICS.fields} | {"cargo": F.when(k == 0, "7").otherwise(name)}
    logistics = F.when(k == 0, members(cargo | {"route": null})).when(k == 5, null).otherwise(members(cargo))
    barrier = members({"type": F.lit('"license"'), "description": name, "severity": F.when(k == 4, '"grave"').otherwise('"low"'), "evidence": listed(quote)})
    conflict = members({"sources": F.when(k == 7, "[]").otherwise('["document"]'), "conflict_description": name, "impact": name})
    json = members({
        "summary": name, "opportunity_type": F.when(k == 6, '"logistics"').otherwise('"logistics_and_procurement"'), "category": null, "why_interesting": name, "contracting_authority": null, "procedure_code": null, "confidence": F.lit('"low"'),
        "participation_barriers": listed(barrier), "missing_information": F.lit("[]"), "source_conflicts": listed(conflict), "manual_review_required": F.lit("false"), "evidence": listed(quote), "procurement": members(given), "logistics": logistics,
    })
    written = spread(table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")))  # written once, judged by many tasks
    return written.select("c_custkey", F.array_join(results.deep_faults(F.col("json")), ";").alias("faults"))


@registry.add("""
WITH p AS (SELECT p_partkey, p_partkey % 8 AS k FROM part)
SELECT p_partkey, '$.expected: needs a category' AS fault FROM p WHERE k = 1 UNION ALL SELECT p_partkey, '$.expected.opportunity_type: not one of the values' FROM p WHERE k = 2 UNION ALL SELECT p_partkey, '$.input_hash: bad form' FROM p WHERE k = 3
UNION ALL SELECT p_partkey, '$.expected: not an object' FROM p WHERE k = 4 UNION ALL SELECT p_partkey, '$.title: missing' FROM p WHERE k = 5 UNION ALL SELECT p_partkey, '$.resource_url: repeated' FROM p WHERE k = 6 AND p_partkey > (SELECT min(p_partkey) FROM p WHERE k = 6)
""")
def golden_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of a set of golden cases, those of single cases and repeated addresses."""
    k, key = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    kind = F.when(k == 1, "procurement").when(k == 2, "logistics").otherwise("unclear")
    expected = F.struct(F.lit("maybe").alias("relevance_status"), kind.alias("opportunity_type"), F.lit(None).cast("string").alias("category"), F.col("p_name").alias("expected_reason"), F.lit(None).cast("string").alias("notes"))
    case = F.struct(
        F.concat(F.lit("case-"), key).alias("case_id"), F.when(k == 6, "u").otherwise(F.concat(F.lit("u"), key)).alias("resource_url"), F.col("p_name").alias("title"), F.when(k == 3, "0").otherwise(F.sha2("p_name", 256)).alias("input_hash"), expected.alias("expected"),
    )
    json = F.to_json(case, {"ignoreNullFields": "false"})
    json = F.when(k == 4, F.regexp_replace(json, r'"expected":\{.*\}\}$', '"expected":[]}')).when(k == 5, F.replace(json, F.lit('"title"'), F.lit('"name"'))).otherwise(json)
    return results.golden_faults(spread(table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))), "p_partkey", "json")


@registry.add("""
WITH c AS (SELECT doc_id, quality, toxic, doc_id % 7 AS k FROM labels)
SELECT c.doc_id, CASE WHEN k = 0 THEN 'skipped' WHEN k = 1 OR k = 2 THEN 'error' ELSE 'scored' END AS status, CASE WHEN k > 0 THEN length(d.text) END AS input_size_chars, CASE WHEN k > 2 THEN 'p' || quality END AS prediction,
  CASE WHEN k > 1 THEN c.doc_id * 10 END::BIGINT AS input_tokens, CASE k WHEN 0 THEN 'stale_context: changed' WHEN 1 THEN 'unexpected_error: no answer' WHEN 2 THEN 'validation: bad block' END AS error
FROM c JOIN documents d USING (doc_id)
""")
def deep_case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of golden cases in a deep run: skipped, failed with what it cost, scored."""
    k = F.col("doc_id") % 7
    labels = table(spark, sf_dir, "labels")
    cases = labels.select("doc_id", F.when(k == 0, "stale_context").otherwise("ok").alias("preparation"), F.when(k == 0, "changed").alias("detail"))
    contexts = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.lit(1).alias("total_documents")).alias("document_coverage"), F.length("text").alias("input_size_chars"), F.lit(2).alias("evidence_units"))
    usage = F.struct((F.col("doc_id") * 10).alias("input_tokens"))
    answers = labels.where("doc_id % 7 <> 1").select(
        "doc_id", F.concat(F.lit("p"), F.col("quality").cast("string")).alias("prediction"), F.lit("{}").alias("raw_output"), usage.alias("usage"), F.lit("r").alias("response_id"), F.lit(1).alias("attempts"),
        F.when(k == 2, "validation").alias("error_kind"), F.when(k == 2, "bad block").alias("error_message"),
    )
    found = responses.deep_records(cases, contexts, answers, "doc_id")
    return found.select("doc_id", "status", "input_size_chars", "prediction", F.col("usage.input_tokens").alias("input_tokens"), F.concat("error.kind", F.lit(": "), "error.message").alias("error"))


@registry.add("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE '{"estimated_value":' || l_quantity::BIGINT || ',"value_source":"official","source_refs":["s"],"total_lots":' || l_linenumber || ',"notes":[]}' END AS facts,
  '{"deep_analysis_status":"deferred","reason":"' || l_shipdate::DATE || '","reason_code":"budget"' || CASE WHEN l_linenumber % 2 = 0 THEN ',"preflight":{"tokens":' || l_partkey || '}' ELSE '' END || '}' AS admission FROM lineitem
""")
def decision_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of facts and admissions with a decision."""
    i = F.col("l_linenumber")
    facts = F.struct(
        F.col("l_quantity").cast("long").alias("estimated_value"), F.lit("official").alias("value_source"), F.array(F.lit("s")).alias("source_refs"), i.alias("total_lots"), F.lit(None).cast("long").alias("total_quantity"),
        F.array().cast("array<string>").alias("notes"), F.lit("left out").alias("lines"),
    )
    admission = F.struct(F.lit("deferred").alias("deep_analysis_status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("reason"), F.lit("budget").alias("reason_code"), F.lit(True).alias("left_out"))
    preflight = F.when(i % 2 == 0, F.struct(F.col("l_partkey").alias("tokens")))
    told = rules.admission_details(admission, preflight, F.lit(None).cast("struct<left:bigint>"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(rules.subset(F.when(i % 3 != 0, facts), rules.FACTS)).alias("facts"), told.alias("admission"))
