"""Candidate selection, upserts, unions and windows on the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import candidates, upsert
from dossier.queries.base import Registry, table

registry = Registry()


def _attempts(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"))


@registry.add("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@registry.add("""
SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS priority
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1
""")
def priority_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return candidates.by_priority(table(spark, sf_dir, "documents").select("doc_id", "source"), labels.select("doc_id"), _attempts(labels), "doc_id")


@registry.add("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS priority
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1
ORDER BY priority, d.doc_id LIMIT 100
""")
def priority_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred: the limit is the feature."""
    labels = table(spark, sf_dir, "labels")
    rows = candidates.by_priority(table(spark, sf_dir, "documents").select("doc_id"), labels.select("doc_id"), _attempts(labels), "doc_id")
    return rows.orderBy("priority", "doc_id").limit(100)


@registry.add("""
WITH state AS (SELECT conv_id AS doc_id, CASE WHEN max(turn) >= 5 THEN 'failed' ELSE 'success' END AS status FROM conversations GROUP BY conv_id)
SELECT d.doc_id, CASE WHEN s.status IS NULL THEN 0 ELSE 1 END AS priority
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN state s ON s.doc_id = d.doc_id
WHERE (s.status IS NULL OR s.status = 'failed') AND l.toxic <> 1
""")
def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    state = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.when(F.max("turn") >= 5, "failed").otherwise("success").alias("status"))
    return candidates.document_candidates(table(spark, sf_dir, "documents").select("doc_id"), labels, state, _attempts(labels), "doc_id")


@registry.add("""
SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_lots, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS n_returned
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = {"n_lots": F.lit(True), "n_returned": F.col("l_returnflag") == "R"}
    return candidates.child_counts(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", counted)


@registry.add("""
SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS lots
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nested_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = candidates.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), lots, "o_orderkey", F.col("l_partkey"), F.struct("l_linenumber", "l_partkey"), "parts")
    return nested.select("o_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("lots"))


@registry.add("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey
""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return candidates.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@registry.add("""
WITH now AS (SELECT doc_id, sha256(text) AS h FROM documents),
kept AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN n.h ELSE 'other' END AS h FROM labels l JOIN now n ON n.doc_id = l.doc_id)
SELECT n.doc_id, CASE WHEN k.h IS NULL THEN 'missing' ELSE 'stale' END AS reason
FROM now n LEFT JOIN kept k ON k.doc_id = n.doc_id WHERE n.h IS DISTINCT FROM k.h
""")
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("input_hash"))
    kept = table(spark, sf_dir, "labels").select("doc_id", "quality").join(now, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("input_hash")).otherwise("other").alias("input_hash"))
    return candidates.stale(now, kept, "doc_id")


@registry.add("""
WITH triage AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'not_relevant' WHEN quality = 1 THEN 'relevant' ELSE 'maybe' END AS relevance FROM labels),
deep AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT t.doc_id, t.relevance FROM triage t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN deep p ON p.doc_id = t.doc_id
WHERE t.relevance IN ('relevant', 'maybe') AND (p.n IS NULL OR p.n <> 4)
""")
def deep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant or unclear rows whose deep result is missing or of another version."""
    relevance = F.when(F.col("toxic") == 1, "not_relevant").when(F.col("quality") == 1, "relevant").otherwise("maybe")
    triage = table(spark, sf_dir, "labels").select("doc_id", relevance.alias("relevance")).where(F.col("relevance").isin("relevant", "maybe"))
    now = table(spark, sf_dir, "documents").select("doc_id", F.lit(4).cast("long").alias("input_hash"))
    deep = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("input_hash"))
    return triage.join(candidates.stale(now, deep, "doc_id"), "doc_id").select("doc_id", "relevance")


@registry.add("""
WITH parts AS (
  SELECT 0 AS part, page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 1, page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) FROM pages)
SELECT arg_min(page_id, (part, page_id)) AS page_id, host, arg_min(part, (part, page_id))::INTEGER AS part FROM parts WHERE trim(host) <> '' GROUP BY host
UNION ALL SELECT page_id, host, part::INTEGER FROM parts WHERE trim(host) = ''
""")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"))
    return candidates.first_wins([pages.where("page_id % 2 = 0"), pages], "host", ["page_id"])


@registry.add("""
SELECT DISTINCT u.doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 2000) u
WHERE u.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def union_minus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    parts = [labels.where("quality = 1").select("doc_id"), table(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id")]
    return candidates.union_minus(parts, labels.where("toxic = 1").select("doc_id"), "doc_id")


@registry.add("""
WITH ranked AS (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn,
         min(doc_id) OVER (PARTITION BY source, lang) AS first_id FROM documents)
SELECT doc_id, source, lang FROM ranked ORDER BY turn, first_id LIMIT 50
""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    return candidates.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], 50)


@registry.add("SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type")
def first_of_each_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return candidates.first_of_each(events, "event_type", ["event_id"], ["click", "view", "error"])


@registry.add("""
(SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100)
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
""")
def limited_with_exempt_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled orders stay outside the limit, which is the feature."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return candidates.limited_with_exempt(orders, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], 100).drop("o_orderdate")


@registry.add("SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*)::BIGINT AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash")), "text_hash")


@registry.add("""
SELECT sha256(text) AS text_hash, doc_id, first_position FROM (
  SELECT text, doc_id, min(doc_id) OVER (PARTITION BY text) AS first_position FROM documents) WHERE doc_id > first_position
""")
def repeated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.repeated_at(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id"), "text_hash", "doc_id")


@registry.add("""
SELECT event_id, user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL AS starts_header
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def source_change_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return candidates.changed_headers(events, ["user_id"], ["ts", "event_id"], ["event_type"]).drop("ts")


@registry.add("""
SELECT l_orderkey, count(l_linenumber)::BIGINT AS n,
       min(l_linenumber) = 1 AND max(l_linenumber) = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber) AS is_contiguous
FROM lineitem GROUP BY l_orderkey
""")
def contiguous_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.contiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored snapshot of the labelled documents, some of them in an older form, and the documents of today."""
    today = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    old = today.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "elsewhere").otherwise(F.col("source")).alias("source"), F.when(F.col("toxic") == 1, None).otherwise(F.col("lang")).alias("lang"), "n_chars")
    return old, today


SNAPSHOTS = """
WITH today AS (SELECT doc_id, source, lang, n_chars FROM documents),
old AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'elsewhere' ELSE source END AS source, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS lang, n_chars
        FROM documents JOIN labels USING (doc_id))
"""


@registry.add(SNAPSHOTS + """
SELECT t.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new'
  WHEN t.source IS NOT DISTINCT FROM o.source AND t.lang IS NOT DISTINCT FROM o.lang AND t.n_chars IS NOT DISTINCT FROM o.n_chars THEN 'existing' ELSE 'updated' END AS status,
  CASE WHEN o.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN t.source IS DISTINCT FROM o.source THEN 'source' END, CASE WHEN t.lang IS DISTINCT FROM o.lang THEN 'lang' END) END AS changed
FROM today t LEFT JOIN old o ON o.doc_id = t.doc_id
""")
def upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, today = _snapshots(spark, sf_dir)
    return upsert.upsert_status(old, today, ["doc_id"], ["source", "lang", "n_chars"]).withColumn("changed", F.array_join("changed", ","))


@registry.add(SNAPSHOTS + """
SELECT coalesce(t.doc_id, o.doc_id) AS doc_id, coalesce(t.source, CASE WHEN t.doc_id IS NULL THEN o.source END) AS source,
       CASE WHEN o.doc_id IS NULL THEN 200 ELSE 100 END AS first_seen_at,
       CASE WHEN t.doc_id IS NOT NULL AND (o.doc_id IS NULL OR t.source IS DISTINCT FROM o.source OR t.lang IS DISTINCT FROM o.lang) THEN 200 ELSE 100 END AS last_seen_at
FROM (SELECT * FROM today WHERE doc_id % 3 <> 0) t FULL JOIN old o ON o.doc_id = t.doc_id
""")
def upserted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot when two thirds of today's rows arrive."""
    old, today = _snapshots(spark, sf_dir)
    stamped = old.withColumns({"first_seen_at": F.lit(100), "last_seen_at": F.lit(100)})
    return upsert.upserted(stamped, today.where("doc_id % 3 <> 0"), ["doc_id"], ["source", "lang", "n_chars"], F.lit(200)).drop("lang", "n_chars")


@registry.add(SNAPSHOTS + """
SELECT status, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN t.doc_id IS NULL THEN 'deleted' WHEN o.doc_id IS NULL THEN 'new'
    WHEN t.source IS NOT DISTINCT FROM o.source AND t.lang IS NOT DISTINCT FROM o.lang THEN 'existing' ELSE 'updated' END AS status
  FROM (SELECT * FROM today WHERE doc_id % 3 <> 0) t FULL JOIN old o ON o.doc_id = t.doc_id) GROUP BY status
""")
def snapshot_replace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an authoritative snapshot, which deletes what it doesn't name."""
    old, today = _snapshots(spark, sf_dir)
    return upsert.status_counts(upsert.upsert_status(old, today.where("doc_id % 3 <> 0"), ["doc_id"], ["source", "lang", "n_chars"], replace=True))


@registry.add("""
SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN prev IS NULL THEN 'new' WHEN prev = event_type THEN 'existing' ELSE 'updated' END AS status FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events WHERE event_type <> 'error'
  UNION ALL SELECT *, NULL FROM events WHERE event_type = 'error')
""")
def batch_upsert_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in order, each row against its key's row before; rows without a type fail."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return upsert.batch_status(events.limit(0), events, ["user_id"], ["event_type"], "event_id", ["event_type"])


@registry.add("SELECT min(event_id) AS event_id, user_id, props FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id, props")
def versioned_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content versions that are not stored; the first row of each stands for it."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))
    stored = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return upsert.insert_missing(stored.join(events, "user_id").select("user_id", "props"), events, ["user_id", "props"]).select("event_id", "user_id", "props")


@registry.add("""
WITH d AS (SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*)::BIGINT AS attempt_count FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(attempt_count, 0) + 1 AS attempt_count FROM customer LEFT JOIN d ON d.user_id = c_custkey
WHERE last_type IS NULL OR last_type <> 'purchase'
""")
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is to be tried again: what was delivered stays so."""
    last = F.max_by("event_type", "event_id")
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(last == "purchase", "sent").otherwise("failed").alias("status"), F.count(F.lit(1)).alias("attempt_count"))
    return upsert.begun_attempts(state, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@registry.add("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def status_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@registry.add("SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.from_json("props", "k long")["k"].alias("k"))
    return events.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
