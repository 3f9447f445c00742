"""Incremental runs and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import cards
from dossier.queries.base import Registry, table
from dossier.streaming import incremental

registry = Registry()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return incremental.file_stream(spark, f"{sf_dir}/events.parquet*", schema).select("user_id", "event_id", "event_type", "props")


@registry.add("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(max(event_id)) OVER () AS last_seen_at FROM events GROUP BY user_id")
def incremental_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after a stream of the events, last type by user."""
    snapshot = incremental.snapshot_stream(_events(spark, sf_dir), ["user_id"], ["event_type"], "event_id")
    return snapshot.select("user_id", "event_type", "last_seen_at")


@registry.add("""
SELECT CASE WHEN prev IS NULL THEN 'new' WHEN prev = event_type THEN 'existing' ELSE 'updated' END AS status, count(*)::BIGINT AS n
FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY 1
""")
def incremental_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, statuses = incremental.upsert_stream(_events(spark, sf_dir), ["user_id"], ["event_type"], "event_id")
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registry.add("SELECT DISTINCT user_id, props FROM events")
def once_only_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of each reference once, over a stream with repeats."""
    return incremental.once_only(_events(spark, sf_dir).select("user_id", "props"), ["user_id", "props"])


@registry.add("""
WITH s AS (SELECT doc_id, quality, toxic FROM labels)
SELECT s.doc_id, CASE WHEN d.n IS NULL THEN 'incomplete' WHEN d.n % 2 <> s.quality THEN 'stale' WHEN s.doc_id % 5 = 0 THEN 'already_sent' WHEN t.n_chars % 3 = 0 THEN 'stale' WHEN s.toxic = 1 THEN 'expired' ELSE 'eligible' END AS delivery
FROM s JOIN documents t USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) d USING (doc_id)
""")
def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    deep = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.count(F.lit(1)) % 2).alias("input_hash"), F.lit("said").alias("summary"))
    states = labels.select("doc_id", F.col("quality").cast("long").alias("input_hash"), (F.col("toxic") == 1).alias("expired"))
    sent = labels.where("doc_id % 5 = 0").select("doc_id", F.explode(F.expr("array(0L, 1L)")).alias("input_hash"), F.lit("sent").alias("status"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    now = docs.join(deep, "doc_id").select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.lit(9)).otherwise(F.col("input_hash")).alias("input_hash"))
    return cards.deliverable(states, deep, sent, now, "doc_id")


@registry.add("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, 'part ' || l_partkey || ' — ' || l_quantity::BIGINT || ' pcs' AS line FROM lineitem),
n AS (SELECT l_orderkey, list(line ORDER BY l_linenumber, l_partkey, line) AS lines FROM i GROUP BY 1)
SELECT l_orderkey, 'Order ' || l_orderkey || chr(10) || array_to_string(list_transform(lines[1:5], lambda x: '• ' || x), chr(10)) || CASE WHEN len(lines) > 5 THEN chr(10) || '… 5 / ' || len(lines) ELSE '' END AS card FROM n
""")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = cards.item_line(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("long"), F.lit("pcs"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("i"))
    title = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    return items.select("l_orderkey", cards.card(title, F.transform("i", lambda x: x["line"])).alias("card"))
