"""The ledger's sums and prices, with events as metered calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import money, rules
from dossier.operators import ledger
from dossier.queries.base import Registry, table

registry = Registry()
CENTS = "decimal(38,2)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", F.col("ts").alias("created_at"), F.col("value").cast("decimal(18,2)").alias("cost"), F.from_json("props", "k long")["k"].alias("k"))


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast(CENTS) for n in names})


@registry.add("SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*)::BIGINT AS events, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS cost FROM events GROUP BY 1")
def monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(ledger.monthly(_calls(spark, sf_dir), {"cost": F.col("cost")}), "cost")


@registry.add("SELECT date_trunc('month', ts)::TIMESTAMP AS month, event_type, count(*)::BIGINT AS events, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS cost, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def monthly_cost_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(ledger.monthly(_calls(spark, sf_dir), {"cost": F.col("cost"), "tokens": F.col("k")}, ["event_type"]), "cost")


@registry.add("SELECT user_id, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS cost FROM events GROUP BY 1")
def cost_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(_calls(spark, sf_dir).groupBy("user_id").agg(F.sum("cost").alias("cost")), "cost")


@registry.add("""
WITH spent AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, sum(value::DECIMAL(18,2)) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1),
held AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, sum(value::DECIMAL(18,2)) AS x FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT coalesce(s.month, h.month) AS month, coalesce(s.x, 0)::DECIMAL(38,2) AS spent, coalesce(h.x, 0)::DECIMAL(38,2) AS reserved, (coalesce(s.x, 0) + coalesce(h.x, 0))::DECIMAL(38,2) AS committed
FROM spent s FULL JOIN held h ON h.month = s.month
""")
def committed_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    status = F.when(F.col("event_type") == "click", "reserved").when(F.col("event_type") == "error", "unresolved").otherwise("settled")
    return _money(ledger.committed(calls.where("event_type = 'purchase'"), calls.withColumn("status", status)), "spent", "reserved", "committed")


@registry.add("""
SELECT user_id, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS cost FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_id > (SELECT coalesce(max(event_id), 0) FROM events WHERE event_id % 1000 = 0 AND ts < TIMESTAMP '2024-01-06') GROUP BY 1
""")
def cost_after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a period cost after a high-water mark; the mark is a scalar subquery."""
    calls = _calls(spark, sf_dir)
    mark = ledger.high_water(calls.where("event_id % 1000 = 0 AND created_at < TIMESTAMP '2024-01-06'")).scalar()
    period = ledger.in_month(calls, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).where(F.col("event_id") > mark)
    return _money(period.groupBy("user_id").agg(F.sum("cost").alias("cost")), "cost")


@registry.add("SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY user_id")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose response is not in the ledger yet."""
    calls = _calls(spark, sf_dir)
    firsts = calls.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return ledger.appended(calls.where("event_type = 'error' AND cost > 60"), firsts, "user_id").select("event_id", "user_id")


TOKENS = "l_partkey * 200 AS tokens, l_suppkey * 10 AS cached, l_linenumber * 100 AS written, l_quantity::BIGINT * 10 AS output, CASE WHEN l_returnflag = 'A' THEN 'model_a' WHEN l_returnflag = 'N' THEN 'model_b' ELSE 'unpriced' END AS model"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "A", "model_a").when(F.col("l_returnflag") == "N", "model_b").otherwise("unpriced")
    tokens = (F.col("l_partkey") * 200, F.col("l_suppkey") * 10, F.col("l_linenumber").cast("long") * 100, F.col("l_quantity").cast("long") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(n) for c, n in zip(tokens, ("tokens", "cached", "written", "output"), strict=True)), model.alias("model"))


@registry.add(f"""
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, {TOKENS} FROM lineitem),
price AS (SELECT * FROM (VALUES ('model_a', false, 0.20, 0.02, 0.25, 1.20), ('model_a', true, 0.40, 0.04, 0.50, 1.80), ('model_b', false, 2.00, 0.20, 2.50, 12.00), ('model_b', true, 4.00, 0.40, 5.00, 18.00)) p(model, long, i, c, w, o))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN tokens - cached - written >= 0 THEN
  (((tokens - cached - written)::DECIMAL(18,0) * i + cached::DECIMAL(18,0) * c + written::DECIMAL(18,0) * w + output::DECIMAL(18,0) * o)::DECIMAL(30,2) * 0.000001)::DECIMAL(38,12)::VARCHAR END AS cost
FROM u LEFT JOIN price p ON p.model = u.model AND p.long = (tokens > 272000)
""")
def tiered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact USD of each call, by model and tier."""
    cost = money.cost(*(F.col(c) for c in ("model", "tokens", "cached", "written", "output")))
    return _usage(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", cost.cast("string").alias("cost"))


@registry.add(f"""
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, {TOKENS} FROM lineitem),
price AS (SELECT * FROM (VALUES ('model_a', false, 0.25, 1.20), ('model_a', true, 0.50, 1.80), ('model_b', false, 2.50, 12.00), ('model_b', true, 5.00, 18.00)) p(model, long, i, o))
SELECT l_orderkey, l_linenumber, l_partkey, ((tokens::DECIMAL(18,0) * i + 8000 * o)::DECIMAL(30,2) * 0.000001)::DECIMAL(38,12)::VARCHAR AS cost
FROM u LEFT JOIN price p ON p.model = u.model AND p.long = (tokens > 272000)
""")
def conservative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = money.conservative_cost(F.col("model"), F.col("tokens"), F.lit(8000))
    return _usage(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", cost.cast("string").alias("cost"))


@registry.add("SELECT doc_id, (ceil(length(text) / 2.4::DECIMAL(4,1)) + 300)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", money.request_tokens(F.length("text")).alias("tokens"))


GUARD = """
WITH c AS (SELECT o_orderkey, (o_custkey % 20)::DECIMAL(10,2) AS spend, (o_totalprice / 100000)::DECIMAL(10,2) AS estimate, o_orderstatus = 'F' AS deep FROM orders),
g AS (SELECT *, CASE WHEN 15 - spend <= 0 THEN 'blocked_hard_limit' WHEN deep AND estimate > 0.75 THEN 'blocked_single_call_limit'
  WHEN estimate > 15 - spend THEN 'insufficient_budget_remaining' WHEN spend >= 12 THEN 'soft_limit_mode' ELSE 'allowed' END AS decision FROM c)
"""


@registry.add(GUARD + "SELECT o_orderkey, decision, decision = 'allowed' OR (decision = 'soft_limit_mode' AND NOT deep) AS allowed FROM g")
def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _guarded(spark, sf_dir)
    return calls.select("o_orderkey", "g.decision", "g.allowed")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 20).cast("decimal(10,2)").alias("spend"), (F.col("o_totalprice") / 100000).cast("decimal(10,2)").alias("estimate"), (F.col("o_orderstatus") == "F").alias("deep"))
    return calls.withColumn("g", rules.budget_guard(F.col("spend"), F.col("estimate"), F.col("deep"), F.lit(15), F.lit(12), F.expr("0.75BD")))


@registry.add(GUARD + """
, a AS (SELECT g.*, CASE WHEN o.o_totalprice < 50000 THEN 'skip_low_value' ELSE 'deep_candidate' END AS gate, (o.o_totalprice)::BIGINT AS tokens, o.o_custkey % 7 <> 0 AS priced FROM g JOIN orders o ON o.o_orderkey = g.o_orderkey)
SELECT CASE WHEN gate <> 'deep_candidate' THEN 'gate_skip' WHEN NOT priced THEN 'pricing_unknown' WHEN tokens > 140000 THEN 'deferred_input_too_large'
  WHEN NOT (decision = 'allowed' OR (decision = 'soft_limit_mode' AND NOT deep)) THEN 'budget_deferred' ELSE 'admitted' END AS admission, count(*)::BIGINT AS n FROM a GROUP BY 1
""")
def admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _guarded(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    gate = rules.commercial_gate(F.lit(False), F.col("o_totalprice"), F.lit(50000), F.lit(1))
    admission = rules.deep_admission(gate, F.col("o_custkey") % 7 != 0, F.round("o_totalprice").cast("long"), F.lit(140_000), F.col("g.allowed"))
    return calls.select(admission.alias("admission")).groupBy("admission").agg(F.count(F.lit(1)).alias("n"))


@registry.add("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%')::BIGINT AS urgent FROM orders GROUP BY 1)
SELECT month, n AS triage_calls, ceil(n * 0.1::DECIMAL(4,2) * 0.5::DECIMAL(4,2))::BIGINT AS deep_calls, (n * 0.00118::DECIMAL(10,7))::DECIMAL(20,7)::VARCHAR AS triage_cost,
  (ceil(n * 0.1::DECIMAL(4,2) * 0.5::DECIMAL(4,2))::BIGINT * 0.0203146::DECIMAL(10,7))::DECIMAL(20,7)::VARCHAR AS deep_cost FROM m
""")
def projected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and USD of each month at given rates of relevance and admission."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("triage_calls"))
    deep = months.withColumn("deep_calls", money.ceil_product(F.col("triage_calls"), F.expr("0.1BD"), F.expr("0.5BD")))
    price = lambda calls, unit: (F.col(calls).cast("decimal(12,0)") * F.expr(f"{unit}BD")).cast("decimal(20,7)").cast("string")
    return deep.select("month", "triage_calls", "deep_calls", price("triage_calls", "0.0011800").alias("triage_cost"), price("deep_calls", "0.0203146").alias("deep_cost"))
