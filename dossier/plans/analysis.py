"""An analysis batch: which announcements need it is one set-wise plan; the few that the batch takes go one by one to an injected analyzer.

A call is paid for at most once: it is reserved before and settled after, and while
a reservation is open no other call is made.  With a journal the reservation is stored
before the call goes out, whatever becomes of the driver; without one the batch's rows
are for the caller to append.  Triage and deep analysis are two legs of one batch and one
budget: deep calls are for announcements whose triage is current and relevant and which
the commercial gate lets through, as next_steps tells, and from the soft limit on, or
above the limit of one call, they are put off while triage goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions import rules
from dossier.journal import Journal, ReservationBlocked
from dossier.operators import candidates, ledger
from dossier.store import table_or_empty

#: Takes a row as a dictionary, returns result (a dictionary), usage (tokens) and response_id.
Analyzer = Callable[[dict], dict]
UNBILLED = frozenset(("config", "authentication", "rate_limit"))


class AnalyzerError(Exception):
    def __init__(self, kind: str, usage: dict | None = None) -> None:
        super().__init__(kind)
        self.kind, self.usage = kind, usage


@dataclass
class Batch:
    """What a batch did; rows to be appended to the tables."""

    outcomes: list[dict] = field(default_factory=list)
    ledger: list[dict] = field(default_factory=list)
    reservations: list[dict] = field(default_factory=list)
    blocked: bool = False
    spent: Decimal = Decimal(0)


def selected(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with a reason: up to limit ones that cost, fresh before retried, in order of first_seen_at and resource_url; expired ones are outside the limit."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit is a positive whole number")
    waiting = rows.where(F.col("reason").isNotNull())
    retried = F.col("reason").startswith("retry_")
    return candidates.limited_with_exempt(waiting, F.col("reason") == "skip_expired", [retried, F.col("first_seen_at"), F.col("resource_url")], limit)


def next_steps(rows: DataFrame, triage: DataFrame, deep: DataFrame, key: str, facts: dict[str, Column]) -> DataFrame:
    """rows (key, input_hash) with step: what each needs next, with stored results of the same content taken over; facts has eligibility, gate and admission."""
    same = rows.join(triage.select(key, F.col("input_hash").alias("_triage"), "relevance_status"), key, "left").join(deep.select(key, F.col("input_hash").alias("_deep")), key, "left")
    current = lambda c: F.coalesce(F.col(c) == F.col("input_hash"), F.lit(False))
    step = rules.next_step({"triage_current": current("_triage"), "not_relevant": F.coalesce(F.col("relevance_status") == "not_relevant", F.lit(False)), "deep_current": current("_deep")} | facts)
    return same.withColumn("step", step).drop("_triage", "_deep", "relevance_status")


@dataclass
class Limits:
    """A month's budget; soft and call_cap are for deep calls alone."""

    budget: Decimal
    soft: Decimal | None = None
    call_cap: Decimal | None = None


class _Kept:
    """Reservations and usage as rows of the batch."""

    def __init__(self, batch: Batch, price: Callable[[dict], Decimal]) -> None:
        self.batch, self.price = batch, price

    def reserve(self, leg: str, key: dict, expected: Decimal) -> dict:
        self.batch.reservations.append(reservation := key | {"status": "reserved", "cost": expected})
        return reservation

    def settle(self, reservation: dict, usage: dict, response_id: str | None, success: bool) -> Decimal:
        return _settle(self.batch, reservation, usage, response_id, self.price)

    def release(self, reservation: dict, note: str) -> None:
        reservation["status"] = "released"

    def unresolved(self, reservation: dict, note: str) -> None:
        reservation["status"] = "unresolved"


class _Stored:
    """Reservations and usage as entries of a journal; usage that it doesn't take opens a block."""

    def __init__(self, batch: Batch, journal: Journal) -> None:
        self.batch, self.journal = batch, journal

    def reserve(self, leg: str, key: dict, expected: Decimal) -> int:
        number = self.journal.reserve(leg, key["resource_url"], expected, input_hash=key["input_hash"])
        self.batch.reservations.append(key | {"status": "stored", "cost": expected, "reservation": number})
        return number

    def settle(self, reservation: int, usage: dict, response_id: str | None, success: bool) -> Decimal:
        try:
            return self.journal.settle(reservation, usage, response_id, success=success) or Decimal(0)
        except Exception as e:  # the answer is paid for, so that its usage must not be lost
            self.batch.blocked = True
            self.journal.open_block(usage, f"{type(e).__name__}: {e}", reservation, response_id)
            return Decimal(0)

    def release(self, reservation: int, note: str) -> None:
        self.journal.release(reservation, note)

    def unresolved(self, reservation: int, note: str) -> None:
        self.journal.unresolved(reservation, note)


def run_batch(rows: DataFrame, analyzer: Analyzer, price: Callable[[dict], Decimal], *, limit: int, budget: Decimal, spent: Decimal, estimate: Callable[[dict], Decimal], open_reservations: int = 0, leg: str = "triage", journal: Journal | None = None, soft: Decimal | None = None, call_cap: Decimal | None = None) -> Batch:
    """Analyzes the selected rows on the driver; their number is bounded by limit, as each is a paid call."""
    batch = Batch(blocked=open_reservations > 0)
    paid = selected(rows, limit).where(F.col("reason") != "skip_expired").limit(limit)
    kept = _Stored(batch, journal) if journal else _Kept(batch, price)
    batch.spent = _calls(batch, [r.asDict(recursive=True) for r in paid.collect()], analyzer, kept, Limits(budget, soft, call_cap), spent, estimate, leg)
    return batch


def _calls(batch: Batch, rows: list[dict], analyzer: Analyzer, kept: _Kept | _Stored, limits: Limits, spent: Decimal, estimate: Callable[[dict], Decimal], leg: str) -> Decimal:
    """Calls for the rows of one leg, one by one; what is spent after them."""
    for row in rows:
        key = {"resource_url": row["resource_url"], "input_hash": row["input_hash"]}
        if batch.blocked:
            batch.outcomes.append(key | {"state": None, "reason_code": "accounting_blocked"})
            continue
        expected = estimate(row)
        decision, allowed = rules.guarded(spent, expected, leg == "deep", limits.budget, limits.soft, limits.call_cap)
        if not allowed:
            batch.outcomes.append(key | {"state": f"{leg}_deferred_budget", "reason_code": "budget_deferred", "decision": decision})
            continue
        try:
            reservation = kept.reserve(leg, key, expected)
        except ReservationBlocked:
            batch.blocked = True
            batch.outcomes.append(key | {"state": None, "reason_code": "accounting_blocked"})
            continue
        try:
            answer = analyzer(row)
        except AnalyzerError as e:
            if e.usage is not None:
                spent += kept.settle(reservation, e.usage, None, False)
            elif e.kind in UNBILLED:
                kept.release(reservation, e.kind)
            else:
                kept.unresolved(reservation, e.kind)
                batch.blocked = True
            batch.outcomes.append(key | {"state": f"{leg}_error", "reason_code": e.kind})
            continue
        except Exception as e:  # an analyzer's failure is its row's; whether it cost is unknown
            kept.unresolved(reservation, f"{type(e).__name__}: {e}")
            batch.blocked = True
            batch.outcomes.append(key | {"state": f"{leg}_error", "reason_code": f"unexpected_error: {type(e).__name__}"})
            continue
        spent += kept.settle(reservation, answer["usage"], answer.get("response_id"), True)
        batch.outcomes.append(key | {"state": f"{leg}_completed", "reason_code": answer["result"].get("relevance_status"), "result": answer["result"]})
    return spent


def process(steps: DataFrame, analyzers: dict[str, Analyzer], price: Callable[[dict], Decimal], *, limit: int, budget: Decimal, spent: Decimal, estimate: Callable[[dict], Decimal], open_reservations: int = 0, journal: Journal | None = None, soft: Decimal | None = None, call_cap: Decimal | None = None) -> Batch:
    """Both legs of rows with step (see next_steps): up to limit calls, triage first, by first_seen_at and resource_url; the other rows' states are outcomes without a call."""
    batch = Batch(blocked=open_reservations > 0)
    costly = steps.where(F.col("step").isin("call_triage", "call_deep")).orderBy(F.col("step") == "call_deep", "first_seen_at", "resource_url").limit(limit)
    rows = [r.asDict(recursive=True) for r in costly.collect()]
    kept = _Stored(batch, journal) if journal else _Kept(batch, price)
    for leg in ("triage", "deep"):
        spent = _calls(batch, [r for r in rows if r["step"] == f"call_{leg}"], analyzers[leg], kept, Limits(budget, soft, call_cap), spent, estimate, leg)
    batch.spent = spent
    return batch


def quiet_states(steps: DataFrame) -> DataFrame:
    """resource_url, state and reason_code of the rows that take no call."""
    step = F.col("step")
    states = {"skip_expired": "skipped_expired", "stop_not_relevant": "stopped_not_relevant", "reuse_deep": "deep_completed"}
    state = F.when(step.startswith("gate:"), "commercial_gate_skip").when(step == "deferred:deferred_input_too_large", "deep_deferred_input").when(step.startswith("deferred:"), "deep_deferred_budget")
    for name, value in states.items():
        state = F.when(step == name, value).otherwise(state)
    return steps.where(~step.isin("call_triage", "call_deep")).select("resource_url", state.alias("state"), F.nullif(F.regexp_extract(step, ":(.*)$", 1), F.lit("")).alias("reason_code"))


def record(spark: SparkSession, batch: Batch, base: str, schemas: dict[str, StructType]) -> None:
    """Appends a batch to the stored tables ledger and reservations in base; a response that the ledger has, from whatever batch, is not written again."""
    rows = spark.createDataFrame(batch.ledger, schemas["ledger"])
    ledger.appended(table_or_empty(spark, f"{base}/ledger", schemas["ledger"]), rows).write.mode("append").parquet(f"{base}/ledger")
    spark.createDataFrame(batch.reservations, schemas["reservations"]).write.mode("append").parquet(f"{base}/reservations")


def outstanding(spark: SparkSession, base: str, schema: StructType) -> int:
    """The stored reservations that no later row of theirs has settled or released."""
    rows = table_or_empty(spark, f"{base}/reservations", schema)
    last = rows.groupBy("resource_url", "input_hash").agg(F.count_if(F.col("status").isin(*ledger.OUTSTANDING)).alias("open"), F.count_if(~F.col("status").isin(*ledger.OUTSTANDING)).alias("closed"))
    return last.where("open > closed").count()


def _settle(batch: Batch, reservation: dict, usage: dict, response_id: str | None, price: Callable[[dict], Decimal]) -> Decimal:
    reservation["status"] = "settled"
    if response_id is not None and any(x["response_id"] == response_id for x in batch.ledger):
        return Decimal(0)
    cost = price(usage)
    batch.ledger.append({"resource_url": reservation["resource_url"], "input_hash": reservation["input_hash"], "response_id": response_id, "cost": cost} | usage)
    return cost


def summary(outcomes: DataFrame) -> DataFrame:
    """Outcomes by state: state, n, failed."""
    failed = F.col("state").isin("triage_error", "deep_error", "escalation_candidate") | (F.col("reason_code") == "accounting_blocked")
    return outcomes.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))
