"""Reservations that are stored before a call, whoever asks and whatever becomes of the driver."""

import subprocess
import sys
import textwrap
import threading
from datetime import UTC, datetime
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.journal import Journal, ReservationBlocked, create_exclusive
from dossier.operators import accounts
from dossier.plans import analysis

USAGE = {"input_tokens": 100, "output_tokens": 10}


def price(usage):
    return Decimal(usage.get("input_tokens") or 0) / 100


def statuses(journal):
    return {r.reservation: (r.status, r.cost) for r in accounts.journal_reservations(journal.entries()).collect()}


def test_one_of_many_creates(spark, tmp_path):
    made = []
    for k in range(5):
        threads = [threading.Thread(target=lambda i=i, k=k: made.append((k, i, create_exclusive(spark, f"{tmp_path}/{k}.json", str(i))))) for i in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        (winner,) = [i for n, i, ok in made if n == k and ok]
        assert (tmp_path / f"{k}.json").read_text() == str(winner)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == [f"{k}.json" for k in range(5)]


def test_two_drivers(spark, tmp_path):
    """Of two that reserve at the same time exactly one is granted, each time."""
    drivers = [Journal(spark, str(tmp_path), price) for _ in range(2)]
    for n in range(3):
        granted, blocked = [], []
        start = threading.Barrier(2)

        def ask(journal, granted=granted, blocked=blocked, start=start):
            start.wait()
            try:
                granted.append(journal.reserve("triage", "u", Decimal(1)))
            except ReservationBlocked as e:
                blocked.append(str(e))

        threads = [threading.Thread(target=ask, args=(d,)) for d in drivers]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(granted) == 1 and blocked == ["outstanding_reservations"]
        drivers[n % 2].settle(granted[0], USAGE, f"r{n}")
    assert drivers[0].spent() == 3
    assert [s for s, _ in statuses(drivers[1]).values()] == ["settled"] * 3


def test_states(spark, tmp_path):
    journal = Journal(spark, str(tmp_path), price)
    first = journal.reserve("triage", "u1", Decimal(2))
    assert journal.spent() == 2  # the estimate counts while it is outstanding
    assert journal.settle(first, USAGE, "r1") == 1 and journal.spent() == 1
    with pytest.raises(ValueError):
        journal.settle(first, USAGE, "r1")
    second = journal.reserve("deep", "u2", Decimal(2))
    with pytest.raises(ValueError):
        journal.settle(second, {})
    assert journal.settle(second, USAGE, "r1") is None  # the ledger has this response
    third = journal.reserve("deep", "u3", Decimal(3))
    journal.unresolved(third, "timeout")
    with pytest.raises(ReservationBlocked, match="outstanding_reservations"):
        journal.reserve("deep", "u4", Decimal(1))
    with pytest.raises(ValueError):
        journal.release(third, " ")
    journal.release(third, "the provider's bill lacks it")
    with pytest.raises(ValueError):
        journal.reserve("deep", "u4", Decimal(-1))
    assert statuses(journal) == {first: ("settled", 1), second: ("settled", None), third: ("released", None)}
    ledger = accounts.journal_ledger(journal.entries())
    assert [(r.response_id, r.cost, r.usage.input_tokens) for r in ledger.collect()] == [("r1", 1, 100)]


def test_blocks(spark, tmp_path):
    journal = Journal(spark, str(tmp_path), price)
    number = journal.reserve("triage", "u", Decimal(1))
    journal.open_block(USAGE, "disk full", number, "r1")
    other = journal.open_block(USAGE, "disk full", None, "r1")
    with pytest.raises(ReservationBlocked):
        journal.reserve("triage", "v", Decimal(1))
    with pytest.raises(ValueError):
        journal.reconcile("")
    assert [(d["cost"]) for d in journal.reconcile("by hand")] == [1, None] and journal.reconcile("again") == []
    assert statuses(journal) == {number: ("settled", 1)} and journal.spent() == 1
    assert accounts.open_blocks(journal.entries()).isEmpty() and other
    journal.release(journal.reserve("triage", "v", Decimal(1)), "not sent")
    future = Journal(spark, str(tmp_path), price, now=lambda: datetime(2199, 1, 1, tzinfo=UTC))
    assert future.spent() == 0


def steps(spark, n):
    return spark.createDataFrame([(f"u{i}", "h", i, "call_deep" if i % 2 else "call_triage") for i in range(n)], "resource_url string, input_hash string, first_seen_at long, step string")


def run(spark, journal, analyzer, n=4, **more):
    options = {"limit": 9, "budget": Decimal(10), "spent": journal.spent() if journal else Decimal(0), "estimate": lambda row: Decimal(1), "journal": journal} | more
    return analysis.process(steps(spark, n), {"triage": analyzer, "deep": analyzer}, price, **options)


def test_batches(spark, tmp_path):
    """Calls are stored before they are made; an answer that can't be settled blocks the rest and keeps its usage."""
    journal = Journal(spark, str(tmp_path), price)
    seen = []

    def analyzer(row):
        seen.append([s for s, _ in statuses(journal).values()].count("reserved"))
        if row["resource_url"] == "u2":
            raise analysis.AnalyzerError("rate_limit")
        return {"result": {"relevance_status": "relevant"}, "usage": USAGE if row["resource_url"] != "u3" else {}, "response_id": row["resource_url"]}

    batch = run(spark, journal, analyzer)
    assert seen == [1, 1, 1, 1]
    assert [s for s, _ in statuses(journal).values()] == ["settled", "released", "settled", "reserved"]
    assert batch.blocked and batch.spent == 2 and accounts.open_blocks(journal.entries()).count() == 1
    assert {o["reason_code"] for o in run(spark, journal, analyzer).outcomes} == {"accounting_blocked"} and len(seen) == 4


def test_driver_dies_during_a_call(spark, tmp_path):
    script = f"""
        import os, sys
        from decimal import Decimal
        from pyspark.sql import SparkSession
        from dossier.journal import Journal
        from dossier.plans import analysis
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        journal = Journal(spark, {str(tmp_path)!r}, lambda usage: Decimal(1))
        rows = spark.createDataFrame([("u", "h", 1, "call_triage")], "resource_url string, input_hash string, first_seen_at long, step string")
        call = lambda row: os._exit(9)
        analysis.process(rows, {{"triage": call, "deep": call}}, None, limit=1, budget=Decimal(9), spent=Decimal(0), estimate=lambda row: Decimal(2), journal=journal)
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=False, capture_output=True, timeout=120).returncode == 9
    journal = Journal(spark, str(tmp_path), price)
    assert statuses(journal) == {1: ("reserved", None)} and journal.spent() == 2
    calls = []
    assert {o["reason_code"] for o in run(spark, journal, calls.append).outcomes} == {"accounting_blocked"} and not calls
    journal.settle(1, USAGE, "found on the bill")
    assert journal.spent() == 1


def test_limits_of_both_legs(spark):
    """From the soft limit on deep calls are put off and triage goes on."""
    answer = lambda row: {"result": {"relevance_status": "relevant"}, "usage": {"input_tokens": 100}, "response_id": None}
    batch = run(spark, None, answer, n=6, soft=Decimal(3))
    assert [(o["state"], o.get("decision")) for o in batch.outcomes] == [("triage_completed", None)] * 3 + [("deep_deferred_budget", "soft_limit_mode")] * 3
    capped = run(spark, None, answer, n=2, call_cap=Decimal("0.5"))
    assert [(o["state"], o.get("decision")) for o in capped.outcomes] == [("triage_completed", None), ("deep_deferred_budget", "blocked_single_call_limit")]
    grid = [*product((0, 11, 12, 15), (0, 1, 3, 5), (False, True))]
    table = spark.createDataFrame(grid, "spend int, estimate int, deep boolean").withColumn("g", rules.budget_guard(F.col("spend"), F.col("estimate"), F.col("deep"), F.lit(15), F.lit(12), F.lit(2)))
    assert [rules.guarded(s, e, d, 15, 12, 2) for s, e, d in grid] == [(r.g.decision, r.g.allowed) for r in table.collect()]
