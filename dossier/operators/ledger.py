"""Sums over the append-only ledger of metered work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import month_start

OUTSTANDING = ("reserved", "unresolved")


def appended(ledger: DataFrame, rows: DataFrame, response: str = "response_id") -> DataFrame:
    """Rows that the ledger takes: those with usage whose response is not in it yet; rows without a response id always."""
    seen = ledger.select(response).where(F.col(response).isNotNull()).distinct()
    named = rows.where(F.col(response).isNotNull()).dropDuplicates([response]).join(seen, response, "left_anti")
    return named.unionByName(rows.where(F.col(response).isNull()).select(named.columns))


def monthly(ledger: DataFrame, sums: dict[str, Column], by: Sequence[str] = (), time: str = "created_at") -> DataFrame:
    """events and sums for each calendar month (UTC), and for each value of by."""
    return ledger.groupBy(month_start(F.col(time)).alias("month"), *by).agg(F.count(F.lit(1)).alias("events"), *(F.sum(c).alias(n) for n, c in sums.items()))


def in_month(ledger: DataFrame, start, end, time: str = "created_at") -> DataFrame:
    return ledger.where((F.col(time) >= start) & (F.col(time) < end))


def committed(ledger: DataFrame, reservations: DataFrame, cost: str = "cost", time: str = "created_at") -> DataFrame:
    """For each month what is spent, what outstanding reservations hold, and both: month, spent, reserved, committed."""
    spent = ledger.groupBy(month_start(F.col(time)).alias("month")).agg(F.sum(cost).alias("spent"))
    held = reservations.where(F.col("status").isin(*OUTSTANDING)).groupBy(month_start(F.col(time)).alias("month")).agg(F.sum(cost).alias("reserved"))
    both = spent.join(held, "month", "full_outer")
    zero = F.lit(0).cast(ledger.schema[cost].dataType)
    return both.select("month", F.coalesce("spent", zero).alias("spent"), F.coalesce("reserved", zero).alias("reserved")).withColumn("committed", F.col("spent") + F.col("reserved"))


def since(ledger: DataFrame, mark: int, id_column: str = "event_id") -> DataFrame:
    """What was added after a high-water mark."""
    return ledger.where(F.col(id_column) > mark)


def high_water(ledger: DataFrame, id_column: str = "event_id") -> DataFrame:
    return ledger.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("mark"))


def replayed_blocks(blocks: DataFrame, ledger: DataFrame, response: str = "response_id") -> DataFrame:
    """Unresolved accounting blocks whose stored usage is still to be written."""
    return blocks.where(F.col("resolved_at").isNull()).join(ledger.select(response).where(F.col(response).isNotNull()).distinct(), response, "left_anti")
